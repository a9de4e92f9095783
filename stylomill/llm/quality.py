"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words.  A passage is encoded by what is learned of its words (each the mean
of learned vectors of the word and its byte trigrams, hashed to BUCKETS) and of its make-up (shares of kinds of bytes and
words, repetition within it); gated attention weighs the passages; the weighted mean, and a few figures of the document as
a whole, give its score.  Only documents carry labels.

The network is fitted on a bounded sample: of the labelled documents of at most SAMPLE_BYTES, whole texts, those of the least
hash of their id, SAMPLE_DOCS at most, as long as they add up to SAMPLE_BYTES; their texts reach the driver.  Every document
is scored over its whole text; what a worker remembers of words is bounded, and a long text takes memory in proportion to
its own length.

Null texts are empty: one passage without words.  A null id counts as held out.  Rows that repeat an id each get a row; an
id with several labels counts by its least.  Null labels teach nothing.  Where the sample holds one label alone there is
nothing to tell apart, and every score is the share of label 1 in it with one more document of each assumed (0.5 without any
label).  Equal texts have equal scores.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, raw, slices
from .langid import training_part
from .tokens import Numbered

PASSAGE_WORDS = 64
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 16 << 20
THRESHOLD = 0.3
BUCKETS = 1 << 12
HIDDEN = 16
ATTENTION = 8
EPOCHS = 6
BATCH = 64
RATE = 0.01
DECAY = 1e-4
#: Figures that hardly differ in the sample are not blown up beyond this.
LEAST_SPREAD = 0.02
#: Words that a worker remembers.
REMEMBERED = 100_000


def byte_kinds() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 stop or comma, 4 exclamation or question mark, 5 bar, 6 other ASCII sign, 7 beyond ASCII, 8 space."""
    out = np.full(256, 6, np.uint8)
    for kind, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-", b"!?", b"|")):
        out[list(members)] = kind
    out[128:] = 7
    out[list(b" \t\n\r\v\f")] = 8
    return out


KINDS = byte_kinds()
N_KINDS = 9
N_MAKEUP = N_KINDS + 7
N_DOCUMENT = 3
_THREE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and its byte trigrams, and how many a word has."""
    joined = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    grams = joined[:-2] * _THREE[0] + joined[1:-1] * _THREE[1] + joined[2:] * _THREE[2] if len(joined) else joined
    grams = ((grams ^ (grams >> np.uint64(29))) * _THREE[0]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    n = length + 1
    first = np.cumsum(n) - n
    out = np.empty(n.sum(), np.int64)
    out[first] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(BUCKETS)
    rest = np.ones(len(out), bool)
    rest[first] = False
    inside = np.ones(len(joined), bool)  # a word of n bytes has n trigrams with its marks, and two more places
    ends = np.cumsum(length + 2)
    inside[ends - 1] = inside[ends - 2] = False
    out[rest] = grams[inside[: len(grams)]]
    return out, n


@dataclass
class Bags:
    """Documents as passages: word (number of each passage's words, in order), size (words of a passage), makeup, count
    (passages of a document), figures (of the document)."""

    word: np.ndarray
    size: np.ndarray
    makeup: np.ndarray
    count: np.ndarray
    figures: np.ndarray


def bags(texts: list[bytes], known: Numbered) -> Bags:
    """One passage at least for each text."""
    numbers, sizes, makeups, counts, figures = [], [], [], [], []
    number = known.__getitem__
    for text in texts:
        words = text.split()
        n = max(1, -(-len(words) // PASSAGE_WORDS))
        counts.append(n)
        out, whole = np.zeros((n, N_MAKEUP), np.float32), np.zeros(N_DOCUMENT, np.float32)
        size = np.zeros(n, np.int64)
        if words:
            own = np.fromiter(map(number, words), np.int64, len(words))
            numbers.append(own)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            first = np.arange(0, len(words), PASSAGE_WORDS)
            size = np.diff(np.r_[first, len(words)])
            joined = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum(lengths)
            nbytes = np.add.reduceat(lengths, first)
            passage = np.repeat(np.arange(n), nbytes)
            kinds = np.bincount(passage * N_KINDS + KINDS[joined], minlength=n * N_KINDS).reshape(n, N_KINDS)
            out[:, :N_KINDS] = kinds / nbytes[:, None]
            last, k = KINDS[joined[ends - 1]], N_KINDS
            out[:, k] = nbytes / size / 10
            out[:, k + 1] = np.add.reduceat(lengths <= 2, first) / size
            out[:, k + 2] = np.add.reduceat(last >= 2, first) / size
            out[:, k + 3] = np.add.reduceat(last == 6, first) / size
            order = np.lexsort((own, np.repeat(np.arange(n), size)))
            new = np.r_[True, (own[order][1:] != own[order][:-1])]
            new[first] = True
            out[:, k + 4] = np.add.reduceat(new, first) / size
            out[:, k + 5] = np.add.reduceat(KINDS[joined[ends - lengths]] == 1, first) / size
            again = np.r_[False, own[1:] == own[:-1]]
            again[first] = False
            out[:, k + 6] = np.add.reduceat(again, first) / size
            lines = [x for x in text.split(b"\n") if x.strip()]
            whole[:] = 1 - len(set(lines)) / len(lines), len(np.unique(own)) / len(words), np.log1p(len(words)) / 10
        sizes.append(size)
        makeups.append(out)
        figures.append(whole)
    return Bags(
        np.concatenate([np.empty(0, np.int64), *numbers]),
        np.concatenate([np.empty(0, np.int64), *sizes]),
        np.concatenate([np.empty((0, N_MAKEUP), np.float32), *makeups]),
        np.array(counts, np.int64),
        np.array(figures, np.float32).reshape(-1, N_DOCUMENT),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of so many rows each, some of none."""
    out = np.zeros((len(count), *rows.shape[1:]), rows.dtype)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(rows, (np.cumsum(count) - count)[some], axis=0)
    return out


def gathered(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """out[i] is the sum of the rows whose `at` is i."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], axis=1)


@dataclass
class Network:
    """Gated attention pooling.  A passage: h = tanh(mean of its words' vectors + makeup M + b); its weight: softmax of
    (tanh(hV) * sigmoid(hU))w; score: sigmoid(sum(weight * h)c + figures f + d).  A word's vector: mean of W over its features."""

    mean: np.ndarray
    scale: np.ndarray
    figure_mean: np.ndarray
    figure_scale: np.ndarray
    p: dict[str, np.ndarray]

    def vectors(self, words: list[bytes]) -> np.ndarray:
        feature, n = word_features(words)
        return summed(self.p["W"][feature], n) / n[:, None]

    def forward(self, words: np.ndarray, b: Bags) -> dict[str, np.ndarray]:
        """words: a vector for each number that b.word may name."""
        p, first = self.p, np.cumsum(b.count) - b.count
        said = summed(words[b.word], b.size) / np.maximum(b.size, 1)[:, None]
        makeup, figures = (b.makeup - self.mean) / self.scale, (b.figures - self.figure_mean) / self.figure_scale
        h = np.tanh(said + makeup @ p["M"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), b.count))
        a = e / np.repeat(np.add.reduceat(e, first), b.count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"makeup": makeup, "figures": figures, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + figures @ p["f"] + p["d"])}

    def gradients(self, feature: np.ndarray, n_features: np.ndarray, b: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; feature, n_features: those of the words that b.word names."""
        p = self.p
        f, first = self.forward(summed(p["W"][feature], n_features) / n_features[:, None], b), np.cumsum(b.count) - b.count
        dy = (f["y"] - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], b.count, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), b.count))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        of_word = gathered(np.repeat(dh / np.maximum(b.size, 1)[:, None], b.size, axis=0), b.word, len(n_features)) / n_features[:, None]
        return {
            "W": gathered(np.repeat(of_word, n_features, axis=0), feature, BUCKETS), "M": f["makeup"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "f": f["figures"].T @ dy, "d": dy.sum(keepdims=True),
        }


class Scorer:
    """Scores texts, with the vectors of words met so far remembered; or gives all the one score."""

    def __init__(self, network: Network | float):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.known, self.rows, self.n = Numbered(), np.empty((1 << 12, HIDDEN), np.float32), 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts or isinstance(self.network, float):
            return np.full(len(texts), self.network if texts else 0.0)
        if len(self.known) > REMEMBERED:  # frequent words were met early
            first, self.known = self.known, Numbered()
            self.known.update(islice(first.items(), REMEMBERED // 2))
            self.n = len(self.known)
            self.rows = self.rows[: max(self.n, 1 << 12)].copy()
        b = bags(texts, self.known)
        new, self.known.new = self.known.new, []
        while self.n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        for at in range(0, len(new), 20_000):
            part = self.network.vectors(new[at : at + 20_000])
            self.rows[self.n : self.n + len(part)] = part
            self.n += len(part)
        return self.network.forward(self.rows, b)["y"].astype(np.float64)


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the cross-entropy of the bags' labels, in mini-batches of bags."""
    rng = np.random.default_rng(11)
    known = Numbered()
    whole = bags(texts, known)
    feature, n_features = word_features(known.new)
    begin = np.cumsum(n_features) - n_features
    shapes = {"W": (BUCKETS, HIDDEN), "M": (N_MAKEUP, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "f": (N_DOCUMENT,), "d": (1,)}
    spread = [np.maximum(x.std(axis=0), LEAST_SPREAD) for x in (whole.makeup, whole.figures)]
    net = Network(whole.makeup.mean(axis=0), spread[0], whole.figures.mean(axis=0), spread[1], {k: rng.normal(0, 0.3, s) for k, s in shapes.items()})
    passage, token = np.cumsum(whole.count) - whole.count, np.cumsum(whole.size) - whole.size
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0

    def stretches(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)

    n_steps = EPOCHS * max(1, -(-len(labels) // BATCH))
    while step < max(n_steps, 300):  # a small sample is gone through more often
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rows = stretches(passage[docs], whole.count[docs])
            words, number = np.unique(whole.word[stretches(token[rows], whole.size[rows])], return_inverse=True)
            part = Bags(number, whole.size[rows], whole.makeup[rows], whole.count[docs], whole.figures[docs])
            rate = RATE * 0.5 * (1 + np.cos(np.pi * min(1, step / max(n_steps, 300))))
            step += 1
            for k, g in net.gradients(feature[stretches(begin[words], n_features[words])], n_features[words], part, labels[docs]).items():
                g = g + DECAY * net.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network, or the score of all documents where only one label is known."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("quality"))
    labelled = docs.where(training_part()).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES).join(marks, "doc_id")
    # A share that surely holds the SAMPLE_DOCS least hashes is ordered, so the order stays small.
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    few = labelled.where(hashed * float(labelled.count()) <= 4.0 * SAMPLE_DOCS * (1 << 31)).orderBy(hashed, "doc_id", "bytes").limit(SAMPLE_DOCS)
    upto = F.sum("bytes").over(W.orderBy(hashed, "doc_id", "bytes").rowsBetween(W.unboundedPreceding, 0))
    ids = few.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "quality").distinct()
    # SAMPLE_DOCS ids and labels are broadcast at most, and SAMPLE_BYTES of text (more only where ids repeat) come back.
    sample = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id")
    found = sample.select("doc_id", "quality", F.col("text").cast("binary").alias("text")).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    truth = found.column("quality").to_numpy()
    if len(np.unique(truth)) < 2:
        return float((truth.sum() + 1) / (len(truth) + 2))
    return fit([x or b"" for x in found.column("text").to_pylist()], truth)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text); labels(doc_id, quality)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = scores(own, learn(own, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scores(own: DataFrame, network: Network | float) -> DataFrame:
    """own's columns but text, held_out and score."""
    shared = own.sparkSession.sparkContext.broadcast(network)
    names = [c for c in own.columns if c != "text"]
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names) + ", held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "held_out")), pa.array(scorer.score(raw(batch)))], names=[*names, "held_out", "score"])

    return own.select(*names, (~training_part()).alias("held_out"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted 1."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(own, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            yield batch.filter(pa.array(scorer.score(raw(batch)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
