"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ORDER gives every letter of a word its probability after the letters before it, from the
word's start on, and the word its end.  The languages' models share sorted arrays of n-gram hashes with one column of
log probabilities (and one of back-off weights) a language.  A text goes to the language of the least cross-entropy per
letter.  The score is the softmax of the cross-entropies at a temperature fitted on documents that the models did not see;
texts whose least cross-entropy lies beyond nearly all of those documents' are marked rejected.

The models are fitted on a bounded sample of labelled documents: SAMPLE_DOCS a language, by the hash of their id, whole
texts, as long as they add up to SAMPLE_BYTES a language; one in CALIBRATION of them is kept for the calibration.  Every
document is scored over its whole text.

A letter is a character of the Unicode categories L; numerals are none.  Null texts, empty texts and texts without a letter
are `und` with score 0.  Rows with a null lang teach nothing.  A null id counts as held out.  Rows that repeat an id each
get a row.  Without any labelled row all texts are `und`.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

ORDER = 5
SAMPLE_DOCS = 600
SAMPLE_BYTES = 8 << 20
CALIBRATION = 6
#: Words, and letters of words, that a worker remembers.
REMEMBERED = 300_000
REMEMBERED_LETTERS = 8_000_000
REJECTED_SHARE = 0.005
WORD = re.compile(r"[^\W\d_]+")
START, END = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    found = WORD.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():  # the pattern also takes numerals that are no digits
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return found


def coded(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words as code points with ORDER - 1 starts before and an end after each, and the lengths with the end."""
    pad = chr(START) * (ORDER - 1)
    joined = "".join(f"{pad}{w}{chr(END)}" for w in found)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), np.fromiter((len(w) + 1 for w in found), np.int64, len(found))


def hashed(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end before each place."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n, 0, -1):
        h = (h ^ codes[at - j]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, and where each group of them begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


class Models:
    """Sorted hash arrays: for each order the n-grams' log probabilities and the contexts' back-off weights."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        size = len(self.languages)
        found = [(k, w, n) for k, lang in enumerate(self.languages) for w, n in sorted(counts[lang].items())]
        codes, lengths = coded([w for _, w, _ in found])
        row = np.repeat(np.arange(len(found)), lengths)
        at = np.arange(len(row)) + (row + 1) * (ORDER - 1) + 1
        lang, count = np.array([k for k, _, _ in found])[row], np.array([n for _, _, n in found], np.float64)[row]
        self.uniform = 1.0 / (len(np.unique(codes[at - 1])) + 1)
        # From the longest down: a language's different n-grams, where one of each ends, and their counts; below the
        # longest these are the numbers of different letters before.
        levels = []
        for n in range(ORDER, 0, -1):
            h = hashed(codes, at, n)
            order, first = grouped(h, lang)
            count = np.add.reduceat(count[order], first)
            h, lang, at = h[order][first], lang[order][first], at[order][first]
            levels.append((n, h, lang, at, count))
            count = np.ones(len(at))
        self.tables = []
        probs = np.empty((0, size))
        for n, h, lang, at, count in levels[::-1]:
            grams, one, gram = np.unique(h, return_index=True, return_inverse=True)
            context_of = hashed(codes, at - 1, n - 1)
            contexts, context = np.unique(context_of, return_inverse=True)
            counts_of = np.zeros((len(grams), size))
            counts_of[gram, lang] = count
            total = np.bincount(context * size + lang, count, len(contexts) * size).reshape(-1, size)
            kinds = np.bincount(context * size + lang, minlength=len(contexts) * size).reshape(-1, size)
            ones, twos = (np.bincount(lang[count == x], minlength=size) for x in (1, 2))
            discount = np.where(ones > 0, np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95), 0.75)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = probs[np.searchsorted(self.tables[-1][0], hashed(codes, at[one], n - 1))] if n > 1 else self.uniform
            j = context[one]
            probs = np.maximum(counts_of - discount, 0) / np.maximum(total[j], 1) + weight[j] * below
            self.tables.append((grams, np.log(probs).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
        self.temperature, self.most = 1.0, float("inf")

    def score(self, found: list[str]) -> np.ndarray:
        """The words' log probabilities, a column a language."""
        codes, lengths = coded(found)
        row = np.repeat(np.arange(len(found)), lengths)
        at = np.arange(len(row)) + (row + 1) * (ORDER - 1) + 1
        out = np.zeros((len(row), len(self.languages)))
        left = np.arange(len(row))
        for n in range(ORDER, 0, -1):
            grams, logs, contexts, backs = self.tables[n - 1]
            h = hashed(codes, at[left], n)
            i = np.searchsorted(grams, h).clip(0, len(grams) - 1)
            hit = grams[i] == h
            out[left[hit]] += logs[i[hit]]
            left = left[~hit]
            h = hashed(codes, at[left] - 1, n - 1)
            i = np.searchsorted(contexts, h).clip(0, len(contexts) - 1)
            seen = contexts[i] == h
            out[left[seen]] += backs[i[seen]]
        out[left] += np.log(self.uniform)
        return np.add.reduceat(out, np.cumsum(lengths) - lengths, axis=0)

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        """entropies: a row a document; truth: its language's column."""
        if not len(truth):
            return

        def loss(t: float) -> float:
            z = -(entropies - entropies.min(axis=1, keepdims=True)) * t
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean())

        self.temperature = min((2.0**k for k in range(-2, 9)), key=loss)
        self.most = float(np.quantile(entropies.min(axis=1), 1 - REJECTED_SHARE)) * 1.05


def training_part() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def learn(docs: DataFrame) -> Models | None:
    """Fits the models on the sample; its word counts, bounded by the sample's size, reach the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & training_part())
    # A share of each language that surely holds its SAMPLE_DOCS least hashes is ranked, so the ranking stays small.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    few = labelled.select("doc_id", "lang", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES).join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) * F.col("size").cast("double") <= 4.0 * SAMPLE_DOCS * (1 << 31))
    order = W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id", "bytes")
    ranked = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    ids = ranked.withColumn("sum", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("sum") <= SAMPLE_BYTES).groupBy("doc_id", "lang").agg(F.min("n").alias("n"))
    # SAMPLE_DOCS ids a language at most.
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang", "n")), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(lang, n if n % CALIBRATION == 0 else 0, w, k) for lang, n, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "text")), strict=True) for w, k in Counter(words(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["lang", "doc", "word", "n"])

    rows = sample.select("lang", "n", "text").mapInArrow(count, "lang string, doc long, word string, n long").groupBy("lang", "doc", "word").agg(F.sum("n").alias("n")).toArrow()
    fit: dict[str, Counter] = defaultdict(Counter)
    kept: dict[tuple, list] = defaultdict(list)
    for lang, doc, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "doc", "word", "n")), strict=True):
        if doc:
            kept[lang, doc].append((word, n))
        else:
            fit[lang][word] += n
    if not fit:
        return None
    models = Models(fit)
    entropies, truth = [], []
    for (lang, _), found in sorted(kept.items()):
        if lang in fit:
            n = np.array([k for _, k in found])
            entropies.append(-(models.score([w for w, _ in found]) * n[:, None]).sum(axis=0) / (n * [len(w) + 1 for w, _ in found]).sum())
            truth.append(models.languages.index(lang))
    models.calibrate(np.array(entropies), np.array(truth))
    return models


class Scorer:
    """Scores texts, with the words met so far remembered."""

    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.rows = np.empty((0, len(self.models.languages)), np.float32)

    def entropies(self, texts: list[list[str]]) -> np.ndarray:
        """Per letter, a row a text; texts hold a word or more."""
        new = list(set().union(*texts).difference(self.known))
        letters = sum(map(len, new))
        if self.known and (len(self.known) + len(new) > REMEMBERED or self.letters + letters > REMEMBERED_LETTERS):
            self.forget()
            new = list(set().union(*texts))
            letters = sum(map(len, new))
        parts = [self.models.score(new[i : i + 20_000]).astype(np.float32) for i in range(0, len(new), 20_000)]
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, *parts])
        self.letters += letters
        n = np.array([len(x) for x in texts])
        at = np.fromiter((self.known[w] for x in texts for w in x), np.int64, n.sum())
        total = np.add.reduceat(self.rows[at].astype(np.float64), np.cumsum(n) - n, axis=0)
        return -total / np.array([sum(map(len, x)) + len(x) for x in texts])[:, None]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text, lang)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    models = learn(own)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m) if m else None
        for batch in slices(batches):
            found = [words(t) for t in batch.column("text").to_pylist()]
            some = [k for k, x in enumerate(found) if x and m]
            lang, score, rejected = ["und"] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
            if some:
                e = scorer.entropies([found[k] for k in some])
                z = np.exp(-(e - e.min(axis=1, keepdims=True)) * m.temperature)
                score[some], rejected[some] = 1 / z.sum(axis=1), e.min(axis=1) > m.most
                for k, best in zip(some, e.argmin(axis=1).tolist(), strict=True):
                    lang[k] = m.languages[best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return own.select("doc_id", (~training_part()).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
