"""Repeated passages by prefix-free parsing.

Texts are brought together by content first.  A rolling hash runs over every text; the least hash within a window sets an
anchor, so every window of `length` bytes has exactly one (the leftmost of equals), which depends on the window's bytes
alone.  Around an anchor lies a context that holds all windows of that anchor; equal contexts are one.  Contexts whose
anchor string occurs once hold nothing repeated; a context that occurs more than once is repeated whole.

What is left, different contexts of the same anchor strings, is highly repetitive and is indexed by prefix-free parsing, in
shards that hold all contexts of their anchors.  In a shard, rolling-hash triggers cut the contexts into phrases that overlap by
MARK bytes.  The different phrases are the dictionary, the contexts as sequences of phrases the parse.  The suffix array of
the dictionary orders what follows a place up to its phrase's end, the suffix array of the parse what follows that; both
together put all places of the shard in the order of their suffixes.  A window is repeated if a neighbour in that order has
the same first `length` bytes, which are compared.

An anchor with many contexts has several shards; what these hold of it is compared by two 64-bit hashes of each window.
Documents are told apart by their id and a hash of their text, contexts by two 64-bit hashes.  A bit map of the hashes still
in question, sized by their number up to MAP_BITS bits, is broadcast to thin out rows before they are shuffled; what it
lets through by chance is dropped by the joins that follow.

Bytes are those of UTF-8; null is empty.  Null ids are kept.  Rows that repeat an id and text are occurrences of their own
and get a row each.  Texts under `length` bytes have no windows; long texts are read in overlapping pieces.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, parted, raw, reshuffled, saved, slices

#: Bytes of an anchor string.
ANCHOR = 64
#: Anchors of one piece of a long text; a piece overlaps its neighbours by a context.
PIECE = 1 << 18
#: Bits of a map: 16 for each key, between these powers of two.
MAP_BITS = (16, 27)
#: Bytes of a trigger, and bytes from one trigger to the next on average.
MARK = 8
SPACING = 32
#: Windows whose bytes are compared in one go.
COMPARED = 1 << 15
_rng = np.random.default_rng(7)
_BYTE, _OTHER = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of a buffer; values: what each byte stands for."""

    def __init__(self, data: bytes, values: np.ndarray = _BYTE):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values[np.frombuffer(data, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = self.n - width + 1
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Buffers of about PIECE bytes, with rows (text, offset in it, begin, end in the buffer, first and last anchor)."""
    side = length - ANCHOR
    buffer, rows, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for first in range(0, len(text), PIECE):
            begin, end = max(0, first - side), min(len(text), first + PIECE + length)
            if end - begin >= length:
                buffer.append(text[begin:end])
                rows.append((k, begin, size, size + end - begin, first, first + PIECE))
                size += end - begin
                if size >= PIECE:
                    yield b"".join(buffer), np.array(rows, np.int64)
                    buffer, rows, size = [], [], 0
    if rows:
        yield b"".join(buffer), np.array(rows, np.int64)


def anchors(texts: list[bytes], length: int) -> Iterator[dict[str, np.ndarray]]:
    """Of each anchor: text, at (offset), lo and hi (how far before it its windows start), gram and context (hashes)."""
    side = length - ANCHOR
    position = np.uint64((1 << 28) - 1)
    for data, rows in pieces(texts, length):
        r = Rolling(data)
        grams = r.windows(ANCHOR)
        least = least_of((grams & ~position) | np.arange(len(grams), dtype=np.uint64), side + 1)
        counts = rows[:, 3] - rows[:, 2] - length + 1
        row = np.repeat(np.arange(len(rows)), counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + rows[row, 2]
        at = (least[start] & position).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1
        t, row = at[first], row[first]
        offset = t - rows[row, 2] + rows[row, 1]
        begin, end = np.maximum(rows[row, 2], t - side), np.minimum(rows[row, 3], t + length)
        context = mixed(r.of(begin, end) + ((t - begin) * 4096 + (end - t)).astype(np.uint64))
        keep = (offset >= rows[row, 4]) & (offset < rows[row, 5])
        found = {"text": rows[row, 0], "at": offset, "lo": t - start[last], "hi": t - start[first], "gram": grams[t].view(np.int64), "context": context.view(np.int64)}
        yield {k: v[keep] for k, v in found.items()}


def key_map(keys: DataFrame, key: str) -> np.ndarray:
    """A bit map of the keys' low bits, sized by their number, up to 16 MB.  keys: a written table."""
    low, high = MAP_BITS
    bits = min(high, max(low, (16 * keys.count()).bit_length()))
    place = keys.select(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    rows = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def parse(docs: DataFrame, length: int, shared=None) -> DataFrame:
    """id, key, at, lo, hi, gram, context of every anchor, or of those whose gram may be in the map."""
    names = ("at", "lo", "hi", "gram", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for found in anchors(raw(batch), length):
                if shared is not None:
                    keep = in_map(shared.value, found["gram"])
                    found = {k: v[keep] for k, v in found.items()}
                yield pa.RecordBatch.from_arrays([pa.array(ids[found["text"]]), pa.array(keys[found["text"]]), *(pa.array(found[c]) for c in names)], names=["id", "key", *names])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key long, at long, lo long, hi long, gram long, context long")


def refined(rank: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Ranks of suffixes by their first `width` symbols, refined by prefix doubling until they hold for whole suffixes.

    A suffix ends before its `end`; what has ended is the least.  A rank is the number of suffixes that are less; equal
    suffixes have equal ranks."""
    rank, n = rank.copy(), len(rank)
    at = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else np.empty(0, np.int64)
    while len(at):
        further = at + width
        first, second = rank[at], np.where(further < end[at], rank[np.minimum(further, n - 1)] + 1, 0)
        order = np.argsort(first * (n + 1) + second)
        at, first, second = at[order], first[order], second[order]
        opens = np.r_[True, first[1:] != first[:-1]]
        splits = opens | np.r_[True, second[1:] != second[:-1]]
        spot = np.arange(len(at))
        rank[at] = first + np.maximum.accumulate(np.where(splits, spot, 0)) - np.maximum.accumulate(np.where(opens, spot, 0))
        # Equal ones that go on may still part.
        begin = np.flatnonzero(splits)
        size = np.diff(np.r_[begin, len(at)])
        at = at[np.repeat((size > 1) & (second[begin] > 0), size)]
        width *= 2
    return rank


def ranked(values: np.ndarray) -> np.ndarray:
    """How many values are less than each."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - count)[inverse]


class Parsed:
    """Strings cut into phrases, with the suffix arrays of dictionary and parse."""

    def __init__(self, strings: list[bytes], mark: int = MARK, spacing: int = SPACING):
        self.data = b"".join(strings)
        self.end = np.cumsum([len(x) for x in strings])
        self.begin = self.end - [len(x) for x in strings]
        of_byte = np.repeat(np.arange(len(strings)), self.end - self.begin)
        # Phrases begin with a string and at every trigger inside one.
        cut = np.zeros(len(self.data) + 1, bool)
        if len(self.data) > mark:
            at = np.flatnonzero(Rolling(self.data).windows(mark) % np.uint64(spacing) == 0)
            cut[at[at + mark <= self.end[of_byte[at]]]] = True
        cut[self.begin] = True
        start = np.flatnonzero(cut[:-1])
        string = of_byte[start]
        last = np.r_[string[1:] != string[:-1], True][: len(start)]
        stop = np.where(last, self.end[string], np.r_[start[1:], 0][: len(start)] + mark)
        # Dictionary: the phrases as bytes, a string's last one marked.
        ids: dict[tuple[bytes, bool], int] = {}
        self.phrase = np.array([ids.setdefault((self.data[a:b], x), len(ids)) for a, b, x in zip(start.tolist(), stop.tolist(), last.tolist(), strict=True)], np.int64)
        self.start, self.last = start, last
        # Each phrase's symbols, with one more at the end that is above all bytes, or nothing after a string's last.
        size = np.array([len(p) + 1 for p, _ in ids], np.int64)
        self.entry = np.cumsum(size) - size
        symbol = np.frombuffer(b"".join(p + b"\0" for p, _ in ids), np.uint8).astype(np.uint64) + np.uint64(1)
        closing = self.entry + size - 1
        symbol[closing] = np.where([x for _, x in ids], 0, 257)
        end = np.repeat(self.entry + size, size)
        place, packed, wide = np.arange(len(symbol)), np.zeros(len(symbol), np.uint64), 7
        for k in range(wide):
            inside = place + k < end
            packed = (packed << np.uint64(9)) | np.where(inside, symbol[np.minimum(place + k, len(symbol) - 1)], np.uint64(0))
        #: Ranks of the suffixes of phrases, and of the suffixes of the parse, counted from 1.
        self.of_dictionary = refined(ranked(packed), end, wide)
        parse_end = np.searchsorted(string, string, side="right")
        self.of_parse = refined(ranked(self.of_dictionary[self.entry[self.phrase]]), parse_end, 1) + 1

    def order(self, at: np.ndarray) -> np.ndarray:
        """The places `at` of the strings (as offsets into all of them), in the order of their suffixes; equal ones by place."""
        k = np.searchsorted(self.start, at, side="right") - 1
        up_to_phrase = self.of_dictionary[self.entry[self.phrase[k]] + at - self.start[k]]
        after = np.where(self.last[k], 0, np.r_[self.of_parse, 0][k + 1])
        return at[np.lexsort((at, after, up_to_phrase))]


def repeated_places(strings: list[bytes], row: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Which of these places (string, offset in it), all of them with `length` bytes to come, have the same next `length`
    bytes as another."""
    p = Parsed(strings)
    at = p.begin[row] + offset
    order = p.order(at)
    hashes = Rolling(p.data).of(order, order + length)
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(p.data, np.uint8), length) if len(same) else None
    equal = [x[(view[order[x]] == view[order[x + 1]]).all(axis=1)] for x in np.split(same, range(COMPARED, len(same), COMPARED)) if len(x)]
    found = np.zeros(len(p.data), bool)
    for x in equal:
        found[order[x]] = found[order[x + 1]] = True
    return found[at]


def runs(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the stretches of consecutive values within rows."""
    if not len(values):
        return values, values, values
    cut = np.flatnonzero(np.r_[True, (np.diff(values) != 1) | (np.diff(rows) != 0)])
    return rows[cut], values[cut], values[np.r_[cut[1:] - 1, len(values) - 1]]


#: Contexts with one anchor string that are compared in one shard, and contexts that a task takes at a time.
BLOCK_CONTEXTS = 256
BUCKET_CONTEXTS = 1024
FOUND = "id long, key long, start long, last long, gram long, own long, other long, block int, a long"


def compared(group: pa.Table, length: int) -> pa.Table:
    """FOUND: the repeated windows of these contexts as stretches (block -1); and of anchors with several shards each window
    once, with two hashes, to be met by other shards' (start -1 where it is repeated already)."""
    content = group.column("content").to_pylist()
    lo, hi, left, key, doc, at, gram, block, blocks, n = (group.column(c).to_numpy() for c in ("lo", "hi", "left", "key", "id", "at", "gram", "block", "blocks", "n"))
    count = hi - lo + 1
    row = np.repeat(np.arange(len(content)), count)
    a = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    repeated = repeated_places(content, row, left[row] - a, length)
    done = repeated & (n[row] == 1)
    r, first, last = runs(a[done], row[done])
    zero = np.zeros(len(r), np.int64)
    closed = [doc[r], key[r], at[r] - last, at[r] - first, zero, zero, zero, np.full(len(r), -1), zero]
    wide = np.flatnonzero(blocks[row] > 1)
    own, other, w = np.empty(0, np.int64), np.empty(0, np.int64), row[wide]
    if len(wide):
        data, size = b"".join(content), np.array([len(x) for x in content])
        start = (np.cumsum(size) - size)[w] + left[w] - a[wide]
        own, other = (Rolling(data, values).of(start, start + length).view(np.int64) for values in (_BYTE, _OTHER))
        keep = np.unique(np.stack([gram[w], own, other, a[wide]]), axis=1, return_index=True)[1]
        wide, w, own, other = wide[keep], w[keep], own[keep], other[keep]
    asks = ~repeated[wide] & (n[w] == 1)
    spot = np.where(asks, at[w] - a[wide], -1)
    shown = [doc[w], key[w], spot, spot, gram[w], own, other, block[w], a[wide]]
    return pa.table({c: pa.array(np.concatenate([x, y]).astype(np.int32 if c == "block" else np.int64)) for c, x, y in zip(("id", "key", "start", "last", "gram", "own", "other", "block", "a"), closed, shown, strict=True)})


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """id, key, start, last: stretches of starts of windows that also occur elsewhere; a written table.  docs: id, key, text."""
    spark = docs.sparkSession
    common = saved(parse(docs, length).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "common")
    shared = spark.sparkContext.broadcast(key_map(common, "gram"))
    parsed = saved(parse(docs, length, shared), "parse")
    # One row of each context stands for it; which one does not matter.
    places = ("id", "key", "at", "lo", "hi")
    contexts = saved(parsed.groupBy("gram", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in places)), "contexts")
    whole = parsed.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi").select("id", "key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo")).alias("last"))

    grams = contexts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1").select(reshuffled("gram"), F.ceil(F.col("contexts") / BLOCK_CONTEXTS).cast("int").alias("blocks"))
    several = saved(contexts.join(grams, "gram"), "several")
    holders = several.groupBy("id", "key").agg(F.collect_list(F.struct("gram", "context", "n", "at", "lo", "hi", "blocks")).alias("contexts"))
    kinds = {"id": "long", "key": "long", "at": "long", "lo": "long", "hi": "long", "gram": "long", "block": "int", "blocks": "int", "n": "long", "left": "long", "content": "binary"}

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, key, text, held in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), raw(batch), batch.column("contexts").to_pylist(), strict=True):
                for p in held:
                    begin = p["at"] - p["hi"]  # no further than its windows reach
                    out.append((doc, key, p["at"], p["lo"], p["hi"], p["gram"], p["context"] % p["blocks"], p["blocks"], p["n"], p["hi"], text[begin : p["at"] - p["lo"] + length]))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    near, _ = parted(docs.select("id", "key", "text"), ["id", "key"], several)
    # Rows that repeat an id and text count once here; each task drops its own repeats before any text is shuffled.
    held = near.groupBy("id", "key").agg(F.first("text").alias("text")).join(holders, ["id", "key"]).mapInArrow(contents, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    buckets = max(1, -(-several.count() // BUCKET_CONTEXTS))
    bucket = F.pmod(F.xxhash64("gram", "block"), F.lit(buckets)).alias("bucket")
    found = saved(held.select("*", bucket).groupBy("bucket").applyInArrow(lambda group: compared(group, length), FOUND), "windows")
    asked = found.where("block >= 0")
    window = ["gram", "own", "other", "a"]
    answers = asked.groupBy(*window).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(reshuffled("gram"), *window[1:])
    across = asked.where("start >= 0").join(answers, window, "left_semi").select("id", "key", "start", "last")
    out = saved(whole.unionByName(found.where("block < 0").select("id", "key", "start", "last")).unionByName(across), "starts")
    discard(common, parsed, contexts, several, found)
    return out


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches of bytes, start and end), kept (the other bytes) for every row of
    docs(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("key"), "doc_id", "text")
    found = repeated_windows(own, length)
    near, others = parted(own, ["id", "key"], found)
    stretches = found.groupBy("id", "key").agg(F.collect_list(F.struct("start", "last")).alias("starts"))
    kind = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, spans, kept = raw(batch), [], []
            for text, starts in zip(texts, batch.column("starts").to_pylist(), strict=True):
                mine: list[dict[str, int]] = []
                for s in sorted((x["start"], x["last"] + length) for x in starts or []):
                    if mine and s[0] <= mine[-1]["end"]:
                        mine[-1]["end"] = max(mine[-1]["end"], s[1])
                    else:
                        mine.append({"start": s[0], "end": s[1]})
                at = [0, *(y for x in mine for y in (x["start"], x["end"])), len(text)]
                spans.append(mine)
                kept.append(b"".join(text[i:j] for i, j in zip(at[::2], at[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    changed = near.join(stretches, ["id", "key"], "left").select("doc_id", "text", "starts").mapInArrow(cut, kind)
    same = others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(same)


def repeat_digest(docs: DataFrame, length: int = 200) -> DataFrame:
    return cut_repeats(docs, length).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
