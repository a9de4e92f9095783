"""MinHash near-duplicates with HyperMinHash registers.

A document's registers hold, for each of 256 buckets, the leading-zero count and ten mantissa bits of the bucket's least
shingle hash.  Small sets fill the buckets by 256 hash functions, large sets by the hash's leading bits; sets near the
border do both, so any two sets that can be linked share a scheme.  The registers are kept, 512 bytes a scheme.

Bands of registers bring documents together; bands with the same documents count once.  What meets in a band is estimated
on the kept registers alone, corrected for register collisions; a spanning forest of the pairs whose estimate passes leaves
a task, a band of many documents being dealt out in pairs of bounded blocks.  Texts are fetched only for the forest's pairs:
first the best one of each document, then the best between any two groups; each is confirmed on the full shingle sets.  The
groups that a band's passing pairs still cross are settled exactly: documents with such a pair meet, with their texts, in
pairs of bounded blocks, where every such pair between groups is checked.

Exact copies (equal sets) are one node.  No pair leaves a task unless it is a link or an edge of a forest.  Nulls and empty
texts: no shingles, linked with nothing.  A null id gets a null component and is kept.  Rows that repeat an id are one node,
which joins what any of them is linked with, and each get a row.  The least id of a group names it, so there are no ties.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, components, discard, parted, raw, reshuffled, saved, slices

REGISTERS = 256
MANTISSA = 10
EMPTY = 0xFFFF
#: Sets of up to so many shingles fill the registers by one hash function each.
SMALL_SET = 1024
#: Chance at most that a pair at the threshold itself is missed by all bands, or by the estimate.
MISS = 1e-8
#: Documents of a band that are estimated in one block, and documents of a larger band that all its blocks see.
BLOCK_MEMBERS = 4096
HUBS = 16
#: Rows and shingles of one block of texts; a task holds two blocks.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 300_000

_rng = np.random.default_rng(20240)
_ODD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return data.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words, or of the whole sequence if it is shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(width, len(tokens))
    n = len(tokens) - width + 1
    h = mixed(each[:n] + np.uint64(width))
    for j in range(1, width):
        h = mixed(h * _STEP + each[j : j + n])
    return np.unique(h)


def compressed(least: np.ndarray) -> np.ndarray:
    """64-bit minima as 6 bits of leading zeros and the mantissa after the leading one."""
    part, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    return (zeros * (1 << MANTISSA) + ((2 * part - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)


def registers_small(h: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), SMALL_SET):
        np.minimum(out, ((h[None, at : at + SMALL_SET] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return compressed(out)


def registers_large(h: np.ndarray) -> np.ndarray:
    """h is sorted, so the first hash of each leading byte is that bucket's minimum."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bucket, first = np.unique((h >> np.uint64(56)).astype(np.int64), return_index=True)
    out[bucket] = compressed(h[first] << np.uint64(8))
    return out


def schemes(n: int, threshold: float) -> list[str]:
    """Two sets at the threshold differ in size by a factor of it at most, so they share one of these."""
    n = int(n)
    return ["small"] * (0 < n <= SMALL_SET) + ["large"] * (n >= threshold * SMALL_SET)


def banding(threshold: float) -> tuple[int, int]:
    """(registers a band, bands): the longest bands that miss a pair at the threshold with chance MISS at most."""
    for r in range(16, 1, -1):
        if (1 - threshold**r) ** (REGISTERS // r) <= MISS:
            return r, REGISTERS // r
    return 1, REGISTERS


def least_estimate(threshold: float) -> float:
    """An estimate below which a pair at the threshold falls with chance MISS at most (Chernoff bound)."""
    t = threshold
    while t > 0.01:
        t -= 0.01
        if REGISTERS * (t * math.log(t / threshold) + (1 - t) * math.log((1 - t) / (1 - threshold))) >= -math.log(MISS):
            return t
    return 0.0


def estimated(mine: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one set against others: the share of equal registers, less the collisions expected of
    unrelated sets of these sizes."""
    filled = ((mine != EMPTY) | (others != EMPTY)).sum(axis=1).clip(1)
    equal = ((mine == others) & (mine != EMPTY)).sum(axis=1)
    ratio = np.maximum(n, sizes) / np.minimum(n, sizes).clip(1)
    expected = 0.1699194871597391 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = equal / filled
    return (share - expected) / (1 - expected)


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash, small, large (registers of either scheme), bands: one row for each row of docs.

    A band's key ends in a bit that names its scheme."""
    r, n_bands = banding(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            sets = [shingle_hashes(words(x), width) for x in raw(batch)]
            kept: dict[str, list[bytes | None]] = {"small": [], "large": []}
            bands: list[list[int]] = []
            for h in sets:
                mine, keys = schemes(len(h), threshold), []
                for k, (scheme, make) in enumerate((("small", registers_small), ("large", registers_large))):
                    regs = make(h) if scheme in mine else None
                    kept[scheme].append(None if regs is None else regs.astype("<u2").tobytes())
                    for j in range(0 if regs is None else n_bands):
                        band = regs[j * r : j * r + r]
                        if (band != EMPTY).any():
                            keys.append(((xxhash.xxh64_intdigest(band.tobytes(), j) - (1 << 63)) & ~1) | k)
                bands.append(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary()),
                    *(pa.array(kept[scheme], pa.binary()) for scheme in ("small", "large")),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_hash", "small", "large", "bands"],
            )

    kind = "doc_id long, text_key long, n_shingles long, set_hash binary, small binary, large binary, bands array<long>"
    return docs.select("doc_id", "text_key", "text").mapInArrow(sign, kind)


class Sketches:
    """Registers of some documents, with the estimates between them."""

    def __init__(self, registers: list[bytes], sizes: np.ndarray, percent: int):
        self.regs = np.frombuffer(b"".join(registers), "<u2").reshape(-1, REGISTERS)
        self.sizes, self.percent = sizes, percent

    def passing(self, i: int, others: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Those of the others whose estimated similarity with i, and whose size, allow a link; the most similar first."""
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small * 100 >= large * self.percent]
        if not len(others):
            return []
        e = estimated(self.regs[i], self.regs[others], self.sizes[i], self.sizes[others])
        order = np.argsort(-e, kind="stable")[: int((e >= least).sum())]
        return list(zip(others[order].tolist(), e[order].tolist(), strict=True))

    def forest(self, hub: np.ndarray, block: np.ndarray, threshold: float, groups: np.ndarray | None = None) -> list[tuple[int, int, float]]:
        """(row, row, estimate): a spanning forest of the pairs that pass; where rows of two blocks meet, of those between
        the blocks; where groups are given, of those between groups.

        Hubs are rows that all blocks of a band see.  What passes with a hub is joined to it where the row's own block is
        alone, so rows of two blocks that found the same hub need no pair of their own."""
        n, out, floor = len(hub), [], least_estimate(threshold)
        label, across = np.arange(n), len(np.unique(block[~hub])) > 1

        def join(i: int, j: int) -> bool:
            a, b = label[i], label[j]
            if a != b:
                label[label == b] = a
            return a != b

        if across:
            for h in np.flatnonzero(hub).tolist():
                for j, _ in self.passing(h, np.flatnonzero(label != label[h]), floor):
                    join(h, j)
        for least in (threshold, floor):
            for i in range(n):
                rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                if across:
                    rest = rest[:0] if hub[i] else rest[~hub[rest] & (block[rest] != block[i])]
                if groups is not None:
                    rest = rest[groups[rest] != groups[i]]
                if len(rest):
                    out += [(i, j, e) for j, e in self.passing(i, rest, least) if join(i, j)]
        return out


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The stretches of equal keys of rows that come sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        whole = (pa.concat_tables([held, whole]) if held is not None else whole).combine_chunks()
        new = np.zeros(whole.num_rows, bool)
        new[0] = True
        for k in keys:
            v = whole.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new).tolist()
        for i, j in zip(at, at[1:], strict=False):
            yield whole.slice(i, j - i)
        held = whole.slice(at[-1])
    if held is not None:
        yield held


def confirmed(texts: tuple[bytes, bytes], width: int, percent: int) -> bool:
    """Whether two texts are linked, on the words themselves."""
    a, b = (shingles(words(t), width) for t in texts)
    shared = len(a & b)
    return bool(a) and 100 * shared >= percent * (len(a) + len(b) - shared)


def shingles(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    k = min(width, len(tokens))
    return set(zip(*(tokens[j : len(tokens) - k + 1 + j] for j in range(k)), strict=True)) if tokens else set()


def linked(texts: list[bytes], blocks: np.ndarray, groups: np.ndarray, width: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of these texts, on the words themselves; with two blocks, of pairs between the blocks.
    All pairs between groups are checked until these are joined."""
    ids: dict[tuple, int] = {}
    sets = [np.array([ids.setdefault(x, len(ids)) for x in shingles(words(t), width)], np.int64) for t in texts]
    sizes, label, out = np.array([len(x) for x in sets]), groups.copy(), []
    across, flat, first = len(np.unique(blocks)) > 1, np.concatenate([np.empty(0, np.int64), *sets]), np.cumsum(sizes) - sizes
    mark = np.zeros(len(ids), bool)
    for i in range(len(texts)):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if across:
            rest = rest[blocks[rest] != blocks[i]]
        rest = rest[(np.minimum(sizes[rest], sizes[i]) * 100 >= np.maximum(sizes[rest], sizes[i]) * percent) & (sizes[rest] > 0)]
        if not len(rest) or not sizes[i]:
            continue
        mark[sets[i]] = True
        n = sizes[rest]
        own = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rest], n)]
        shared = np.add.reduceat(mark[own].astype(np.int64), np.cumsum(n) - n)
        mark[sets[i]] = False
        for j in rest[100 * shared >= percent * (sizes[i] + n - shared)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def dealt(rows: DataFrame, by: str, blocks: Column, node: str) -> DataFrame:
    """rows(by, node, ...) with low and high: every row once for each pair of its group's blocks that its block belongs to."""
    own = rows.withColumn("blocks", blocks).withColumn("block", F.expr(f"cast(pmod(xxhash64({node}), blocks) as int)"))
    return own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def in_segments(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run over the rows of equal keys, one group at a time; many small groups share a task without a cost for each."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: run(segments(batches, keys)), schema)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Links: 100 * intersection >= percent * union of the sets of `width`-word shingles."""
    threshold = percent / 100
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    signed = saved(signatures(own, width, threshold).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A class is a set of shingles; its row of the least id stands for it.  rep: that id, the class's node among links.
    named = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    classes = saved(named.groupBy("set_hash").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("set_hash", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("row")), "classes")

    # Bands with the same documents, told by their number and two hashes, are one.
    keys = signed.join(classes.select("row", "rep"), "row").select("row", "rep", F.explode("bands").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    keys = saved(parted(keys, ["key"], shared)[0].join(shared, "key"), "keys")
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first"), *(F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"x{k}") for k in (0, 1)))
    bands = met.groupBy("n", "first", "x0", "x1", F.col("key").bitwiseAND(F.lit(1)).alias("scheme")).agg(F.min("key").alias("key")).select(reshuffled("key"), "n")
    members = saved(keys.join(bands, "key").select("key", "row", "rep", "n"), "members")
    held, _ = parted(signed.select("row", "n_shingles", "small", "large"), ["row"], members.select("row"))
    chosen = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("small")).otherwise(F.col("large")).alias("registers")
    sketched = members.join(held, "row").select("key", "row", "rep", "n", "n_shingles", chosen)

    def propose(found: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in found:
            order = np.lexsort((table.column("row").to_numpy(), ~table.column("hub").to_numpy(zero_copy_only=False)))
            table = table.take(order)
            sketches = Sketches(table.column("registers").to_pylist(), table.column("n_shingles").to_numpy(), percent)
            edges = sketches.forest(table.column("hub").to_numpy(zero_copy_only=False), table.column("block").to_numpy(), threshold, table.column("component").to_numpy() if "component" in table.column_names else None)
            if edges:
                row, rep, key = table.column("row").to_numpy(), table.column("rep").to_numpy(), table.column("key").to_numpy()
                i, j = np.array([x[0] for x in edges]), np.array([x[1] for x in edges])
                i, j = np.where(row[i] > row[j], i, j), np.where(row[i] > row[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(key[0], len(i)), row[i], row[j], rep[i], rep[j], np.array([x[2] for x in edges]))], names=["key", "a", "b", "ra", "rb", "estimate"])

    edge = "key long, a long, b long, ra long, rb long, estimate double"
    n_blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    hub = (F.col("n") > BLOCK_MEMBERS) & (F.pmod(F.xxhash64("row", "key"), F.col("n")) < HUBS)
    # A hub goes to every pair of blocks, as a row of neither.
    shown = dealt(sketched.where(~hub), "key", n_blocks, "row").select("key", "low", "high", "row", "rep", "n_shingles", "registers", "block", F.lit(False).alias("hub"))
    everywhere = sketched.where(hub).withColumn("blocks", n_blocks).withColumn("low", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("high", F.explode(F.expr("sequence(low, blocks - 1)")))
    shown = shown.unionByName(everywhere.select("key", "low", "high", "row", "rep", "n_shingles", "registers", F.lit(-1).alias("block"), F.lit(True).alias("hub")))
    edges = saved(in_segments(shown, ["key", "low", "high"], propose, edge), "edges")

    # Texts of the forest's documents, by row.
    ends = edges.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    located = saved(signed.select("row", "doc_id", "text_key").join(ends, "row", "left_semi"), "located")
    near, _ = parted(own, ["doc_id", "text_key"], located)
    texts = saved(near.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")).join(located, ["doc_id", "text_key"]).select("row", "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [confirmed(x, width, percent) for x in zip(raw(batch, "text_a"), raw(batch, "text_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "ra", "rb")), pa.array(held, pa.bool_())], names=["a", "b", "ra", "rb", "held"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
        with_both = with_a.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
        return saved(with_both.select("a", "b", "ra", "rb", "text_a", "text_b").mapInArrow(check, "a long, b long, ra long, rb long, held boolean"), name)

    def grouped(links: list[DataFrame], name: str) -> DataFrame:
        return components(reduce(DataFrame.unionByName, (x.select(F.col("ra").alias("a"), F.col("rb").alias("b")) for x in links)), name)

    def placed(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """pairs that groups keep apart, with the groups' names."""
        for side in "ab":
            pairs = pairs.join(groups.select(F.col("node").alias(f"r{side}"), F.col("component").alias(f"c{side}")), f"r{side}", "left").withColumn(f"c{side}", F.coalesce(f"c{side}", f"r{side}"))
        return pairs.where("ca <> cb")

    # An id that several classes hold joins them.
    several = named.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low < high").select(reshuffled("doc_id"))
    of_id = saved(named.select("doc_id", "set_hash").join(several, "doc_id").distinct().join(classes.select("set_hash", "rep"), "set_hash").select("doc_id", "rep").distinct(), "of_id")
    least = of_id.groupBy("doc_id").agg(F.min("rep").alias("rb")).select(reshuffled("doc_id"), "rb")
    same_id = of_id.join(least, "doc_id").where("rep <> rb").select(F.col("rep").alias("ra"), "rb")

    best = edges.groupBy("a").agg(F.max(F.struct("estimate", "b", "ra", "rb")).alias("m")).select("a", "m.b", "m.ra", "m.rb")
    first = verified(best, "first")
    groups = grouped([first.where("held"), same_id], "groups")
    # What the bands' forests join beyond that: the best pair of any two groups.
    apart = placed(edges, groups).join(first.where("NOT held").select("a", "b"), ["a", "b"], "left_anti")
    rest = apart.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(F.max(F.struct("estimate", "a", "b", "ra", "rb")).alias("m")).select("m.a", "m.b", "m.ra", "m.rb")
    second = verified(rest, "second")
    links = [first.where("held"), second.where("held"), same_id]
    if not second.where("held").isEmpty():
        groups = grouped(links, "groups")
    # Bands of more than a pair whose forest still joins two groups are open; a pair has been checked.
    crossed = saved(placed(edges, groups).select("key").distinct(), "open")
    if not members.where("n > 2").join(crossed, "key", "left_semi").isEmpty():
        crossed_members = members.where("n > 2").join(crossed, "key", "left_semi")
        labelled = crossed_members.join(held, "row").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "row", "rep", "n", "n_shingles", chosen, F.coalesce("component", "rep").alias("component"))
        shown = dealt(labelled, "key", n_blocks, "row").withColumn("hub", F.lit(False)).drop("n")
        opened = saved(in_segments(shown, ["key", "low", "high"], propose, edge).select("a", "b", "ra", "rb"), "opened")
        links.append(settled(opened, texts, signed, groups, width, percent))
        groups = grouped(links, "groups")
    discard(shared, keys, members, edges, located, crossed)

    by_set = classes.join(groups, classes["rep"] == groups["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("linked_id"))
    return signed.select("doc_id", "n_shingles", "set_hash").join(by_set, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("linked_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def settled(opened: DataFrame, texts: DataFrame, signed: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """ra, rb: links that join groups.  opened(a, b, ra, rb): a forest of all pairs between groups that pass.

    The forest's trees are families; a family's documents meet in pairs of bounded blocks."""
    rows = opened.select(F.col("a").alias("row"), F.col("ra").alias("rep")).unionAll(opened.select(F.col("b").alias("row"), F.col("rb").alias("rep"))).distinct()
    families = components(opened.select("a", "b"), "families").select(F.col("node").alias("row"), F.col("component").alias("family"))
    sized = saved(rows.join(families, "row").join(signed.select("row", "n_shingles"), "row").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("row", "rep", "family", "n_shingles", F.coalesce("component", "rep").alias("component")), "sized")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")).select(reshuffled("family"), "n_blocks")
    met = dealt(sized.join(blocks, "family"), "family", F.col("n_blocks"), "row").select("family", "low", "high", "block", "row", "rep", "component").join(texts, "row")

    def run(found: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in found:
            table = table.take(np.argsort(table.column("row").to_numpy(), kind="stable")).combine_chunks()
            out = linked(raw(table), table.column("block").to_numpy(), table.column("component").to_numpy(), width, percent)
            if out:
                rep = table.column("rep").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(rep[[x[0] for x in out]]), pa.array(rep[[x[1] for x in out]])], names=["ra", "rb"])

    return saved(in_segments(met, ["family", "low", "high"], run, "ra long, rb long"), "settled")


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: of the group's least id, and of its rows that share
    this id the one whose text has the least hash.  Rows without an id come after all that have one, by their texts."""
    no_id = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("node"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.struct("*").alias("own"))
    found = saved(near_duplicates(whole.select(F.col("node").alias("doc_id"), "own.text"), width, percent).select("doc_id", "kept", F.col("n_shingles") > 0), "kept")
    found = found.toDF("node", "kept", "some")
    # Rows of an id that goes, or that comes back; texts without a word are linked with nothing and stay, each row of them.
    marks = found.where("some").groupBy("node").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).where("NOT kept OR n > 1")
    marks = saved(marks, "marks")
    near, others = parted(whole, ["node"], marks.select("node"))
    blank = ~F.rlike(F.coalesce(F.col("own.text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    met = near.join(marks, "node", "left")
    single = met.where(F.col("kept").isNull() | blank).select("own")
    one = met.where(F.col("kept") & ~blank).groupBy("node").agg(F.min_by("own", F.struct("text_key", F.to_json("own"))).alias("own")).select("own")
    return others.select("own").unionAll(single).unionAll(one).select("own.*")
