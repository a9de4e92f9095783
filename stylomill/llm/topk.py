"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors lie in blocks of BLOCK; a block keeps one list for each dimension, sorted by component.  For a query the lists are
walked together, from the high end where the query's component is positive and from the low end where it is negative;
vectors met for the first time are scored whole.  The walk ends once the bound of any vector not yet met, the sum of query
component times the list's value at the present depth, is below the kth best score known.

What is known passes from block to block: a first walk over SEEDS vectors gives every query a kth score, and a task takes
its blocks one after another with the best scores met so far, so a block whose bound is below at depth 0 costs nothing.
Vectors are dealt to blocks by the nearest of CELLS centres (of a bounded sample; they steer the order of work, never a
result), which keeps a block's lists narrow; a centre that attracts many vectors is spread over many blocks.  Queries come
in slices of QUERY_BYTES, each broadcast to one pass over the blocks.

Vectors that are null or hold a null or non-finite component take no part, as query or candidate; nor do rows with a null
id.  A row is no candidate for the query of its own id.  Rows that repeat an id with the same vector count once; with
other vectors, the id's best score counts.  Ties go to the smaller id.  Vectors shorter than the longest are filled up
with zeros.  Scores must fit 64 bits.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, saved

#: Vectors of a block.
BLOCK = 4096
#: Vectors that give the first bounds.
SEEDS = 8192
#: Bytes of the queries of one pass.
QUERY_BYTES = 16 << 20
#: Vectors of a partition at most, centres, and vectors that the centres are learned from.
PARTITION = 1 << 16
CELLS = 64
CELL_SAMPLE = 4096
LEAST = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


class Lists:
    """A block's vectors with their sorted per-dimension lists.  kind: float64 where all sums stay exact in it, else int64."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type = np.int64):
        self.ids, self.vectors = ids, vectors.astype(kind)
        self.order = np.argsort(vectors, axis=0, kind="stable")  # each column a list, ascending
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.walked = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no vector of the block can beat, for each query."""
        return np.maximum(queries, 0) @ self.values[-1] + np.minimum(queries, 0) @ self.values[0]

    def bound(self, q: np.ndarray, up: np.ndarray, depth: int) -> float:
        """What no vector beyond the first `depth` entries of the lists can beat."""
        return (np.where(up, self.values[len(self.ids) - depth], self.values[depth - 1]) * q).sum()

    def last_depth(self, q: np.ndarray, up: np.ndarray, least: float) -> int:
        """The least depth whose bound is below `least`, or the lists' length."""
        low, high = 1, len(self.ids)
        while low < high:
            middle = (low + high) // 2
            if self.bound(q, up, middle) < least:
                high = middle
            else:
                low = middle + 1
        return low

    def top(self, q: np.ndarray, own: int, k: int, known: tuple[np.ndarray, np.ndarray] | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of these vectors and the known ones, own excluded, ties to the smaller id.

        least: a score that the kth best of all vectors reaches; what is below is left out."""
        n = len(self.ids)
        up = q >= 0
        seen = np.zeros(n, bool)
        best_s, best_i = known if known is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.walked += 1
        depth, step = 0, max(8, k)
        used = np.flatnonzero(q)
        if not len(used):
            used = np.arange(min(1, len(q)))
        high, low = used[up[used]], used[~up[used]]
        while depth < n:
            kth = max(least, int(best_s[-1])) if len(best_s) == k else least
            last = n if kth == LEAST else self.last_depth(q, up, kth)
            to = min(n, last if last <= depth + 2 * step else depth + step)
            if depth and last <= depth:
                break
            fresh = np.zeros(n, bool)
            fresh[self.order[n - to : n - depth, high]] = True
            fresh[self.order[depth:to, low]] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            scores = (self.vectors[new] @ q).astype(np.int64)
            good = (scores >= kth) & (self.ids[new] != own)
            if good.any():
                scores, ids = np.concatenate([best_s, scores[good]]), np.concatenate([best_i, self.ids[new[good]]])
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                _, first = np.unique(ids, return_index=True)  # an id that comes back counts once, by its best score
                keep = np.sort(first)[:k]
                best_s, best_i = scores[keep], ids[keep]
            depth, step = to, step * 2
        return best_s, best_i


def centres(rows: np.ndarray) -> np.ndarray:
    """Some rounds of k-means on a bounded sample."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    rows = rows.astype(np.float64)
    out = rows[np.linspace(0, len(rows) - 1, min(CELLS, len(rows))).astype(int)]
    for _ in range(4):
        cell = nearest(rows, out)
        n = np.bincount(cell, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, cell, rows)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def nearest(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (rows.astype(np.float64) @ at.T - (at * at).sum(axis=1) / 2).argmax(axis=1)


def exact_top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best for every row whose id is divisible by `every`, by the inner product of
    floor(scale * x)."""
    spark = vectors.sparkSession
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("id").isNotNull()
    whole = saved(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(usable)
        .select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v")),
        "vectors",
    )
    largest = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    n, width, most = whole.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
    if not n or not width:
        n, width, most = max(n, 1), max(width or 0, 1), most or 0
    kind = np.float64 if most * most * width < 1 << 53 else np.int64
    small = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    whole = whole.select("id", F.col("v").cast(f"array<{small}>").alias("v"))

    def sample(most_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """A bounded sample: so many rows at most."""
        rows = whole.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n // (2 * most_rows)))) == 0).limit(most_rows).toArrow()
        return rows.column("id").to_numpy(), matrix(rows.column("v"), width) if rows.num_rows else np.zeros((0, width), np.int64)

    seeds = spark.sparkContext.broadcast(sample(SEEDS))
    at = spark.sparkContext.broadcast(centres(sample(CELL_SAMPLE)[1]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(matrix(batch.column("v"), width), at.value), pa.int32())], names=["id", "v", "cell"])

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = seeds.value
        lists = [Lists(ids[a : a + BLOCK], rows[a : a + BLOCK], kind) for a in range(0, len(ids), BLOCK)]
        for batch in batches:
            least = []
            for query_id, q in zip(batch.column("id").to_pylist(), matrix(batch.column("v"), width).astype(kind), strict=True):
                best = None
                for x in lists:
                    best = x.top(q, query_id, k, best)
                least.append(int(best[0][-1]) if best is not None and len(best[0]) == k else LEAST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["id", "v", "least"])

    queries = saved(whole.where(F.pmod("id", F.lit(every)) == 0).distinct().mapInArrow(first_bounds, f"id long, v array<{small}>, least long"), "queries")
    n_slices = max(1, math.ceil(queries.count() * width * 8 / QUERY_BYTES))
    n_parts = max(math.ceil(n / PARTITION), min(math.ceil(n / BLOCK), 2 * spark.sparkContext.defaultParallelism))
    spot = F.xxhash64("id").alias("spot")
    blocks = saved(whole.mapInArrow(placed, f"id long, v array<{small}>, cell int").select("id", "v", "cell", spot).repartitionByRange(n_parts, "cell", "spot").sortWithinPartitions("cell", "spot").select("id", "v"), "blocks")

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, rows, least = shared.value
            rows = rows.astype(kind)
            best = {}
            for ids, block in chunks(batches, width):
                lists = Lists(ids, block, kind)
                bounds = lists.bounds(rows)
                kth = least.copy()
                for j, found in best.items():
                    if len(found[0]) == k:
                        kth[j] = max(kth[j], found[0][-1])
                for j in np.flatnonzero(bounds >= kth).tolist():
                    found = lists.top(rows[j], query_ids[j], k, best.get(j), int(least[j]))
                    if len(found[0]):
                        best[j] = found
            for part in np.array_split(np.array(list(best), np.int64), max(1, len(best) // 1024)):
                if len(part):
                    each = [best[j] for j in part.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[part], [len(s) for s, _ in each])), pa.array(np.concatenate([i for _, i in each])), pa.array(np.concatenate([s for s, _ in each]))], names=["query_id", "vec_id", "score"])

        return blocks.mapInArrow(run, FOUND)

    parts = []
    for s in range(n_slices):
        own = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(n_slices)) == s).toArrow()
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), matrix(own.column("v"), width) if own.num_rows else np.zeros((0, width), np.int64), own.column("least").to_numpy()))
        parts.append(saved(search(shared), f"found-{s}"))
        shared.destroy()
    discard(blocks, queries)
    each = reduce(DataFrame.unionAll, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of BLOCK rows each, fewer in the last."""
    ids, rows, n = [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            ids.append(part.column("id").to_numpy())
            rows.append(matrix(part.column("v"), width))
            n += part.num_rows
            while n >= BLOCK:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                yield all_ids[:BLOCK], all_rows[:BLOCK]
                ids, rows, n = [all_ids[BLOCK:]], [all_rows[BLOCK:]], n - BLOCK
    if n:
        yield np.concatenate(ids), np.concatenate(rows)
