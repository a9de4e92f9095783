"""What the training-data operators share: scratch tables, Arrow slices, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, scratch

#: Bytes of text that a Python worker unpacks at a time (one longer text makes a slice of its own).
SLICE_BYTES = 4 << 20
#: The same where a slice's arrays are many times its text.
SMALL_SLICE_BYTES = 1 << 20
#: Bits of one row of a bit map (what bitmap_construct_agg makes), and rows of a map at most: 16 MB.
ROW_BITS = 1 << 15
MAP_ROWS = 1 << 12
#: Edges that are contracted at a time.
CONTRACTED = 1 << 18

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def reshuffled(key: str) -> Column:
    """The key under an expression that hides its partitioning, so that a join exchanges both of its sides and adaptive execution can split a hot key."""
    return F.shiftright(F.col(key), 0).alias(key)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice's text stays near `most` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def parted(df: DataFrame, on: list[str], keys: DataFrame, key_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose columns `on` may be among keys, rows whose columns surely are not), without a shuffle of df.

    A bit map of the keys' hashes, sized by their number up to MAP_ROWS rows, is broadcast.  What it lets through by chance
    must be sorted out by the join that follows; with very many keys that is more, and results stay the same.  JVM only."""
    n = keys.agg(F.approx_count_distinct(F.xxhash64(*(key_columns or on)))).first()[0]
    rows, name = 1, f"map_{uuid.uuid4().hex}"
    while rows < MAP_ROWS and rows * ROW_BITS < 16 * n:
        rows *= 2

    def spot(columns: list[str]) -> tuple[Column, Column]:
        h = F.xxhash64(*columns)
        return F.shiftright(h, 15).bitwiseAND(F.lit(rows - 1)), h.bitwiseAND(F.lit(ROW_BITS - 1))

    row, bit = spot(key_columns or on)
    bits = saved(keys.select(row.alias(f"{name}_row"), bit.alias("bit")).groupBy(f"{name}_row").agg(F.bitmap_construct_agg("bit").alias(f"{name}_bits")), "bits")
    row, bit = spot(on)
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = df.withColumn(f"{name}_row", row).join(F.broadcast(bits), f"{name}_row", "left").withColumn(f"{name}_in", inside)
    some, none = (marked.where(F.col(f"{name}_in") == x).select(*(F.col(f"`{c}`") for c in df.columns)) for x in (True, False))
    return some, none


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars: of CONTRACTED edges at a time, each node with the least that it reaches in them."""

    def stars(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in edges:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        found = [(x, top(x)) for x in list(root)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found if x[0] != x[1]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches; a written table.

    Tasks contract their edges to stars; once CONTRACTED edges at most are left, a bounded number, one task ends the work.
    Till then alternating large-star and small-star steps (Kiveris et al., 2014) bring them together; each round is a
    written table.  Only two numbers a round reach the driver.  Null ends, loops and repeated edges are ignored."""

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(reshuffled("a"), F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(reshuffled("a"), "m")
        joined = e.join(least, "a")
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()

    # Only the last round's table is left when it ends.
    star = "a long, b long"
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = saved(own.mapInArrow(contracted, star), f"{name}-0")
    seen, turn = None, 0
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        turn += 1
        before = state
        if now[0] <= CONTRACTED:
            state = saved(state.coalesce(1).mapInArrow(contracted, star), f"{name}-{turn}")
            discard(before)
            break
        seen = now
        large = saved(stars(state), f"{name}-{turn}-large")
        state = saved(small(large), f"{name}-{turn}")
        discard(before, large)
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
