"""Token ids of documents in a compressed binary format: static range asymmetric numeral systems.

One frequency table, of all ids of the corpus, serves every block.  A block holds whole documents in ascending id order;
its ids are dealt to LANES interleaved states that a decoder advances together.  Checkpoints (states and stream offset)
inside a block let several readers decode its parts at once; checksums cover the block's bytes and its ids.  Blocks are
independent of each other: `segment` and `first` place them, and any block is read without the others.

The blocks lie in a table of (segment, block, first, n_tokens, payload), the frequencies beside it; both are written and
read by Spark, so any store serves and a lost executor's blocks are written again.

Null texts are empty documents of the end id alone.  Null ids sort first.  Rows that repeat an id each keep their place,
ties by their ids' bytes.  An empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, saved, scratch, slices
from .tokens import Encoder, default_path

SCALE_BITS = 20
LANES = 2048
LOW = np.uint64(1 << 31)
#: Ids after which a block ends at the next document; steps between checkpoints.
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 256
MAGIC = b"SRB1"
HEAD = struct.Struct("<4sIIIQQQ")
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])


class Table:
    """Frequencies scaled to 2**SCALE_BITS, each id that occurs at least 1."""

    def __init__(self, counts: np.ndarray):
        total, size = int(counts.sum()), 1 << SCALE_BITS
        freq = np.where(counts > 0, np.maximum(1, counts * (size / max(total, 1))).astype(np.int64), 0)
        over = int(freq.sum()) - size
        if total and over < 0:
            freq[freq.argmax()] -= over
        while total and over > 0:  # take from the frequent ones what the rare ones were given
            take = np.minimum(freq - 1, np.ceil(freq * (over / freq.sum())).astype(np.int64)).clip(0)
            left = over - np.cumsum(take)
            take = np.where(left >= 0, take, (take + left).clip(0))
            freq -= take
            over -= int(take.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, docs: np.ndarray, t: Table) -> bytes:
    """ids of whole documents, docs: their DOC rows."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    chunks, marks, words = [], [], 0
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        x, f = state[: len(part)], t.freq[part]
        full = (x >> np.uint64(63 - SCALE_BITS)) >= f
        chunk = x[full].astype(np.uint32)
        chunks.append(chunk)
        words += len(chunk)
        x = np.where(full, x >> half, x)
        q = x // f
        state[: len(part)] = (q << bits) + (x - q * f) + t.start[part]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, words, state.copy()))
    stream = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
    body = [HEAD.pack(MAGIC, LANES, CHECKPOINT_STEPS, len(marks), n, len(docs), len(stream)), docs.astype(DOC).tobytes(), state.astype("<u8").tobytes()]
    for step, after, own in marks[::-1]:
        body += [struct.pack("<QQ", step, words - after), own.astype("<u8").tobytes()]
    data = b"".join([*body, stream.astype("<u4").tobytes(), struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))])
    return data + struct.pack("<I", zlib.crc32(data))


class Block:
    """A block's parts; decode() gives its ids, or those from one checkpoint to the next."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum does not hold")
        magic, self.lanes, self.every, n_marks, self.n, n_docs, n_words = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = HEAD.size
        self.docs = np.frombuffer(data, DOC, n_docs, at)
        at += n_docs * DOC.itemsize
        self.marks = [(0, 0, np.frombuffer(data, "<u8", self.lanes, at))]
        at += 8 * self.lanes
        for _ in range(n_marks):
            step, word = struct.unpack_from("<QQ", data, at)
            self.marks.append((step, word, np.frombuffer(data, "<u8", self.lanes, at + 16)))
            at += 16 + 8 * self.lanes
        self.stream = np.frombuffer(data, "<u4", n_words, at)
        self.ids_crc32 = struct.unpack("<I", data[-8:-4])[0]

    def part(self, k: int, t: Table) -> np.ndarray:
        """The ids from checkpoint k to the next, without any other part."""
        step, word, state = self.marks[k]
        end = self.marks[k + 1][0] if k + 1 < len(self.marks) else -(-self.n // self.lanes)
        state, out = state.astype(np.uint64), []
        bits, mask, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
        for s in range(step, end):
            width = min(self.lanes, self.n - s * self.lanes)
            x = state[:width]
            slot = x & mask
            symbol = t.symbol[slot]
            x = t.freq[symbol] * (x >> bits) + slot - t.start[symbol]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << half) | self.stream[word : word + len(need)]
            word += len(need)
            state[:width] = x
            out.append(symbol)
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, t: Table) -> np.ndarray:
        ids = np.concatenate([self.part(k, t) for k in range(len(self.marks))])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.ids_crc32:
            raise ValueError("the checksum of a block's ids does not hold")
        return ids


def table_of(df: DataFrame) -> Table:
    """At most one row for each id of the vocabulary reaches the driver."""
    rows = df.select("id", "n").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(counts)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Writes the ids of docs(doc_id, text), each document's followed by end_id, under path."""
    tokenizer = tokenizer or default_path()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' ids; and a task's count of each id, as a last row with a null width."""
        encoder = Encoder.of(tokenizer)
        size = max(encoder.size, end_id + 1)
        narrow, total = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, np.int64)
        names = ["doc_id", "ids", "width"]
        for batch in slices(batches):
            ids = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            total += np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=size)
            total[end_id] += len(ids)
            packed = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(narrow).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array([narrow.itemsize] * len(ids), pa.int32())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary()), pa.array([None], pa.int32())], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum((np.frombuffer(x, "<i8") for x in batch.column("ids").to_pylist()), np.zeros(0, np.int64) if not batch.num_rows else 0)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    written = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise, "doc_id long, ids binary, width int"), "ids")
    tokens = written.where("width IS NOT NULL")
    counts = written.where("width IS NULL").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/frequencies")
    shared = docs.sparkSession.sparkContext.broadcast(table_of(docs.sparkSession.read.parquet(f"{path}/frequencies")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, block, first, held, rows = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload = encode_block(ids, np.array(rows, DOC), shared.value)
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["segment", "block", "first", "n_tokens", "payload"])

        size = 0
        for batch in slices(batches, "ids"):
            for doc_id, x, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                ids = np.frombuffer(x, f"<u{width}")
                held.append(ids)
                rows.append((doc_id or 0, doc_id is None, len(ids)))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    block, first, size, held, rows = block + 1, first + size, 0, [], []
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(pack, "segment int, block int, first long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(written)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit little-endian) of the documents
    under path."""
    shared = spark.sparkContext.broadcast(table_of(spark.read.parquet(f"{path}/frequencies")))
    names = ["segment", "doc_id", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 1):
            for segment, first, payload in zip(*(batch.column(c).to_pylist() for c in ("segment", "first", "payload")), strict=True):
                block = Block(payload)
                data, n = memoryview(block.decode(shared.value).astype("<u4")).cast("B"), block.docs["n"].astype(np.int64)
                ends = np.cumsum(n)
                parts = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array([segment] * len(n), pa.int32()), pa.array(block.docs["id"], pa.int64(), mask=block.docs["null"].astype(bool)), pa.array(first + ends - n), pa.array(n), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                if with_ids:
                    columns.append(pa.array(map(bytes, parts), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = spark.read.parquet(f"{path}/blocks")
    # One row a segment: as many as the write had partitions.
    bases = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).select("segment", F.coalesce(F.sum("n").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = blocks.select("segment", "first", "payload").mapInArrow(unpack, "segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.join(F.broadcast(bases), "segment").select("doc_id", (F.col("base") + F.col("local")).alias("start"), *names[3:])


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs' ids to a new place in the shared folder and reads back where each document lies, and its checksum."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)
