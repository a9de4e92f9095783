"""Cost-balanced packing of token ids into sequences of bounded length.

A piece of n ids costs LINEAR * n + QUADRATIC * n * n (projections and attention).  A task packs its documents in lots of
LOT_IDS ids or LOT_DOCS documents: whole sequences are cut off documents that reach the capacity; the rest go, in descending
length, each whole to the sequence of lowest cost that has room for it.  A lot opens as many sequences as its rest fills;
only what finds no room whole is cut, to fill them up to SLACK ids, and what is over waits for the next lot.  After the
last lot it goes to sequences of powers of two, which need no padding.  There is no shuffle and no state beyond one lot.

Null texts are documents of the end id alone; null ids are kept.  Rows that repeat an id are packed each by itself.  Long
texts are cut at the capacity.  Of equal lengths the document that comes first is placed first, of equal costs the first
sequence takes it.  An empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, slices
from .tokens import Encoder, default_path

LINEAR = 1.0
QUADRATIC = 1.0 / 1024
LOT_IDS = 1 << 21
LOT_DOCS = 1 << 16
#: Pieces that a worker remembers while it packs.
REMEMBERED = 150_000
#: Ids of padding that a sequence may be left with before a document is cut to fill it.
SLACK = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def filled(rest: list[tuple[int, int, int]], sizes: list[int], slack: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset) of the stretches rest (length, document, start) in sequences of
    these sizes, and the stretches that are left."""
    out, waiting = [], []
    size, room, spent = np.array(sizes), np.array(sizes), np.zeros(len(sizes))

    def put(s: int, n: int, k: int, at: int) -> None:
        out.append((k, at, n, s, int(size[s] - room[s])))
        room[s] -= n
        spent[s] += cost(n)

    for n, k, at in sorted(rest, key=lambda x: (-x[0], x[1], x[2])):
        s = int(np.argmin(np.where(room >= n, spent, np.inf)))
        if room[s] >= n:
            put(s, n, k, at)
        else:
            waiting.append((-n, k, at))
    heapq.heapify(waiting)
    for s in np.argsort(-room, kind="stable").tolist():
        while waiting and room[s] > slack:
            n, k, at = heapq.heappop(waiting)
            take = min(-n, int(room[s]))
            put(s, take, k, at)
            if take < -n:
                heapq.heappush(waiting, (n + take, k, at + take))
    return out, [(-n, k, at) for n, k, at in waiting]


def assign(lengths: list[int], capacity: int, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; and the stretches (length, document,
    start), fewer ids than the capacity in all, that wait for the next lot, none if this is the last."""
    out, n_seq, rest = [], 0, []
    for k, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((k, at, capacity, n_seq, 0))
            n_seq, at = n_seq + 1, at + capacity
        if n > at:
            rest.append((n - at, k, at))
    while rest:
        total = sum(x[0] for x in rest)
        if total >= capacity:
            sizes, slack = [capacity] * (total // capacity), SLACK
        elif last:
            sizes, slack = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total >> b & 1], 0
        else:
            break
        found, rest = filled(rest, sizes, slack)
        out += [(k, at, n, n_seq + s, offset) for k, at, n, s, offset in found]
        n_seq += len(sizes)
    return out, rest


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 1, lot_ids: int = LOT_IDS, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text), each document's ids followed by end_id; with_ids adds each piece's ids."""
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, REMEMBERED), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        #: Of each stretch its document, ids, place in the document, and the document's number of ids.
        held: list[tuple[int | None, bytes, int, int]] = []

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal first, held
            pieces, rest = assign([len(x) // 4 for _, x, *_ in held], capacity, last)
            data = [held[k][1][4 * at : 4 * (at + n)] for k, at, n, _, _ in pieces]
            columns = [
                pa.array([held[p[0]][0] for p in pieces], pa.int64()),
                pa.array([held[p[0]][2] + p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array(list(map(zlib.crc32, data)), pa.int64()),
                pa.array([held[p[0]][3] for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([cost(p[2]) for p in pieces], pa.float64()),
            ]
            first += max((p[3] for p in pieces), default=-1) + 1
            held = [(held[k][0], held[k][1][4 * at : 4 * (at + n)], held[k][2] + at, held[k][3]) for n, k, at in rest]
            return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())][: 8 + with_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"][: 8 + with_ids])

        size = 0
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                held.append((doc_id, ids + end, 0, len(ids) // 4 + 1))
                size += len(ids) // 4 + 1
                if size >= lot_ids or len(held) >= LOT_DOCS:
                    yield flush(False)
                    size = sum(len(x) // 4 for _, x, *_ in held)
        if held:
            yield flush(True)
        encoder.forget()  # the worker serves other operators next

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
