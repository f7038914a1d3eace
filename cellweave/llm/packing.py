"""Packing by concatenating and cutting.

Pass one tokenizes each document once and stores its ids (little-endian unsigned 32-bit, ended by
`end_id`) in a table in the shared folder, with the task that wrote it and the ids before it in that
task. The totals of the tasks, one small row each, give every task's global offset by a prefix sum.
Pass two is plain expressions: a document that starts at global offset g covers windows
g div w .. (g + n - 1) div w, and a boundary record is cut for each.

Every sequence but the last is full, so padding is less than one window for the whole corpus.

Nulls: a null text is empty and still yields its end id; a null doc_id is passed through. Repeated
rows are separate documents. Empty input gives no pieces. A text of any length becomes many pieces;
the work is in proportion to its length. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import checkpoint, slices, write_table
from cellweave.llm.pretoken import table

TOKENS = "doc_id long, part int, before long, n long, ids binary"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of each document with its place in the task that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = table(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in slices(batch, 1):
                flat, sizes = encoder.encode_many([t or "" for t in cut.column(1).to_pylist()])
                stops = np.cumsum(sizes)
                with_end = np.insert(flat, stops, end_id).astype("<u4")
                sizes = sizes + 1
                stops = np.cumsum(sizes)
                offsets = np.concatenate([[0], stops * 4]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(with_end)])
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + stops - sizes), pa.array(sizes), blob], names=["doc_id", "part", "before", "n", "ids"])
                before += int(stops[-1])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, TOKENS)


#: Tasks up to which their offsets (two longs each) are broadcast; beyond, the join shuffles.
BROADCAST_PARTS = 100_000


def with_offsets(tokens: DataFrame, size: str) -> DataFrame:
    """tokens (part, ...) with part_offset, the sum of `size` over all earlier parts.

    Totals have one row per task that wrote tokens, so the window over them is small.
    """
    totals = checkpoint(tokens.groupBy("part").agg(F.sum(size).alias("total")))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("part_offset"))
    return tokens.join(F.broadcast(offsets) if totals.count() <= BROADCAST_PARTS else offsets, "part")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of docs (doc_id, text).

    ids holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    tokens = write_table(tokenize(docs, path, end_id), "tokens", compression="zstd")
    placed = with_offsets(tokens, "n").withColumn("g", F.col("part_offset") + F.col("before"))
    w = F.lit(window).cast("long")

    def piece(sequence: F.Column) -> F.Column:
        start = F.greatest(sequence * w - F.col("g"), F.lit(0).cast("long"))
        stop = F.least((sequence + 1) * w - F.col("g"), F.col("n"))
        return F.struct(
            start.alias("start"),
            (stop - start).alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
            sequence.alias("sequence_id"),
            (F.col("g") + start - sequence * w).alias("offset"),
        )

    first, last = F.expr(f"g div {window}"), F.expr(f"(g + n - 1) div {window}")
    pieces = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
