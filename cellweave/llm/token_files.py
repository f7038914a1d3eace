"""Token ids in Parquet list columns, written for selective reads.

Format: one row per document in ascending doc_id order: doc_id, part (the file's place in that
order), part_start (ids before it in its file), n_tokens (with the end id) and ids list<int32>. Ids are
dictionary encoded in small pages (bit-packed), falling back to delta encoding (format v2); the
counters are delta encoded without dictionaries. Row groups and pages are small and page indexes are
written, so readers fetch metadata columns alone, or the pages of a doc_id range.

Documents are dealt by ranges of (doc_id, hash of the text), so copies of one doc_id still split.
Nulls: null doc_ids come first; a null text is empty and holds only the end id. Repeated rows are
separate documents; equal doc_ids are ordered by a hash of the text, then the text, so the files are the same
on every run. An empty table writes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import parts_for, slices, write_table
from cellweave.llm.packing import with_offsets
from cellweave.llm.pretoken import table

FILES = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Writer settings: small row groups and pages, dictionaries for ids alone, the delta-capable format version.
WRITER = {
    "compression": "zstd",
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": 1 << 20,
}


def ordered_ids(docs: DataFrame, path: str, end_id: int, partitions: int) -> DataFrame:
    """The rows of the files: documents in doc_id order, tokenized after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = table(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in slices(batch, 1):
                flat, sizes = encoder.encode_many([t or "" for t in cut.column(1).to_pylist()])
                with_end = np.insert(flat, np.cumsum(sizes), end_id).astype(np.int32)
                sizes = sizes + 1
                stops = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(with_end))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + stops - sizes), pa.array(sizes), ids], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                before += int(stops[-1])

    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) h").repartitionByRange(partitions, "doc_id", "h")
    return dealt.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, FILES)


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Write the files in the shared folder and return them as a DataFrame (doc_id, part, part_start, n_tokens, ids)."""
    partitions = partitions or parts_for(docs)
    return write_table(ordered_ids(docs, path, end_id, partitions), "token_files", **WRITER)


def with_starts(files: DataFrame) -> DataFrame:
    """files with start, the ids of all documents before each; the totals come from the metadata columns alone."""
    return with_offsets(files, "n_tokens").withColumn("start", F.col("part_offset") + F.col("part_start"))


def metadata(files: DataFrame) -> DataFrame:
    """doc_id and n_tokens of all documents: no page of ids is read."""
    return files.select("doc_id", "n_tokens")


def ids_between(files: DataFrame, low: int, high: int) -> DataFrame:
    """doc_id and ids of the documents of a range of doc_ids (ends included): other row groups and pages are passed over."""
    return files.where(F.col("doc_id").between(low, high)).select("doc_id", "ids")


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32 as read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_starts(files).select("doc_id", "start", "n_tokens", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
