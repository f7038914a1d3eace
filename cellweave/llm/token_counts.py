"""Token counts without materialised ids.

Each distinct pre-token is counted once by a worker; a document's count is the sum over its
pre-token frequencies, whatever the script; no list of a document's ids is made. The frequency table of one document lives in one task and is joined to the
worker's piece-count table there, so nothing is shuffled and no hot word meets in one place.

Nulls: a null text counts as empty (0 bytes, 0 tokens), a null doc_id is passed through. Repeated
rows each get a row. Further columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import slices
from cellweave.llm.pretoken import table

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of docs (doc_id, text), by the tokenizer file at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(path, counts_only=True)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(pieces.count_many(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
