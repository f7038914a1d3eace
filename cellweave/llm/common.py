"""Helpers shared by the operators: shared storage, bounded label samples, Arrow slices."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step holds at a time.
CHUNK_BYTES = 4 << 20
#: Bytes of files that one part of a dealt table gets at most.
PART_BYTES = 256 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/cellweave-checkpoints"


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts to deal df to: those of the session, more if its files are too large for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Without statistics Spark takes a size beyond any real one.
    known = size if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // part_bytes))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The folder is removed when the JVM closes its file systems.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/cellweave-{uuid.uuid4().hex}"
    df.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{top}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{top}/{name}")


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)).cast(pa.int64()), 0)).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def bounded_labels(labels: DataFrame, target: str, limit: int) -> DataFrame:
    """One row per labelled doc_id: the least label, at most about `limit` rows chosen by a hash of doc_id.

    The choice looks at doc_id alone, so it is the same on every run and in any partitioning.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min(target).cast("int").alias("label"))
    n = known.count()
    if n <= limit:
        return known
    return known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
