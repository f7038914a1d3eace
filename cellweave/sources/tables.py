"""Tables: csv, tsv, xlsx, parquet; object, profile and link tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.names import col

READERS = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".parquet": "parquet", ".xlsx": "xlsx"}


def suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark would read it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix; csv and tab files have a header, and without a schema their types are inferred."""
    kind = READERS.get(suffix(path))
    if kind is None:
        raise ValueError(f"no reader for tables of kind {suffix(path) or path!r}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if kind == "xlsx":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    reader = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """By suffix: csv, tsv, json or parquet; an existing path is never replaced."""
    kind = suffix(path)
    writer = df.write.mode("errorifexists")
    if kind == ".parquet":
        writer.parquet(path)
    elif kind == ".json":
        bad = [c for c, t in df.dtypes if t in ("double", "float")]
        if bad and not df.where(" OR ".join(f"isnan(`{c}`) OR abs(`{c}`) = double('infinity')" for c in bad)).isEmpty():
            raise ValueError("JSON cannot hold NaN or infinity")
        writer.json(path)
    elif kind in (".csv", ".tsv", ".txt"):
        writer.option("header", True).option("sep", "," if kind == ".csv" else "\t").csv(path)
    else:
        raise ValueError(f"no writer for tables of kind {kind or path!r}")


def link_pairs(table: DataFrame, index: str | None = None) -> list[tuple[str, str]]:
    """(object variable, scalar variable) of the positive cells of a 0/1 matrix, column by column."""
    index = index or table.columns[0]
    rows = table.collect()  # one row for each object of a map
    return [(str(r[index]), c) for c in table.columns if c != index for r in rows if r[c] is not None and float(r[c]) > 0]


def label_links(matrix: Sequence[Sequence[float]], objects: Sequence[int], object_map: int = 1, scalar_map: int = 1) -> list[tuple[str, str]]:
    """Links of an unlabelled 0/1 matrix: rows are the objects in order, columns the channels 1..n."""
    if len(matrix) != len(objects) or len({len(r) for r in matrix}) > 1:
        raise ValueError("link matrices have a row for each object and rows of one length")
    width = len(matrix[0]) if matrix else 0
    return [(f"O{object_map}.{o}", f"S{scalar_map}.{c + 1}") for c in range(width) for o, row in zip(objects, matrix, strict=True) if row[c] > 0]


def profile_by_coordinates(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """Profile rows renumbered by the label at their one-based X, Y[, Z] in a voxel table (x, y, z, value); the last row of a label wins."""
    place = {"x": "X", "y": "Y"} | ({"z": "Z"} if "Z" in profile.columns else {})
    at = profile.select(*profile.columns, *((col(c) - 1).cast("long").alias(f"__{a}") for a, c in place.items()))
    spots = labels.select(*(F.col(a).alias(f"__{a}") for a in place), F.col("value").cast("long").alias("__label"))
    hit = at.join(spots, [f"__{a}" for a in place]).where("__label <> 0")
    last = Window.partitionBy("__label").orderBy(F.desc("Object"))
    best = hit.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return best.withColumn("Object", F.col("__label")).select(*profile.columns).orderBy("Object")


def profile_by_counts(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """Profile rows renumbered by matching their unique Count to the voxels of a label, or to its pieces if the counts are fewer."""
    live = labels.where("value <> 0")
    if profile.select("Count").distinct().count() != profile.count():
        raise ValueError("objects of equal counts cannot be told apart by them")
    if profile.agg(F.sum("Count")).first()[0] < live.count():
        from cellweave.operators.patches import wide_components

        pieces = wide_components(live.select("x", "y", "z", F.col("value").cast("long").alias("value")), ["value"]).select("value", "component").distinct()
        sizes = pieces.groupBy(F.col("value").alias("__label")).agg(F.count("*").alias("Count"))
    else:
        sizes = live.groupBy(F.col("value").cast("long").alias("__label")).agg(F.count("*").alias("Count"))
    out = profile.withColumn("Count", F.col("Count").cast("long")).join(sizes, "Count")
    if out.count() != profile.count():
        raise ValueError("an object of the image has no such count in the profile")
    return out.withColumn("Object", F.col("__label")).select(*profile.columns).orderBy("Object")


def load_table(spark: SparkSession, path: str, kind: str, labels: DataFrame | None = None) -> DataFrame | list[tuple[str, str]]:
    """kind L: link pairs; O: an object table, Z = 1 if it has none; P: a profile by Object, matched to an image's labels if given."""
    table = read_table(spark, path)
    if kind == "L":
        return link_pairs(table)
    if kind == "O":
        if "Z" not in table.columns:
            names = table.columns
            table = table.withColumn("Z", F.lit(1.0)).select(*map(col, [*names[:2], "Z", *names[2:]]))
        return table
    if kind == "P":
        if labels is None:
            return table.orderBy("Object")
        return profile_by_coordinates(table, labels) if {"X", "Y"} <= set(table.columns) else profile_by_counts(table, labels)
    raise ValueError("table_type must be L, O or P")


def load_coordinate_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose x and y (any case) are numbers without gaps."""
    table = read_table(spark, path)
    from cellweave.operators.census import coordinate_columns

    axes = coordinate_columns(table.columns)
    kinds = dict(table.dtypes)
    if any(kinds[a] not in ("int", "bigint", "float", "double") for a in axes) or not table.where(" OR ".join(f"`{a}` IS NULL" for a in axes)).isEmpty():
        raise ValueError("a coordinate is missing or no number")
    return table


