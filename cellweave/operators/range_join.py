"""Range, nearest, interval and as-of joins as equi-joins on cells.

A plain theta join would be a nested loop; here both sides get a grid cell, one side is copied to the
cells its range touches, and an exact test follows. Work is in proportion to rows per cell, and adaptive
execution splits hot cells, as the join is an ordinary shuffled one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.volumes import three
from cellweave.plans.random_plan import materialize

AXES = ("x", "y", "z")


def _cells(axes: Sequence[str], size: float | Column) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"__c{a}") for a in axes]


def ball_join(centers: DataFrame, points: DataFrame, radius: float, axes: Sequence[str] = AXES, prefix: str = "p_") -> DataFrame:
    """Every (center, point) at a distance of at most radius; columns of points get `prefix`, and d2 the squared distance."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    steps = F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip(axes, offset, strict=True))) for offset in itertools.product((-1, 0, 1), repeat=len(axes))))
    left = centers.select("*", *_cells(axes, radius)).withColumn("__o", F.explode(steps))
    left = left.select(*centers.columns, *((F.col(f"__c{a}") + F.col(f"__o.{a}")).alias(f"__c{a}") for a in axes))
    right = points.select(*(F.col(c).alias(prefix + c) for c in points.columns), *_cells(axes, radius))
    d2 = sum(((F.col(a) - F.col(prefix + a)) * (F.col(a) - F.col(prefix + a)) for a in axes), F.lit(0.0))
    cells = [f"__c{a}" for a in axes]
    return left.join(right, cells).drop(*cells).withColumn("d2", d2).where(F.col("d2") <= F.lit(float(radius) * float(radius)))


def lattice_join(centers: DataFrame, voxels: DataFrame, radii: Sequence[float], prefix: str = "p_") -> DataFrame:
    """Every (center, voxel) with the voxel in the center's closed ellipsoid, both on the integer lattice x, y, z."""
    reach = three(radii)
    left = centers
    for a, r in zip(AXES, reach, strict=True):
        left = left.withColumn(f"__d{a}", F.explode(F.sequence(F.lit(-math.floor(r)), F.lit(math.floor(r)))))
    # The offsets are made row by row, so a plan does not grow with the ellipsoid.
    square = sum(((F.col(f"__d{a}") / F.lit(float(r))) * (F.col(f"__d{a}") / F.lit(float(r))) for a, r in zip(AXES, reach, strict=True)), F.lit(0.0))
    left = left.where(F.sqrt(square) <= 1).select(*centers.columns, *((F.col(a) + F.col(f"__d{a}")).cast("long").alias(prefix + a) for a in AXES))
    right = voxels.select(*(F.col(c).cast("long").alias(prefix + c) if c in AXES else F.col(c).alias(prefix + c) for c in voxels.columns))
    return left.join(right, [prefix + a for a in AXES])


def interval_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of a and b with equal keys whose half-open intervals overlap, with the overlap's start and end.

    Both sides are copied to the blocks of `width` that they touch; a pair counts in the block where its
    overlap begins, so no pair doubles and none is lost.
    """
    joined = _blocks(a, a_range, width).join(_blocks(b, b_range, width), [*keys, "__b"])
    start, end = F.greatest(F.col(a_range[0]), F.col(b_range[0])), F.least(F.col(a_range[1]), F.col(b_range[1]))
    joined = joined.withColumn("overlap_start", start).withColumn("overlap_end", end).where("overlap_start < overlap_end")
    return joined.where(F.floor(F.col("overlap_start") / width) == F.col("__b")).drop("__b")


def _blocks(df: DataFrame, span: tuple[str, str], width: float) -> DataFrame:
    low, high = F.floor(F.col(span[0]) / width), F.greatest(F.ceil(F.col(span[1]) / width) - 1, F.floor(F.col(span[0]) / width))
    return df.withColumn("__b", F.explode(F.sequence(low.cast("long"), high.cast("long"))))


#: Rows of b in a list; rows of a, and lists, that meet in one task; cells whose shares are sent to every task.
LIST, MEET, MAX_CELLS = 128, 50_000, 100_000


def interval_join_alike(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """The rows of interval_join, for tables of which many rows have the same keys and interval; b has more columns than those.

    Rows of b with the same keys and interval are gathered in lists of bounded length, lists are joined and opened last. A
    list then repeats for each row of a that it meets, and columnar files keep such runs in a fraction of the space of pairs
    in any order. Tasks grow in number with a, and blocks of many rows are dealt in shares, so that the dictionaries
    of a file hold few enough rows of a to stay in use.
    """
    a, b = a.dropna(subset=list(a_range)), b.dropna(subset=list(b_range))  # greatest and least would pass over a missing end
    same, at, cell = [*keys, *b_range], [*keys, "__b"], [*keys, "__b", "__p", "__q"]
    rest = [c for c in b.columns if c not in same]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(*rest))
    lists = b.withColumn("__n", F.floor((number - 1) / LIST)).groupBy(*same, "__n").agg(F.collect_list(F.struct(*rest)).alias("__list"))
    a, lists = _blocks(a, a_range, width), _blocks(lists, b_range, width)
    cells = a.groupBy(*at).agg(F.count("*").alias("n")).join(lists.groupBy(*at).agg(F.count("*").alias("m")), at)
    cells = materialize(cells.select(*at, "n", F.ceil(F.col("n") / MEET).alias("__i"), F.ceil(F.col("m") / MEET).alias("__j")))
    found = cells.agg(F.count("*").alias("cells"), F.sum(F.col("n") * F.col("__j")).alias("rows")).first()
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-(found["rows"] or 0) // MEET))
    cells = F.broadcast(cells.drop("n")) if found["cells"] <= MAX_CELLS else cells.drop("n")

    def dealt(df: DataFrame, own: str, shares: str, other: str, copies: str) -> DataFrame:
        df = df.withColumn("__h", F.xxhash64(*df.columns)).join(cells, at).withColumn(own, F.pmod("__h", shares))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
        return df.drop("__h", "__i", "__j").repartition(tasks, *cell)

    joined = dealt(lists, "__q", "__j", "__p", "__i").join(dealt(a, "__p", "__i", "__q", "__j").hint("merge"), cell)
    joined = joined.withColumn("overlap_start", F.greatest(F.col(a_range[0]), F.col(b_range[0]))).withColumn("overlap_end", F.least(F.col(a_range[1]), F.col(b_range[1])))
    # A function over an array stays out of generated code, and with it the join, which there would hold all rows that a list opens to.
    kept = F.forall(F.array(F.col("overlap_start") < F.col("overlap_end"), F.floor(F.col("overlap_start") / width) == F.col("__b")), lambda true: true)
    return joined.where(kept).select("*", F.inline("__list")).drop("__list", "__n", "__b", "__p", "__q")


def asof(value: Column, bounds: Sequence[tuple[float, object]]) -> Column:
    """The label of the last bound that is at most value; bounds (lower, label) ascend and are few."""
    out = F.lit(None)
    for low, label in bounds:
        out = F.when(value >= low, F.lit(label)).otherwise(out)
    return out


def nearest(rows: DataFrame, nodes: Sequence[Sequence[float]], vector: str) -> DataFrame:
    """rows with node (the first nearest of the nodes) and error (its distance); nodes are a fitted model's, of bounded number."""
    if not nodes:
        raise ValueError("nodes cannot be empty")
    table = F.array(*(F.array(*(F.lit(float(v)) for v in node)) for node in nodes))
    square = F.transform(table, lambda n: F.aggregate(F.zip_with(F.col(vector), n, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    with_d = rows.withColumn("__d", square)
    return with_d.withColumn("error", F.sqrt(F.array_min("__d"))).withColumn("node", (F.array_position("__d", F.array_min("__d")) - 1).cast("int")).drop("__d")


def knn(points: DataFrame, k: int, axes: Sequence[str] = ("x", "y"), start: float | None = None) -> DataFrame:
    """(i, j, d2, rank): for each point (row_id) its k nearest others, ties by row_id.

    As the reference order does, position 0 of a point's own order is dropped, which is an earlier point if one
    stands at the same place. Balls grow only for points that still lack k partners.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    points = points.select("row_id", *axes)
    total = points.count()
    k = min(k, total - 1)
    if k <= 0:
        return points.sparkSession.createDataFrame([], "i long, j long, d2 double, rank int")
    if start is None:
        box = points.agg(*(F.max(a) - F.min(a) for a in axes)).first()
        volume = 1.0
        for side in box:
            volume *= max(float(side), 1e-9)
        start = max((volume * (k + 1) / total) ** (1 / len(axes)), max(float(s) for s in box) * 1e-3, 1e-6)
    order = Window.partitionBy("row_id").orderBy("d2", "p_row_id")
    found, open_, radius = None, points, start
    while True:
        near = ball_join(open_, points, radius, axes).withColumn("rank", F.row_number().over(order) - 1)
        near = near.where(F.col("rank") <= k).select(F.col("row_id").alias("i"), F.col("p_row_id").alias("j"), "d2", F.col("rank").cast("int"))
        near = materialize(near)
        full = near.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") == k + 1).select("i")
        done = near.join(full, "i", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(full, open_["row_id"] == full["i"], "left_anti")
        if open_.isEmpty():
            return found.where("rank >= 1")
        radius *= 2
