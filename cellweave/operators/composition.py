"""Diversity of compositions, and merging of objects in profiles, tables and voxel maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import entropy_term
from cellweave.names import col


def alpha_diversity(parts: DataFrame, keys: Sequence[str] = (), ids: int | None = None) -> DataFrame:
    """(keys, id, percent, entropy) of parts (keys, id, mass): composition over ids 1..n and its entropy in bits.

    Ids that a key lacks have 0 %; a key without mass has null percentages and entropy 0.
    """
    n = ids if ids is not None else int(parts.agg(F.max("id")).first()[0] or 0)
    sums = parts.where((F.col("id") >= 1) & (F.col("id") <= n)).groupBy(*keys, "id").agg(F.sum("mass").cast("double").alias("mass"))
    each = (parts.select(*keys).distinct() if keys else parts.sparkSession.range(1).drop("id")).withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    full = each.join(sums, [*keys, "id"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("mass").over(own)
    full = full.withColumn("percent", 100 * F.col("mass") / F.nullif(total, F.lit(0.0)))
    h = F.coalesce(F.sum(entropy_term(F.col("percent"), F.lit(100.0))).over(own), F.lit(0.0))
    return full.select(*keys, "id", "percent", h.alias("entropy"))


def beta_diversity(parts: DataFrame, weights: DataFrame, ids: int | None = None) -> tuple[DataFrame, float]:
    """Composition and entropy of each parent, and beta: the weighted divergence of parents from their mean, in bits.

    parts are (parent, id, mass), weights (parent, weight), such as the parents' voxels. Parents without mass
    stay in the table as zeros and out of beta. Zeros become 1e-6 / n, then shares are renormalised.
    """
    n = ids if ids is not None else int(parts.agg(F.max("id")).first()[0] or 0)
    table = weights.select("parent").join(parts, "parent", "left").select("parent", F.coalesce("id", F.lit(0)).alias("id"), F.coalesce(F.col("mass").cast("double"), F.lit(0.0)).alias("mass"))
    rows = alpha_diversity(table, ["parent"], n).withColumn("percent", F.coalesce("percent", F.lit(0.0)))
    live = rows.join(rows.groupBy("parent").agg(F.sum("percent").alias("t")).where("t > 0").select("parent"), "parent").join(weights, "parent")
    share = live.withColumn("w", F.col("weight") / (F.sum("weight").over(Window.partitionBy("id"))))
    mean = share.groupBy("id").agg(F.sum(F.col("w") * F.col("percent") / 100).alias("q"))

    def filled(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
        own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        up = df.withColumn("__f", F.when(F.col(value) == 0, F.lit(1e-6 / max(1, n))).otherwise(F.col(value)))
        return up.withColumn(value, F.col("__f") / F.sum("__f").over(own)).drop("__f")

    p = filled(share.withColumn("p", F.col("percent") / 100), "p", ["parent"]).join(filled(mean, "q", []), "id")
    beta = p.agg(F.sum(F.col("w") * F.col("p") * F.log2(F.col("p") / F.col("q")))).first()[0]
    if beta is None:
        raise ValueError("no parent holds any of the constituents")
    return rows, float(beta)


def merge_map(groups: Sequence[Sequence[int]]) -> dict[int, int]:
    """object -> least member of its group."""
    out: dict[int, int] = {}
    for g in groups:
        if not g or any(o in out or o <= 0 for o in g):
            raise ValueError("object groups must be non-empty, disjoint and of positive ids")
        out |= {int(o): int(min(g)) for o in g}
    return out


def _target(value: Column, groups: Sequence[Sequence[int]]) -> Column:
    pairs = merge_map(groups)
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value.cast("int")), value.cast("int"))


def merge_profile(profile: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """profile (Object, Count, components...) with each group in one row: counts summed, components averaged by Count.

    Rows are numbered 1.. by their least object; a whole-number column is cut to whole numbers, as its type says.
    """
    parts = [c for c in profile.columns if c not in ("Object", "Count")]
    inside = remaining_and_selected(profile, groups)[1].agg(F.count("*").alias("n")).first()["n"]
    if inside != len(merge_map(groups)):
        raise ValueError("the profile lacks an object that is to be merged")
    rows = profile.withColumn("__g", _target(F.col("Object"), groups)).groupBy("__g")
    kinds = dict(profile.dtypes)
    mean = lambda c: F.coalesce(F.sum(col(c) * F.col("Count")) / F.nullif(F.sum("Count"), F.lit(0)), F.avg(col(c))).cast(kinds[c])
    if not rows.agg(F.sum("Count").alias("n")).where(F.col("__g").isin(sorted(set(merge_map(groups).values()))) & (F.col("n") == 0)).isEmpty():
        raise ValueError("objects without any count have no weighted mean")
    merged = rows.agg(F.sum("Count").cast(kinds["Count"]).alias("Count"), *(mean(c).alias(c) for c in parts))
    number = F.row_number().over(Window.orderBy("__g"))
    return merged.select(number.cast(kinds["Object"]).alias("Object"), "Count", *map(col, parts))


def renumber(values: DataFrame, column: str, groups: Sequence[Sequence[int]], keep_zero: bool) -> DataFrame:
    """values with the column's groups merged and the codes renumbered densely from 1; 0 stays 0 in voxel maps.

    The distinct codes are few and map through a joined table, so the rows are not sorted.
    """
    coded = values.withColumn("__g", _target(F.col(column), groups))
    codes = coded.select("__g").distinct()
    live = codes.where("__g <> 0") if keep_zero else codes
    table = live.select("__g", F.row_number().over(Window.orderBy("__g")).alias("__n"))
    out = coded.join(table, "__g", "left").withColumn(column, F.coalesce("__n", F.lit(0)).cast(dict(values.dtypes)[column]))
    return out.select(*values.columns)


def merge_palette(palette: Sequence[str], groups: Sequence[Sequence[int]]) -> list[str]:
    """The colours of the objects that remain: each group keeps that of its least member."""
    pairs = merge_map(groups)
    return [color for k, color in enumerate(palette, 1) if pairs.get(k, k) == k]


def remaining_and_selected(profile: DataFrame, groups: Sequence[Sequence[int]]) -> tuple[DataFrame, DataFrame]:
    """The rows outside all groups, and those inside one (anti and semi join)."""
    table = profile.sparkSession.createDataFrame([(o,) for o in merge_map(groups)], "Object long")
    return profile.join(F.broadcast(table), "Object", "left_anti"), profile.join(F.broadcast(table), "Object", "left_semi")  # the caller's own list
