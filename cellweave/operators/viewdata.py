"""The tables behind the plots; drawing them is left to whatever draws."""

from __future__ import annotations

import colorsys
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import rgb
from cellweave.names import col
from cellweave.operators.distribution import bin_columns, build_dist, ranges_of, smooth_dist
from cellweave.operators.range_join import asof


def _letters(mi: DataFrame) -> list[str]:
    return [c for c in mi.columns if len(c) == 2 and c[0] == "V" and c[1].isupper()]


def members(mi: DataFrame) -> Column:
    """The ensemble of a result row, without its empty places."""
    return F.array_compact(F.array(*map(F.col, _letters(mi))))


def _stat(mi: DataFrame, name: str, group: str | None) -> str:
    found = [c for c in mi.columns if c == name or (group and c == f"{name}_{group}")]
    if not found:
        found = [c for c in mi.columns if c.startswith(name)]
    if not found:
        raise ValueError(f"no {name} column for group {group}")
    return found[-1] if group else found[0]


def _metric(mi: DataFrame, group: str | None) -> str:
    return _stat(mi, "CisMI" if any(c.startswith("CisMI") for c in mi.columns) else "TransMI", group)


def estimated_log10_p(mi: DataFrame, z: str, p: str) -> tuple[float, float, float]:
    """Quadratic of log10 p over |z| from the rows with p > 0, by the normal equations (sums only); three rows at least."""
    import numpy as np

    x, y = F.abs(F.col(z)), F.log10(p)
    rows = mi.where((F.col(p) > 0) & F.col(z).isNotNull() & (F.abs(z) < float("inf")))
    s = rows.agg(*(F.sum(x**k).alias(f"s{k}") for k in range(5)), *(F.sum(y * x**k).alias(f"t{k}") for k in range(3))).first()
    if not s["s0"] or s["s0"] < 3:
        raise ValueError("a p-value of 0 is estimated from three positive ones at least")
    a = np.array([[s[f"s{i + j}"] for j in range(3)] for i in range(3)], float)
    return tuple(np.linalg.lstsq(a, np.array([s[f"t{i}"] for i in range(3)], float), rcond=None)[0])  # type: ignore[return-value]


def log10_p(mi: DataFrame, z: str, p: str) -> Column:
    """log10 of p; where p fell to 0, its estimate from z among the rows of mi."""
    if mi.where(F.col(p) <= 0).isEmpty():
        return F.log10(p)
    a, b, c = estimated_log10_p(mi, z, p)
    x = F.abs(F.col(z))
    return F.when(F.col(p) > 0, F.log10(p)).otherwise(a + b * x + c * x * x)


def _sizes(metric: Column, keys: Sequence[Column], least: float) -> Column:
    """Point sizes: the magnitude above the least of its group, in shares of the spread, plus `least`; 0.5 without spread."""
    own = Window.partitionBy(*keys)
    low, spread = F.min(F.abs(metric)).over(own), F.max(F.abs(metric)).over(own) - F.min(F.abs(metric)).over(own)
    return F.when(spread > 0, (F.abs(metric) - low) / F.nullif(spread, F.lit(0.0)) + least).otherwise(0.5)


def mi_by_radius(mi: DataFrame, ensemble: Sequence[str], *, adjusted: bool = False, group: str | None = None) -> DataFrame:
    """(radius, metric, log10_p, size) of one ensemble along the radii; size is 1 at a single radius."""
    metric, z, p = _metric(mi, group), _stat(mi, "Zscore", group), _stat(mi, "Padjust" if adjusted else "Pvalue", group)
    wanted = F.array(*map(F.lit, ensemble))
    holding = mi.withColumn("__m", members(mi)).where(F.size(F.array_except(wanted, F.col("__m"))) == 0)
    only = F.count("*").over(Window.partitionBy("radius"))
    own = holding.withColumn("__n", only).where((F.col("__n") == 1) | (F.size("__m") == len(set(ensemble)))).drop("__n")
    counts = own.groupBy("radius").count()
    radii = mi.select("radius").distinct()
    if not counts.where("count <> 1").isEmpty() or not radii.join(counts, "radius", "left_anti").isEmpty():
        raise ValueError(f"{list(ensemble)} should be one row at each radius")
    out = None
    for r in sorted(x["radius"] for x in radii.collect()):
        table = mi.where(F.col("radius") == r)
        one = own.where(F.col("radius") == r).select("radius", F.col(metric).alias("metric"), log10_p(table, z, p).alias("log10_p"))
        out = one if out is None else out.unionByName(one)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("size", F.when(n == 1, 1.0).otherwise(_sizes(F.col("metric"), [F.lit(0)], 0.5))).orderBy("radius")


def mi_rank(mi: DataFrame, radius: float, *, depth: Sequence[int] | None = None, p_threshold: float = 0.05, mi_threshold: float | None = None, adjusted: bool = True, all_of: Sequence[str] = (), any_of: Sequence[str] = (), not_of: Sequence[str] = (), group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Significant result rows at a radius by falling |z| with their size, and per variable the |z| and size of its rows over all rows."""
    metric, z, p = _metric(mi, group), _stat(mi, "Zscore", group), _stat(mi, "Padjust" if adjusted else "Pvalue", group)
    if depth is not None and (not depth or min(depth) <= 0):
        raise ValueError("depths start at 1")
    if len(all_of) + bool(any_of) > min(depth or [1]):
        raise ValueError("more variables are asked for than an ensemble holds")
    own = mi.where(F.col("radius") == float(radius)).withColumn("members", members(mi)).withColumn("depth", F.size("members"))
    for given, test in ((all_of, lambda a: F.size(F.array_except(a, F.col("members"))) == 0), (any_of, lambda a: F.arrays_overlap("members", a)), (not_of, lambda a: ~F.arrays_overlap("members", a))):
        if given:
            own = own.where(test(F.array(*map(F.lit, given))))
    if depth is not None:
        own = own.where(F.col("depth").isin(list(depth)))
    least = mi_threshold if mi_threshold is not None else 0.1 if group is None else 0.0
    size = F.abs(F.col(metric)) if metric.startswith("CisMI") else F.col(metric)
    own = own.where((F.col(p) <= p_threshold) & (size >= least))
    sized = own.withColumn("size", _sizes(F.col(metric), [F.col("depth")], 0.1))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("radius").orderBy(F.abs(F.col(z)).desc(), *_letters(mi))))
    log_p = log10_p(own, z, p)
    ranked = ranked.select("rank", "members", "depth", F.col(metric).alias("metric"), F.col(z).alias("z"), log_p.alias("log10_p"), "size")
    total = F.lit(float(max(1, own.count())))
    variables = ranked.select(F.explode("members").alias("V"), F.abs("z").alias("az"), "size").groupBy("V").agg((F.sum("az") / total).alias("z"), (F.sum("size") / total).alias("size"))
    return ranked, variables.withColumn("size", _sizes(F.col("size"), [F.lit(0)], 0.1)).orderBy(F.desc("z"))


def distribution(census: DataFrame, ensemble: Sequence[str], radius: float, bins: int | None = None, nulls: DataFrame | None = None) -> DataFrame:
    """What one or two variables look like at a radius: their rows, or with `bins` their smoothed joint distribution.

    A variable of no more than `bins` values keeps them. More than two variables give the rows as they are;
    `nulls`, a shuffled census, stands in for the observed one.
    """
    source = nulls if nulls is not None else census.where(F.col("Radius") == float(radius))
    if not ensemble or any(v not in source.columns for v in ensemble):
        raise ValueError("the census lacks some of these variables")
    own = source.select(*map(col, ensemble))
    if len(ensemble) > 2 or bins is None:
        return own
    if bins < 1:
        raise ValueError("one bin at least is needed")
    ranges = ranges_of(own, ensemble)
    kinds = own.agg(*(F.count_distinct(col(v)).alias(f"k{k}") for k, v in enumerate(ensemble))).first()
    counts = [min(bins, kinds[f"k{k}"]) for k in range(len(ensemble))]
    for k, v in enumerate(ensemble):
        if kinds[f"k{k}"] > bins:
            own = bin_columns(own, {v: ranges[v]}, bins)
    return smooth_dist(build_dist(own, list(ensemble)), list(ensemble), counts, ranges)


def normalize_profiles(profile: DataFrame, compare: str = "A", normalize: str = "U") -> DataFrame:
    """(Object, component, value): scaled among all objects of a component (A), within an object (W) or over both (B).

    U to 0..1 (without range 0, within objects 0.5), Z to sample deviations (0 without any).
    """
    if compare not in ("A", "W", "B") or normalize not in ("U", "Z"):
        raise ValueError(f"compare is A, W or B and normalize U or Z, not {compare} and {normalize}")
    names = [c for c in profile.columns if c not in ("Object", "Count")]
    if not {"Object", "Count"} <= set(profile.columns) or not names:
        raise ValueError("a profile has Object, Count and columns of components")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), col(c).cast("double").alias("v")) for c in names)))
    long = profile.select("Object", pairs.alias("e")).select("Object", "e.component", "e.v")
    own = Window.partitionBy({"A": F.col("component"), "W": F.col("Object"), "B": F.lit(0)}[compare])
    if normalize == "U":
        value = (F.col("v") - F.min("v").over(own)) / F.nullif(F.max("v").over(own) - F.min("v").over(own), F.lit(0.0))
        fill = 0.5 if compare == "W" else 0.0
    else:
        value, fill = (F.col("v") - F.avg("v").over(own)) / F.nullif(F.stddev_samp("v").over(own), F.lit(0.0)), 0.0
    return long.select("Object", "component", F.coalesce(value, F.lit(fill)).alias("value"))


def object_pixels(voxels: DataFrame, palette: Sequence[str], z: int | None = None, objects: Sequence[int] | None = None) -> DataFrame:
    """(x, y, z, r, g, b) of an object map by its palette, of a slice and of some objects if named."""
    own = voxels if z is None else voxels.where(F.col("z") == z)
    own = own if objects is None else own.where(F.col("value").isin([float(o) for o in objects]))
    color = rgb(F.get(F.array(*map(F.lit, palette)), F.col("value").cast("int") - 1))
    return own.select("x", "y", "z", color.alias("c")).select("x", "y", "z", "c.*")


def scalar_pixels(voxels: DataFrame, palette: Sequence[str], z: int | None = None, channels: Sequence[int] | None = None, enhance: float = 0.0) -> DataFrame:
    """(x, y, z, r, g, b): channels scaled to their (1 - enhance) quantile, tinted by the palette and added up to 255."""
    own = voxels if z is None else voxels.where(F.col("z") == z)
    own = own if channels is None else own.where(F.col("c").isin(list(channels)))
    top = own.groupBy("c").agg(F.percentile("value", F.lit(1 - enhance)).alias("top"))
    lit = own.join(F.broadcast(top), "c").withColumn("s", F.least(F.col("value") / F.nullif("top", F.lit(0.0)), F.lit(1.0)))  # a row for each channel
    tint = rgb(F.get(F.array(*map(F.lit, palette)), F.col("c") - 1))
    parts = lit.select("x", "y", "z", "s", tint.alias("t"))
    return parts.groupBy("x", "y", "z").agg(*(F.least(F.rint(F.sum(F.coalesce("s", F.lit(0.0)) * F.col(f"t.{a}"))), F.lit(255.0)).cast("int").alias(a) for a in "rgb"))


def spatial_map(points: DataFrame, value: str = "value", classes: Sequence[tuple[float, str]] = ()) -> DataFrame:
    """points with shade (the value from 0 to 1 over all points; 0.5 without spread) and class, the last of `classes` (from, name) at or below it."""
    low, high = points.agg(F.min(value), F.max(value)).first()
    shade = F.lit(0.5) if low is None or low == high else (F.col(value) - F.lit(float(low))) / F.lit(float(high) - float(low))
    return points.withColumn("shade", shade).withColumn("class", asof(F.col("shade"), sorted(classes)).cast("string") if classes else F.lit(None).cast("string"))


def palette_table(spark: SparkSession, palette: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(label, name, color, r, g, b): a legend's rows."""
    if labels is not None and len(labels) != len(palette):
        raise ValueError(f"{len(palette)} colours need as many names, not {len(labels)}")
    rows = [(k, labels[k - 1] if labels else str(k), c) for k, c in enumerate(palette, 1)]
    legend = spark.createDataFrame(rows, "label int, name string, color string")
    return legend.withColumn("c", rgb(F.col("color"))).select("label", "name", "color", "c.*")


def make_palette(n: int, random_state: int = 0, plan: dict[str, Sequence[float] | float] | None = None) -> list[str]:
    """n colours of evenly spaced hues; a plan gives hue_offset, hue_order, saturation and value."""
    if not isinstance(n, int) or n <= 0:
        raise ValueError("a palette has one colour at least")
    if plan is None:
        rng = random.Random(random_state)
        plan = {"hue_offset": rng.uniform(0, 1 / n), "hue_order": rng.sample(range(n), n), "saturation": [rng.betavariate(1.5, 1) for _ in range(n)], "value": [rng.betavariate(4.5, 1) for _ in range(n)]}
    if any(len(plan[k]) != n for k in ("hue_order", "saturation", "value")) or sorted(plan["hue_order"]) != list(range(n)):
        raise ValueError(f"the plan needs {n} hues in some order, saturations and values")
    out = []
    for h, s, v in zip(plan["hue_order"], plan["saturation"], plan["value"], strict=True):
        r, g, b = colorsys.hsv_to_rgb((h / n + plan["hue_offset"]) % 1, s, v)
        out.append(f"#{round(r * 255):02X}{round(g * 255):02X}{round(b * 255):02X}")
    return out
