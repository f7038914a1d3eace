"""Joint distributions of binned variables: counts, full grids, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import round_to_bins
from cellweave.names import col, object_group
from cellweave.plans.random_plan import running, with_row_id


def bin_columns(census: DataFrame, ranges: dict[str, tuple[float, float]], bins: int, values: bool = True) -> DataFrame:
    """census with the named columns put to bins (values, or one-based numbers)."""
    return census.select(*(round_to_bins(col(c).cast("double"), *ranges[c], bins, values).alias(c) if c in ranges else col(c) for c in census.columns))


def ranges_of(census: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = census.agg(*(f(col(n).cast("double")).alias(f"{k}{j}") for k, n in enumerate(names) for j, f in enumerate((F.min, F.max)))).first()
    return {n: (row[f"{k}0"], row[f"{k}1"]) for k, n in enumerate(names)}


def build_dist(census: DataFrame, names: Sequence[str], focal: str | Sequence[str] = "all") -> DataFrame | None:
    """Count of each combination of names (nulls are a value), as freq; None if no focal variable is among them."""
    if not names:
        raise ValueError("name one variable at least")
    if focal != "all" and not any(n in focal for n in names):
        return None
    columns = [c for c in census.columns if c in names]
    return census.groupBy(*map(col, columns)).agg(F.count("*").alias("freq")) if columns else None


def grid(census: DataFrame, names: Sequence[str], bins: int | Sequence[int], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """pos and one value per variable for every bin, the first variable fastest.

    pos is one range of numbers cut into digits, so the grid is made in parallel and without joins.
    """
    counts = [bins] * len(names) if isinstance(bins, int) else list(bins)
    if len(counts) != len(names) or min(counts) < 1:
        raise ValueError("every variable needs a bin")
    total, step, out = 1, 1, []
    for c in counts:
        total *= c
    pos = F.col("id")
    for n, c in zip(names, counts, strict=True):
        low, high = ranges[n]
        digit = F.pmod(F.floor(pos / step), F.lit(c))
        out.append((F.lit(float(low)) + digit * ((high - low) / max(1, c - 1))).alias(n))
        out.append(digit.cast("int").alias(f"__{n}"))
        step *= c
    return census.sparkSession.range(total).select(pos.alias("pos"), *out)


def smoothing(n1: Column, n2: Column, total: Column) -> Column:
    """The mass of unseen bins: total observations, mass of singletons (0.5 if none) and of doubletons."""
    n = total + 1.0
    f1 = F.when(n1 == 0, F.lit(0.5)).otherwise(n1)
    a, b = (n - 1) * f1, 2.0 * n2
    return f1 / n * F.when(a + b == 0, F.lit(1.0)).otherwise(a / (a + b))


def _groups(names: Sequence[str]) -> list[list[str]]:
    maps = [m for m in dict.fromkeys(map(object_group, names)) if m]
    return [g for m in maps if len(g := [n for n in names if n.split(".")[0] == m]) > 1]


def valid_composition(names: Sequence[str]) -> Column:
    """Whether no object map's percentages sum to more than 100."""
    out = F.lit(True)
    for group in _groups(names):
        out = out & (sum((col(n) for n in group), F.lit(0.0)) <= 100)
    return out


def smooth_dist(dist: DataFrame, names: Sequence[str], bins: int | Sequence[int], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """pos, the variables and freq over the whole grid, smoothed; freq is null in impossible bins.

    dist holds bin values and freq. They meet the grid on integer bin numbers; where a variable is constant
    its one value stands in all its bins, as a join on values has it.
    """
    counts = [bins] * len(names) if isinstance(bins, int) else list(bins)
    keys = [f"__{n}" for n in names]
    seen = dist
    for n, c in zip(names, counts, strict=True):
        low, high = ranges[n]
        number = F.rint((col(n) - low) * (c - 1) / (high - low)).cast("int") if high != low and c > 1 else F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
        seen = seen.withColumn(f"__{n}", number)
    one_of = lambda f: F.coalesce(F.sum(F.when(F.col("freq") == f, F.col("freq"))), F.lit(0)).cast("double")
    n, n1, n2 = dist.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("double"), one_of(1), one_of(2)).first()
    full = grid(dist, names, counts, ranges).join(seen.select(*map(col, keys), "freq"), keys, "left")
    full = full.withColumn("freq", F.when(valid_composition(names), F.coalesce(F.col("freq"), F.lit(0)).cast("double")))
    total, zeros = full.agg(F.sum("freq"), F.count_if(F.col("freq") == 0)).first()
    miss = smoothing(F.lit(n1), F.lit(n2), F.lit(n))
    share = F.col("freq") / F.lit(total)
    freq = share if not zeros else F.when(F.col("freq") > 0, share * (1 - miss)).when(F.col("freq") == 0, miss / F.lit(zeros))
    return full.select("pos", *map(col, names), freq.alias("freq"))


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str] = (), out: str = "Padjust", tests: Column | None = None) -> DataFrame:
    """Adjusted p-values: running minimum of p n / rank from the largest down, 1 at most.

    With keys each family is a window; without, ranks and minima come from range partitions. A null p stays null there.
    """
    if not keys:
        known = with_row_id(df.where(F.col(p).isNotNull()), F.col(p).asc(), name="__r")
        total = tests if tests is not None else F.lit(df.where(F.col(p).isNotNull()).count())
        down = running(known, F.col(p) * total / (F.col("__r") + 1), out, [], F.desc("__r"), least=True)
        adjusted = down.withColumn(out, F.least(out, F.lit(1.0))).drop("__r")
        return adjusted.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
    own = Window.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy(F.col(p).asc()))
    n = tests if tests is not None else F.count(F.col(p)).over(own)
    ranked = df.withColumn("__r", rank).withColumn("__v", F.col(p) * n / F.col("__r"))
    down = own.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.min("__v").over(down), F.lit(1.0))).drop("__r", "__v")
