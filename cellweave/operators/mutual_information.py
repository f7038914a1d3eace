"""Entropy and mutual information within specimens (cis) and distances between them (trans).

Rows carry all their variables as one array. Every ensemble (a set of variables) gets a code per row, and
one aggregation per depth counts (radius, replicate, ensemble, code) with map-side partial sums: replicates
and ensembles are keys, not jobs. Only the list of ensembles, which the caller's depth bounds, is on the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import entropy_term, normal_sf, two_sided
from cellweave.names import col, object_group, variables_of
from cellweave.operators.distribution import benjamini_hochberg, smoothing


def ensembles(names: Sequence[str], depth: int, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None) -> list[tuple[int, ...]]:
    """Variable sets of 1 to depth members, as positions; the filters hold at the largest size alone."""
    all_of = [] if not all_of or list(all_of) == ["none"] else list(all_of)
    any_of = [] if not any_of or list(any_of) == ["none"] else list(any_of)
    out = []
    for size in range(1, depth + 1):
        for e in itertools.combinations(range(len(names)), size):
            own = {names[i] for i in e}
            if size == depth and (not set(all_of) <= own or (any_of and not own & set(any_of))):
                continue
            out.append(e)
    return out


def chosen_variables(columns: Sequence[str], depth: int, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None, not_of: Sequence[str] | None = None) -> list[str]:
    """Census variables that take part: excluded ones go, and when the required ones fill the depth, all others go."""
    names = [v for v in variables_of(list(columns)) if v not in (not_of or [])]
    required = [v for v in (all_of or []) if v != "none"]
    options = [v for v in (any_of or []) if v != "none"]
    if (required or options) and len(required) + bool(options) == depth:
        names = [v for v in names if v in required or v in options]
    return names


def bins_for(rows: int, depth: int, max_bins: int = 100) -> int:
    return min(int(math.floor(((rows + 1) / 10) ** (1 / depth) + 1e-12)), max_bins)


def _ensemble_array(found: Sequence[tuple[int, ...]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("ens"), F.array(*map(F.lit, e)).alias("at")) for k, e in enumerate(found)))


def _spans(rows: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """(keys, low, high): the ranges of the variables, one row for each key."""
    low, high = ([f(F.col("v")[k]) for k in range(width)] for f in (F.min, F.max))
    return rows.groupBy(*keys).agg(F.array(*low).alias("low"), F.array(*high).alias("high"))


def binned(rows: DataFrame, bins: int, width: int, keys: Sequence[str] = ("radius",), ranged: DataFrame | None = None) -> DataFrame:
    """(keys, replicate, b, n): how many rows share the one-based bins b of their variables, over the range of all replicates.

    Rows (keys, replicate, v array<double>) are counted by their whole vector of bins before any ensemble is
    formed: what follows works on distinct vectors, of which there are at most bins^width. A column n says how often
    a row stands; `ranged` are rows that hold the ranges, if all others are permutations of them.
    """
    def one(k: int) -> Column:
        v, low, high = F.col("v")[k], F.col("low")[k], F.col("high")[k]
        step = F.rint((v - low) * (bins - 1) / F.nullif(high - low, F.lit(0.0)))
        inside = F.greatest(F.least(step, F.lit(float(bins - 1))), F.lit(0.0)) + 1
        # A degenerate range leaves the value, cut to a whole number, as bin.
        return F.when((high != low) & F.lit(bins >= 2), inside).otherwise(v).cast("long")

    spans = _spans(rows, width, keys) if ranged is None else F.broadcast(_spans(ranged, width, keys))
    spread = (rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))).join(spans, list(keys))
    flat = spread.select(*keys, "replicate", "n", *(one(k).alias(f"b{k}") for k in range(width)))
    counted = flat.groupBy(*keys, "replicate", *(f"b{k}" for k in range(width))).agg(F.sum("n").alias("n"))
    return counted.select(*keys, "replicate", F.array(*(f"b{k}" for k in range(width))).alias("b"), "n")


def entropies(rows: DataFrame, found: Sequence[tuple[int, ...]], bins: int, keys: Sequence[str] = ("radius",)) -> DataFrame:
    """(keys, replicate, ens, h): entropy in bits of each ensemble's joint bin code, from counted rows (keys, replicate, b, n).

    The code is the sum of (bin - 1) bins^k; with one bin all powers are 1, with none only the first counts.
    """
    power = F.array(*(F.lit(int(bins**k)) for k in range(max(map(len, found)))))
    coded = rows.withColumn("e", F.explode(_ensemble_array(found)))
    digits = F.zip_with(F.transform("e.at", lambda i: F.get("b", i)), F.slice(power, F.lit(1), F.size("e.at")), lambda b, p: (b - 1) * p)
    code = F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = coded.select(*keys, "replicate", F.col("e.ens").alias("ens"), code.alias("code"), "n").groupBy(*keys, "replicate", "ens", "code").agg(F.sum("n").alias("c"))
    # H = log2 n - sum(c log2 c) / n: one more aggregation instead of a window over the counts.
    return counted.groupBy(*keys, "replicate", "ens").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s")).select(*keys, "replicate", "ens", "n", F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)).alias("h"))


def information(h: DataFrame, found: Sequence[tuple[int, ...]], keys: Sequence[str] = ("radius",)) -> DataFrame:
    """(keys, replicate, ens, mi): inclusion and exclusion over the subsets of each ensemble; size 1 is its entropy."""
    number = {e: k for k, e in enumerate(found)}
    terms = [(number[e], number[s], (-1) ** (len(s) - 1)) for e in found for size in range(1, len(e) + 1) for s in itertools.combinations(e, size)]
    # Terms are a function of the ensemble list alone: depth d gives at most 2^d - 1 each.
    table = h.sparkSession.createDataFrame(terms, "whole int, ens int, sign int")
    joined = h.join(F.broadcast(table) if len(terms) <= 100_000 else table, "ens")
    return joined.groupBy(*keys, "replicate", F.col("whole").alias("ens")).agg(F.sum(F.col("sign") * F.col("h")).alias("mi"))


def _named(df: DataFrame, found: Sequence[tuple[int, ...]], names: Sequence[str], depth: int) -> DataFrame:
    """VA, VB, ... of ens; null beyond an ensemble's size."""
    letters = [f"V{chr(65 + k)}" for k in range(depth)]
    rows = [(k, *(names[e[j]] if j < len(e) else None for j in range(depth))) for k, e in enumerate(found)]
    table = df.sparkSession.createDataFrame(rows, "ens int, " + ", ".join(f"{x} string" for x in letters))
    return df.join(F.broadcast(table) if len(rows) <= 100_000 else table, "ens")


def census_rows(census: DataFrame, names: Sequence[str], replicate: int = 0) -> DataFrame:
    """(radius, replicate, v) of a wide census; a variable that the census lacks is 0."""
    v = F.array(*(F.coalesce(col(n).cast("double"), F.lit(0.0)) if n in census.columns else F.lit(0.0) for n in names))
    return census.select(F.col("Radius").cast("double").alias("radius"), F.lit(replicate).alias("replicate"), v.alias("v"))


def permuted_nulls(census: DataFrame, names: Sequence[str], replicates: int, seed: int | str) -> DataFrame:
    """(radius, replicate, v): each variable's values shuffled by themselves within a radius, in md5 order of seed, variable and row."""
    from cellweave.plans.random_plan import shuffle_key, with_row_id

    numbered = census if "row_id" in census.columns else with_row_id(census, *map(col, census.columns))
    counts = permuted_counts(numbered, names, replicates, seed)
    if counts is not None:
        return counts.select("radius", "replicate", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("radius", "replicate", "v")
    long = numbered.select("row_id", F.col("Radius").cast("double").alias("radius"), F.posexplode(F.array(*(col(n).cast("double") for n in names))).alias("at", "value"))
    each = long.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    own = ["radius", "replicate", "at"]
    key = shuffle_key(F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("at").cast("string")), "row_id")
    # All replicates and variables are numbered together: none needs to fit a task.
    moved = with_row_id(each.withColumn("__key", key), *own, "__key", "row_id", name="__at")
    first = moved.groupBy(*own).agg(F.min("__at").alias("__first"))
    moved = moved.join(first, own).withColumn("pos", F.col("__at") - F.col("__first"))
    return moved.groupBy("radius", "replicate", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("l")).select("radius", "replicate", F.transform("l", lambda s: s["value"]).alias("v"))


def permuted_counts(numbered: DataFrame, names: Sequence[str], replicates: int, seed: int | str) -> DataFrame | None:
    """permuted_nulls of a census with row_id as (radius, replicate, v, n), n times each; None if its rows need the plain way."""
    from cellweave.plans.random_plan import permuted_columns

    if dict(numbered.dtypes)["row_id"] not in ("bigint", "int"):
        return None
    rows = numbered.select(F.col("row_id").cast("long").alias("row_id"), F.col("Radius").cast("double").alias("radius"), F.array(*(col(n).cast("double") for n in names)).alias("v"))
    return permuted_columns(rows, len(names), replicates, seed)


def patch_nulls(patches: DataFrame, names: Sequence[str], replicates: int, seed: int | str, links: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(radius, replicate, v) of censuses whose patches were shuffled; replicates are keys of one plan.

    Gathered patches, with a column n, are shuffled by drawing how many of a kind fall to each neighbourhood.
    """
    from cellweave.operators.patches import drawn_objects, neighbourhoods, random_census, shuffled_objects
    from cellweave.plans.random_plan import materialize, shuffle_key, stored

    keys = ["radius", "replicate"]
    replicate = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    place, long, own = ["radius", "grp", "nbhd"], None, ["patch_id"]
    if "n" in patches.columns:
        if links:
            raise ValueError("linked means need the patches themselves, not gathered ones")
        area, n = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in ("area", "n"))
        gathered = stored(patches.select(*place, "object", area, n))
        areas = gathered.withColumn("area", F.col("area") * F.col("n"))
        long = drawn_objects(gathered, replicates, seed)
        # Too many to draw in a task: the patches are made again, and told apart by their number among those alike.
        alike = F.explode(F.sequence(F.lit(1).cast("long"), "n"))
        patches = gathered.where("n > 0").select(*place, alike.alias("patch_id"), "area", "object", F.lit(None).cast("array<double>").alias("s"))
        own = ["object", "area", "patch_id"]
    else:
        areas = stored(patches.groupBy(*place, "object").agg(F.sum("area").alias("area")))
    if long is None:
        # Patch ids repeat between neighbourhoods: number them by all that tells them apart.
        numbered = patches.withColumn("patch_id", F.xxhash64(*place, *own))
        long = None if links else shuffled_objects(numbered, areas, replicates, seed)
    if long is None:
        if not links:
            numbered = numbered.withColumn("s", F.when(F.col("object").isNull(), F.col("s")))
        # Patches come from a join, which range borders and the dealing would each make again.
        each = materialize(numbered).withColumn("replicate", replicate)
        order = shuffle_key(F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string")), F.col("patch_id"))
        # A column and no expression: a sort evaluates expressions anew in every comparison.
        long = random_census(each.withColumn("__order", order), "__order", links, keys)
    values = long.groupBy(*keys, "nbhd").agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("m"))
    rows = neighbourhoods(areas.withColumn("replicate", replicate), keys).join(values, [*keys, "nbhd"], "left")
    return rows.select(*keys, F.array(*(F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in names)).alias("v"))


def null_provenance(patches: bool, allow_permutation: bool) -> dict:
    """Which null model a call uses; strict with patches, exploratory with permuted columns."""
    if not patches and not allow_permutation:
        raise ValueError("null censuses or patches are needed, or allow_permutation")
    return {"patch_list_used": patches, "mode": "strict" if patches else "exploratory", "null_model": "patch_randomization" if patches else "within_column_permutation"}


def measure_cis_mi(census: DataFrame, depth: int, nulls: DataFrame | Sequence[DataFrame] | None = None, *, patches: DataFrame | None = None, links: Sequence[tuple[str, str]] = (), radii: Sequence[float] | None = None, bootstraps: int = 100, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None, not_of: Sequence[str] | None = None, max_bins: int = 100, bins: int | None = None, random_state: int | str = 0, allow_permutation: bool = False) -> DataFrame:
    """radius, VA.., CisMI, Zscore, Pvalue, Padjust of every variable set up to depth.

    nulls are reference censuses: wide ones, one a replicate, or rows (radius, replicate, v); without any,
    `patches` are shuffled, or else columns are permuted if `allow_permutation`. CisMI is the observed information less the mean null;
    Z is in sample deviations of the nulls, deviations within 10 machine epsilons of 0 being none.
    """
    names = chosen_variables(census.columns, depth, all_of, any_of, not_of)
    if depth < 1 or depth > len(names):
        raise ValueError("depth must be between 1 and the number of variables")
    if radii is not None:
        census = census.where(F.col("Radius").isin([float(r) for r in radii]))
    found = ensembles(names, depth, all_of, any_of)
    if bins is None:
        least = census.groupBy("Radius").count().agg(F.min("count")).first()[0]
        if least is None:
            raise ValueError("census has no rows at the requested radii")
        bins = bins_for(least, depth, max_bins)
    drawn, ranged = nulls is None, None
    if nulls is None:
        null_provenance(patches is not None, allow_permutation)
        if patches is not None:
            nulls = patch_nulls(patches, names, bootstraps, random_state, links)
        else:
            from cellweave.plans.random_plan import with_row_id

            census = census if "row_id" in census.columns else with_row_id(census, *map(col, census.columns))
            counts = permuted_counts(census, names, bootstraps, random_state)
            nulls = counts if counts is not None else permuted_nulls(census, names, bootstraps, random_state)
            ranged = census_rows(census, names) if counts is not None else None
    elif not isinstance(nulls, DataFrame):
        every = [census_rows(df, names, k + 1) for k, df in enumerate(nulls)]
        nulls = every[0]
        for df in every[1:]:
            nulls = nulls.unionByName(df)
    n = F.col("n") if ranged is not None else F.lit(1)
    every = census_rows(census, names).withColumn("n", F.lit(1).cast("long")).unionByName(nulls.select("radius", "replicate", "v", n.cast("long").alias("n")))
    rows = binned(every, bins, len(names), ranged=ranged)
    # Depth-1 entropies carry b / (1.5 n) in observed and null alike: it cancels in all results of size 1.
    mi = information(entropies(rows, found, bins), found)
    if drawn:
        # Few rows, which took all permutations to make; callers read the result more than once.
        from cellweave.plans.random_plan import stored

        mi = stored(mi)
    per = mi.groupBy("radius", "ens").agg(F.max(F.when(F.col("replicate") == 0, F.col("mi"))).alias("o"), F.avg(F.when(F.col("replicate") > 0, F.col("mi"))).alias("m"), F.coalesce(F.stddev_samp(F.when(F.col("replicate") > 0, F.col("mi"))), F.lit(0.0)).alias("sd"))
    value, sd = F.col("o") - F.col("m"), F.when(F.col("sd") <= 10 * 2.220446049250313e-16, F.lit(0.0)).otherwise(F.col("sd"))
    flat = F.when(F.abs(value) < 1e-12, F.lit(0.0)).otherwise(value)
    z = F.when(sd > 0, flat / F.nullif(sd, F.lit(0.0))).otherwise(F.when(flat == 0, 0.0).otherwise(F.signum(flat) * F.lit(float("inf"))))
    out = per.select("radius", "ens", flat.alias("CisMI"), z.alias("Zscore")).withColumn("Pvalue", two_sided(F.col("Zscore")))
    out = benjamini_hochberg(out, "Pvalue", ["radius"])
    letters = [f"V{chr(65 + k)}" for k in range(depth)]
    return _named(out, found, names, depth).orderBy("radius", "ens").select("radius", *letters, "CisMI", "Zscore", "Pvalue", "Padjust")


def specimen_rows(censuses: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """(specimen, radius, v) of the censuses, numbered from 0."""
    out = None
    for k, df in enumerate(censuses):
        one = census_rows(df, names).select(F.lit(k).alias("specimen"), "radius", "v")
        out = one if out is None else out.unionByName(one)
    return out


def smoothed(rows: DataFrame, names: Sequence[str], found: Sequence[tuple[int, ...]], bins: int) -> DataFrame:
    """(specimen, radius, ens, pos, p): smoothed distributions over the full grid of each ensemble, impossible bins left out.

    Each specimen is scaled to its own range; pos counts the first variable fastest. A constant variable's mass
    stands in all its bins.
    """
    keys = ["specimen", "radius"]
    width, top = len(names), float(bins - 1)
    spans = _spans(rows, width, keys)

    def index(k: int) -> Column:
        # -1 marks a constant variable.
        v, low, high = F.col("v")[k], F.col("low")[k], F.col("high")[k]
        step = F.greatest(F.least(F.rint((v - low) * top / F.nullif(high - low, F.lit(0.0))), F.lit(top)), F.lit(0.0))
        return F.coalesce(step, F.lit(-1.0)).cast("long")

    flat = rows.join(spans, keys).select(*keys, *(index(k).alias(f"b{k}") for k in range(width)))
    vectors = flat.groupBy(*keys, *(f"b{k}" for k in range(width))).agg(F.count("*").alias("n"))
    coded = vectors.select(*keys, "n", F.array(*(f"b{k}" for k in range(width))).alias("b"), F.explode(_ensemble_array(found)).alias("e"))
    at = F.transform("e.at", lambda i: F.get("b", i))
    counted = coded.select(*keys, "n", F.col("e.ens").alias("ens"), at.alias("b")).groupBy(*keys, "ens", "b").agg(F.sum("n").alias("freq"))
    # Spread the mass of constant variables over all bins of their axis.
    axes = F.transform("b", lambda x: F.when(x < 0, F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).otherwise(F.array(x)))
    start = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("step")))
    spread = F.aggregate(axes, start, lambda acc, axis: F.flatten(F.transform(acc, lambda a: F.transform(axis, lambda x: F.struct((a["pos"] + x * a["step"]).alias("pos"), (a["step"] * bins).alias("step"))))))
    observed = counted.select(*keys, "ens", "freq", F.explode(spread).alias("g")).select(*keys, "ens", F.col("g.pos").alias("pos"), "freq")
    totals = counted.groupBy(*keys, "ens").agg(F.sum("freq").cast("double").alias("n"), F.sum(F.when(F.col("freq") == 1, 1).otherwise(0)).cast("double").alias("n1"), F.sum(F.when(F.col("freq") == 2, 2).otherwise(0)).cast("double").alias("n2"))
    sizes = F.element_at(F.array(*(F.lit(bins ** len(e)).cast("long") for e in found)), F.col("ens") + 1)
    full = totals.join(spans, keys).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), sizes - 1)))
    groups = [[[k for k, i in enumerate(e) if names[i].split(".")[0] == m] for m in dict.fromkeys(object_group(names[i]) for i in e) if m] for e in found]
    invalid = F.lit(False)
    for k, own in enumerate(groups):
        for members in own:
            if len(members) > 1:
                total = F.lit(0.0)
                for j in members:
                    low, high = F.col("low")[found[k][j]], F.col("high")[found[k][j]]
                    total = total + low + F.pmod(F.floor(F.col("pos") / F.lit(bins**j)), F.lit(bins)) * ((high - low) / max(1.0, top))
                invalid = invalid | ((F.col("ens") == k) & (total > 100))
    full = full.where(~invalid).drop("low", "high")
    cells = full.join(observed, [*keys, "ens", "pos"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("double"))
    own = Window.partitionBy(*keys, "ens")
    cells = cells.withColumn("total", F.sum("freq").over(own)).withColumn("zeros", F.sum((F.col("freq") == 0).cast("long")).over(own))
    miss = smoothing(F.col("n1"), F.col("n2"), F.col("n"))
    share = F.col("freq") / F.nullif(F.col("total"), F.lit(0.0))
    p = F.when(F.col("zeros") == 0, share).when(F.col("freq") > 0, share * (1 - miss)).otherwise(miss / F.nullif(F.col("zeros"), F.lit(0)))
    return cells.select(*keys, "ens", "pos", p.alias("p"))


def divergences(p: DataFrame) -> DataFrame:
    """(radius, ens, i, j, d) for specimens i < j: symmetric Kullback-Leibler divergence in bits over jointly positive bins."""
    live = p.where("p > 0")
    a = live.select("radius", "ens", "pos", F.col("specimen").alias("i"), F.col("p").alias("pi"))
    b = live.select("radius", "ens", "pos", F.col("specimen").alias("j"), F.col("p").alias("pj"))
    joined = a.join(b, ["radius", "ens", "pos"]).where("i < j")
    return joined.groupBy("radius", "ens", "i", "j").agg(F.sum(0.5 * (F.col("pi") - F.col("pj")) * F.log2(F.col("pi") / F.col("pj"))).alias("d"))


def modularity(weights: Column, labels: Sequence[str], pairs: Sequence[tuple[int, int]]) -> Column:
    """Q of groups of specimens on S = 1 - d / max d with a diagonal of 1; weights is the array of d in the order of pairs.

    All ones if the maximum is 0. The number of specimens bounds the expression.
    """
    most = F.array_max(weights)
    s = lambda k: F.when(most == 0, 1.0).otherwise(1 - weights[k] / F.nullif(most, F.lit(0.0)))
    number = {p: k for k, p in enumerate(pairs)}
    n = len(labels)
    out = [F.lit(1.0) + sum((s(number[(min(i, j), max(i, j))]) for j in range(n) if j != i), F.lit(0.0)) for i in range(n)]
    whole = sum(out, F.lit(0.0))
    q = F.lit(0.0)
    for g in dict.fromkeys(labels):
        own = [i for i in range(n) if labels[i] == g]
        within = F.lit(float(len(own))) + sum((2 * s(number[(i, j)]) for i, j in pairs if i in own and j in own), F.lit(0.0))
        strength = sum((out[i] for i in own), F.lit(0.0))
        q = q + (within - strength * strength / whole) / whole
    return q


def measure_trans_mi(censuses: Sequence[DataFrame], groups: dict[str, Sequence[str]], depth: int, radii: Sequence[float] | None = None, *, bootstraps: int = 100, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None, not_of: Sequence[str] | None = None, max_bins: int = 100, random_state: int = 0, plan: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """radius, VA.., then TransMI, Zscore, Pvalue, Padjust for each grouping (suffixed by its name if there are several).

    Specimens are compared by the divergence of their smoothed distributions; a grouping scores by weighted
    modularity against permutations of the pairs. Plan steps compose.
    """
    n = len(censuses)
    if n < 2 or any(len(g) != n for g in groups.values()):
        raise ValueError("two censuses at least, and one group label for each, are needed")
    columns = [set(variables_of(df.columns)) for df in censuses]
    if any(c != columns[0] for c in columns):
        raise ValueError("all censuses must have the same variables; standardize them first")
    names = chosen_variables(censuses[0].columns, depth, all_of, any_of, not_of)
    if depth < 1 or depth > len(names):
        raise ValueError("depth must be between 1 and the number of variables")
    found = ensembles(names, depth, all_of, any_of)
    rows = specimen_rows(censuses, names)
    counts = rows.groupBy("specimen", "radius").count().collect()
    bins = bins_for(min(r["count"] for r in counts), depth, max_bins)
    shared = [r for r in sorted({c["radius"] for c in counts}) if sum(c["radius"] == r for c in counts) == n and (radii is None or r in [float(x) for x in radii])]
    if not shared:
        raise ValueError("the censuses share none of the requested radii")
    d = divergences(smoothed(rows.where(F.col("radius").isin(shared)), names, found, bins))
    pairs = list(itertools.combinations(range(n), 2))
    order = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs))
    held = d.groupBy("radius", "ens").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "d"))).alias("m"))
    vector = held.select("radius", "ens", F.transform(order, lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("d"))
    from cellweave.plans.random_plan import composed

    if plan is None:
        import random

        rng = random.Random(random_state)
        plan = [rng.sample(range(len(pairs)), len(pairs)) for _ in range(bootstraps)]
    steps = [list(range(len(pairs))), *composed(plan)]
    # One row for each replicate; the vectors have a value per pair of specimens.
    replicates = F.array(*(F.struct(F.lit(k).alias("replicate"), F.array(*map(F.lit, s)).alias("src")) for k, s in enumerate(steps)))
    each = vector.withColumn("r", F.explode(replicates)).select("radius", "ens", F.col("r.replicate").alias("replicate"), F.transform("r.src", lambda i: F.get("d", i)).alias("d"))
    out = None
    for name, labels in groups.items():
        q = each.select("radius", "ens", "replicate", modularity(F.col("d"), list(labels), pairs).alias("q"))
        per = q.groupBy("radius", "ens").agg(F.max(F.when(F.col("replicate") == 0, F.col("q"))).alias("o"), F.avg(F.when(F.col("replicate") > 0, F.col("q"))).alias("m"), F.coalesce(F.stddev_samp(F.when(F.col("replicate") > 0, F.col("q"))), F.lit(0.0)).alias("sd"))
        z = F.when(F.col("sd") > 10 * 2.220446049250313e-16, (F.col("o") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).otherwise(0.0)
        tail = "" if len(groups) == 1 else f"_{name}"
        one = per.select("radius", "ens", F.col("o").alias(f"TransMI{tail}"), z.alias(f"Zscore{tail}")).withColumn(f"Pvalue{tail}", normal_sf(F.col(f"Zscore{tail}")))
        one = benjamini_hochberg(one, f"Pvalue{tail}", ["radius"], f"Padjust{tail}")
        out = one if out is None else out.join(one, ["radius", "ens"])
    letters = [f"V{chr(65 + k)}" for k in range(depth)]
    stats = [c for c in out.columns if c not in ("radius", "ens")]
    return _named(out, found, names, depth).orderBy("radius", "ens").select("radius", *letters, *stats)


def distance_table(transmi_distances: DataFrame, variable: str) -> DataFrame:
    """(i, j, d) both ways of the pairs of one variable (columns left, right, variable, value)."""
    one = transmi_distances.where(F.col("variable") == variable).select(F.col("left").alias("i"), F.col("right").alias("j"), F.col("value").cast("double").alias("d"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


__all__ = ["binned", "bins_for", "chosen_variables", "divergences", "ensembles", "entropies", "entropy_term", "information", "measure_cis_mi", "measure_trans_mi", "modularity", "permuted_nulls", "smoothed"]
