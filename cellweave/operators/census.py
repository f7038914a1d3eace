"""Censuses of point tables: what lies within a radius of each seed.

Points are first summed by site and object (exact for percentages and means), so the range join runs over
sites, not cells; its output is summed by neighbourhood and object before anything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.volumes import normalize_radii, normalize_sizes
from cellweave.names import RESERVED, natural_sort, radius_key
from cellweave.operators.patches import neighbourhoods, summarize, to_wide
from cellweave.operators.range_join import AXES, ball_join
from cellweave.plans.random_plan import materialize, sample_by_hash, sample_by_plan, with_row_id


@dataclass
class CensusResult:
    """Lazy tables of a census: wide rows, long rows, patches, seeds, and its metadata."""

    census: DataFrame
    long: DataFrame
    patches: DataFrame
    seeds: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.census.columns if c not in RESERVED]

    def summary(self) -> dict:
        gathered = "n" in self.patches.columns
        return summarize_neighbourhoods(self.patches.withColumn("area", F.col("area") * F.col("n")) if gathered else self.patches)


def object_points(table: DataFrame, order: Sequence[str] | None = None, *, numbered: bool = True) -> DataFrame:
    """points (row_id, x, y, z, object, s) of an object table X, Y, Z, Object and scalar columns after it; row_id only if numbered."""
    missing = [c for c in ("X", "Y", "Z", "Object") if c not in table.columns]
    if missing:
        raise ValueError("an object table starts with X, Y, Z and Object")
    scalars = [c for c in table.columns if c not in ("X", "Y", "Z", "Object", "row_id")]
    wrong = [c for c, kind in table.dtypes if c in scalars and kind not in ("int", "bigint", "smallint", "tinyint", "float", "double") and not kind.startswith("decimal")]
    if wrong:
        raise ValueError("scalars of an object table are numbers")
    rows = table if "row_id" in table.columns or not numbered else with_row_id(table, *(order or table.columns))
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in scalars)) if scalars else F.array().cast("array<double>")
    return rows.select(*(["row_id"] if numbered else []), *(F.col(a.upper()).cast("double").alias(a) for a in AXES), F.col("Object").cast("long").alias("object"), values.alias("s"))


def check_finite(points: DataFrame, axes: Sequence[str] = AXES) -> None:
    bad = points.where(" OR ".join(f"`{a}` IS NULL OR isnan(`{a}`) OR abs(`{a}`) = double('infinity')" for a in axes))
    if not bad.isEmpty():
        raise ValueError("a coordinate is null or not finite")


def eligible(points: DataFrame, objects: Sequence[int] | dict | None) -> DataFrame:
    """Points whose object is allowed, with their zero-based position among them."""
    allowed = objects.get("O1") if isinstance(objects, dict) else objects
    rows = points if allowed is None else points.where(F.col("object").isin([int(o) for o in allowed]))
    return with_row_id(rows, "row_id", name="position")


def _sum_vectors(s: str, size: int, weight: Column | None = None) -> Column:
    each = [F.sum(F.col(s)[k] if weight is None else F.col(s)[k] * weight) for k in range(size)]
    return F.array(*each) if each else F.array().cast("array<double>")


def sites(points: DataFrame, scalars: int) -> DataFrame:
    """(x, y, z, object, area, s): points of one place and object together."""
    return points.groupBy(*AXES, "object").agg(F.count("*").alias("area"), _sum_vectors("s", scalars).alias("s"))


def census_of_seeds(seeds: DataFrame, points: DataFrame, radius: float, scalars: int = 0) -> DataFrame:
    """Patch rows of seeds (nbhd, x, y, z): one for each neighbourhood and object."""
    joined = ball_join(seeds.select("nbhd", *AXES), sites(points, scalars), radius)
    joined = joined.withColumnRenamed("p_s", "s")
    rows = joined.groupBy("nbhd", F.col("p_object").alias("object")).agg(F.sum("p_area").alias("area"), _sum_vectors("s", scalars).alias("s"))
    return rows.select(F.lit(float(radius)).alias("radius"), F.lit("O1").alias("grp"), F.col("nbhd").cast("int").alias("nbhd"), F.col("object").alias("patch_id"), F.col("area").cast("long").alias("area"), "object", "s")


#: Points of one place and object that meet seeds as one row.
PACK_ROWS = 4096


def member_patches(seeds: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Patch rows of area 1, one for each neighbourhood and point in it: what the null model shuffles.

    Points of a place meet seeds in packs, so it is cheap to make the rows again and they need not be stored.
    """
    pack = F.floor(F.col("row_id") / PACK_ROWS).alias("pack")
    packs = points.groupBy(*AXES, "object", pack).agg(F.collect_list("row_id").alias("ids"), F.collect_list("s").alias("s")).drop("pack")
    joined = ball_join(seeds.select("nbhd", *AXES), packs, radius)
    each = joined.select("nbhd", "p_object", "p_s", F.posexplode("p_ids").alias("at", "row_id"))
    return each.select(F.lit(float(radius)).alias("radius"), F.lit("O1").alias("grp"), F.col("nbhd").cast("int").alias("nbhd"), F.col("row_id").alias("patch_id"), F.lit(1).cast("long").alias("area"), F.col("p_object").alias("object"), F.col("p_s")[F.col("at")].alias("s"))


def gathered_patches(rows: DataFrame) -> DataFrame:
    """The rows of `member_patches` gathered, (radius, grp, nbhd, object, area 1, n): rows are those of `census_of_seeds`."""
    return rows.select("radius", "grp", "nbhd", "object", F.lit(1).cast("long").alias("area"), F.col("area").alias("n"))


def census_table(table: DataFrame, radii: float | Sequence[float], sample_size: int | Sequence[int] | None, links: Sequence[tuple[str, str]] = (), seed_objects: Sequence[int] | dict | None = None, *, sample_indices: Sequence | None = None, seeds: DataFrame | None = None, order: Sequence[str] | None = None, random_state: int | str = 0, gathered: bool = False) -> CensusResult:
    """Census of an object table: percentages O1.<id> and linked means O1.<id>_S1.<c> around sampled cells.

    Seeds are a table (nbhd, x, y, z), positions of a plan (one list for all radii, or one each), or md5
    samples, drawn for each radius by itself. `gathered` patches tell how many members of an object a neighbourhood has,
    in place of a row for each; with given seeds the cells then need no numbers. Wide rows are the variables, then X, Y, Z and Radius; a variable
    unseen at a radius is null there.
    """
    radii = normalize_radii(radii)
    sizes = normalize_sizes(sample_size, len(radii))
    points = object_points(table, order, numbered=not (gathered and seeds is not None))
    check_finite(points)
    scalars = len([c for c in table.columns if c not in ("X", "Y", "Z", "Object", "row_id")])
    pool = None if seeds is not None else eligible(points, seed_objects)
    patches, every_seed, longs = None, None, None
    for k, radius in enumerate(radii):
        if seeds is not None:
            own = seeds.select(F.col("nbhd").cast("int").alias("nbhd"), *(F.col(a).cast("double").alias(a) for a in AXES))
        elif sample_indices is not None:
            plan = sample_indices[k] if sample_indices and isinstance(sample_indices[0], (list, tuple)) else sample_indices
            if sizes[k] is not None and len(plan) < sizes[k]:
                raise ValueError("the plan names fewer seeds than are asked for")
            own = sample_by_plan(pool, list(plan)[: sizes[k]]).select("nbhd", *AXES)
        else:
            if sizes[k] is None:
                raise ValueError("without a plan of seeds their number is needed")
            own = sample_by_hash(pool, sizes[k], f"{random_state}-{k}").select(F.col("nbhd").cast("int").alias("nbhd"), *AXES)
        if seeds is None and sizes[k] is not None and own.count() < sizes[k]:
            raise ValueError("there are fewer objects than the seeds asked for")
        rows = census_of_seeds(own, points, radius, scalars)
        long = summarize(rows, links)
        # Lazy: only the null model reads the members one by one.
        units = gathered_patches(rows) if gathered else member_patches(own, points, radius)
        patches = units if patches is None else patches.unionByName(units)
        longs = long if longs is None else longs.unionByName(long)
        tagged = own.withColumn("radius", F.lit(radius))
        every_seed = tagged if every_seed is None else every_seed.unionByName(tagged)
    # A row for each radius, seed and variable, of all radii at once: read for the names and for the wide rows.
    longs = materialize(longs)
    seen: dict[str, set[float]] = {}
    for r in longs.select("radius", "var").distinct().collect():
        seen.setdefault(r["var"], set()).add(r["radius"])
    names = natural_sort(list(seen))
    place = every_seed.select("radius", "nbhd", *(F.col(a).alias(a.upper()) for a in AXES))
    wide = to_wide(longs, place, ("radius", "nbhd"), names)
    # A variable that a radius lacks is null there, and not 0.
    known = lambda n: F.col(f"`{n}`") if len(seen[n]) == len(set(radii)) else F.when(F.col("radius").isin(list(seen[n])), F.col(f"`{n}`")).alias(n)
    wide = wide.select(*(known(n) for n in names), "X", "Y", "Z", F.col("radius").alias("Radius"))
    return CensusResult(wide, longs, patches, every_seed, {"radii": radii, "radius_keys": [radius_key(r) for r in radii], "sample_size": sizes, "links": list(links), "explicit_plan": sample_indices is not None or seeds is not None})


#: Distinct objects that a census of a coordinate table has columns for.
MAX_OBJECTS = 10_000


def coordinate_columns(columns: Sequence[str], requested: Sequence[str] | None = None) -> list[str]:
    """x, y and z if there is one, by any case."""
    if requested:
        missing = [c for c in requested if c not in columns]
        if missing or len(requested) not in (2, 3):
            raise ValueError(f"coordinate columns not found: {missing or list(requested)}")
        return list(requested)
    by_name = {c.lower(): c for c in columns}
    if not {"x", "y"} <= set(by_name):
        raise ValueError("Coordinate tables need x and y columns")
    return [by_name[a] for a in AXES if a in by_name]


def census_coordinates(table: DataFrame, radii: float | Sequence[float], variables: Sequence[str] | None = None, coordinates: Sequence[str] | None = None, object_column: str | None = None, sample_size: int | Sequence[int] | None = None, *, seeds: DataFrame | None = None, order: Sequence[str] | None = None, random_state: int | str = 0) -> DataFrame:
    """Census of any coordinate table: O1.<value> percentages and means of variables around sampled rows.

    All radii share one shuffled order of rows and take a prefix of it; sample_size None means every row.
    """
    radii = normalize_radii(radii)
    sizes = normalize_sizes(sample_size, len(radii))
    axes = coordinate_columns(table.columns, coordinates)
    numeric = [c for c, kind in table.dtypes if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") and c not in axes and c not in (object_column, "row_id")]
    variables = list(variables) if variables is not None else numeric
    numbered = table if "row_id" in table.columns else with_row_id(table, *(order or table.columns))
    fields = [F.col("row_id"), *(F.col(c).cast("double").alias(a) for a, c in zip(AXES, axes, strict=False))]
    fields += [F.col(object_column).cast("string").alias("object")] if object_column else []
    points = numbered.select(*fields, *(F.col(f"`{v}`").cast("double").alias(f"v{k}") for k, v in enumerate(variables)))
    used = AXES[: len(axes)]
    check_finite(points, used)
    values = sorted(r[0] for r in points.select("object").distinct().limit(MAX_OBJECTS + 1).collect()) if object_column else []
    if len(values) > MAX_OBJECTS:
        raise ValueError(f"a wide census has a column for each object: more than {MAX_OBJECTS} are too many")
    parts = [f(f"v{k}").alias(f"{name}{k}") for k in range(len(variables)) for f, name in ((F.sum, "t"), (F.count, "c"))]
    places = points.groupBy(*used, *(["object"] if object_column else [])).agg(F.count("*").alias("n"), *parts)
    out = None
    for radius, size in zip(radii, sizes, strict=True):
        if seeds is not None:
            own = seeds.select("nbhd", *used)
        elif size is None:
            own = points.select((F.col("row_id") + 1).alias("nbhd"), *used)
        else:
            own = sample_by_hash(points, size, random_state).select("nbhd", *used)
        # Rows of one place have the same neighbourhood: places are summed before they meet, and each row takes its place's.
        joined = ball_join(own.select(*used).distinct(), places, radius, used)
        share = [(100 * F.sum(F.when(F.col("p_object") == v, F.col("p_n")).otherwise(0)) / F.sum("p_n")).alias(f"O1.{v}") for v in values]
        means = [(F.sum(f"p_t{k}") / F.nullif(F.sum(f"p_c{k}"), F.lit(0))).alias(v) for k, v in enumerate(variables)]
        z = [] if len(used) == 3 else [F.lit(0.0).alias("Z")]
        rows = joined.groupBy(*used).agg(F.sum("p_n").alias("__n"), *share, *means).join(own.withColumnsRenamed({a: f"__s{a}" for a in used}), [F.col(a) == F.col(f"__s{a}") for a in used])
        one = rows.select("nbhd", *(F.col(f"`{n}`") for n in [*(f"O1.{v}" for v in values), *variables]), *(F.col(a).alias(a.upper()) for a in used), *z, F.lit(radius).alias("Radius"))
        out = one if out is None else out.unionByName(one)
    return out


def create_neighborhoods(points: DataFrame, radius: float, seeds: DataFrame | None = None, max_neighborhoods: int | None = None, *, axes: Sequence[str] = AXES, pixel_to_micron: float = 1.0) -> DataFrame:
    """(nbhd, center, radius, patch_id, members): members sorted by distance, then row.

    Collecting members is for inspection; censuses never need it. Points are scaled by the pixel factor, seeds are not.
    """
    scaled = points.select(*(F.col(c) if c not in axes else (F.col(c) * F.lit(pixel_to_micron)).alias(c) for c in points.columns))
    own = seeds if seeds is not None else scaled.select((F.col("row_id") + 1).alias("nbhd"), *axes)
    if max_neighborhoods is not None:
        own = own.orderBy("nbhd").limit(max_neighborhoods)
    carried = [c for c in points.columns if c != "row_id"]
    joined = ball_join(own.select("nbhd", *axes), scaled, radius, axes)
    member = F.struct("d2", F.col("p_row_id").alias("row_id"), *(F.col(f"p_{c}").alias(c) for c in carried))
    rows = joined.groupBy("nbhd", *axes).agg(F.sort_array(F.collect_list(member)).alias("members"))
    name = F.concat_ws("_", F.lit("patch"), *(F.col(a).cast("string") for a in axes[:2]), F.lit(f"{radius:g}"))
    return rows.select("nbhd", F.array(*axes).alias("center"), F.lit(float(radius)).alias("radius"), name.alias("patch_id"), "members")


def summarize_neighbourhoods(patches: DataFrame) -> dict:
    """Count, total, mean, median, population deviation, least and most members of the neighbourhoods."""
    sizes = patches.groupBy("radius", "nbhd").agg(F.sum("area").alias("n"))
    row = sizes.agg(F.count("*").alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max")).first()
    return row.asDict()


def standardize(censuses: Sequence[DataFrame]) -> list[DataFrame]:
    """The same columns in the same order for all: variables in natural order, then X, Y, Z, Radius; 0 where missing."""
    names = natural_sort(sorted({c for df in censuses for c in df.columns if c not in RESERVED}))
    tail = [c for c in RESERVED if any(c in df.columns for df in censuses)]
    return [df.select(*((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in [*names, *tail])) for df in censuses]


def census_from_neighborhoods(rows: DataFrame, variables: Sequence[str], include_coordinates: bool = True, one_based: bool = True) -> DataFrame:
    """Wide rows of neighbourhoods (nbhd, center, radius, values map<string,double>): missing values 0, coordinates + 1, Z 0 in 2-D."""
    shift = 1 if one_based else 0
    place = [(F.try_element_at("center", F.lit(k + 1)) + shift).alias(a) if k < 2 else F.coalesce(F.try_element_at("center", F.lit(3)) + shift, F.lit(0.0)).alias(a) for k, a in enumerate(("X", "Y", "Z"))]
    return rows.select(*(F.coalesce(F.try_element_at("values", F.lit(v)), F.lit(0.0)).alias(v) for v in variables), *(place if include_coordinates else []), F.col("radius").alias("Radius"))


__all__ = ["CensusResult", "census_coordinates", "census_from_neighborhoods", "census_of_seeds", "census_table", "create_neighborhoods", "eligible", "gathered_patches", "member_patches", "neighbourhoods", "object_points", "sites", "standardize", "summarize_neighbourhoods"]
