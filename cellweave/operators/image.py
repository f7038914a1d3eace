"""Censuses of voxel tables.

A voxel row is (image, x, y, z, c, value), zero-based, c from 1; object maps (O<n>) have one channel and
leave background (0) out, scalar maps (S<n>) hold whole numbers from 0 to 255.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.volumes import ellipsoid_volume, normalize_radii, normalize_sizes
from cellweave.names import image_group
from cellweave.operators.patches import component_ids, neighbourhoods, summarize, to_wide, variable_names
from cellweave.operators.range_join import AXES, lattice_join
from cellweave.plans.random_plan import materialize, sample_by_hash, with_row_id


def remap_objects(voxels: DataFrame, image: str, mapping: dict[int, int]) -> DataFrame:
    """voxels with the labels of one object map rewritten, all at once; a new label 0 drops the voxel."""
    if not mapping:
        return voxels
    table = F.create_map(*(F.lit(float(x)) for pair in mapping.items() for x in pair))
    new = F.when(F.col("image") == image, F.coalesce(F.try_element_at(table, F.col("value")), F.col("value"))).otherwise(F.col("value"))
    return voxels.withColumn("value", new).where(~((F.col("image") == image) & (F.col("value") == 0)))


def isodata_thresholds(voxels: DataFrame) -> DataFrame:
    """(image, c, threshold) of the scalar maps, from their 256-level histograms.

    One level: that level. Two levels: the lower one + 1. Else the first t above the lowest non-zero level for
    which the half-even mean of the averages below and above t is t; t - 1 where nothing lies above; 255 at last.
    """
    counts = voxels.where(F.col("image").startswith("S")).groupBy("image", "c", F.col("value").cast("int").alias("t")).agg(F.count("*").alias("n"))
    # 256 rows for each channel, whatever the image's size.
    levels = counts.select("image", "c").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(255))))
    levels = levels.join(counts, ["image", "c", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy("image", "c")
    so_far = own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    lit, mass = F.when(F.col("t") > 0, F.col("n")).otherwise(0), F.col("t") * F.col("n")
    levels = levels.select("*", F.sum(lit).over(so_far).alias("cn"), F.sum(mass).over(so_far).alias("cm"), F.sum(lit).over(own).alias("an"), F.sum(mass).over(own).alias("am"), F.min(F.when((F.col("t") > 0) & (F.col("n") > 0), F.col("t"))).over(own).alias("p"))
    low = F.coalesce((F.col("cm") - mass) / F.nullif(F.col("cn") - lit, F.lit(0)), F.lit(0.0))
    above = F.col("an") - F.col("cn")
    high = (F.col("am") - F.col("cm")) / F.nullif(above, F.lit(0))
    meets = (F.col("t") > F.col("p")) & ((above == 0) | (F.rint((low + high) / 2) == F.col("t")))
    levels = levels.withColumn("try", F.when(meets, F.when(above == 0, F.col("t") - 1).otherwise(F.col("t"))))
    seen = F.when(F.col("n") > 0, F.col("t"))
    found = levels.groupBy("image", "c").agg(F.count(seen).alias("kinds"), F.min(seen).alias("least"), F.min_by("try", F.when(F.col("try").isNotNull(), F.col("t"))).alias("first"))
    chosen = F.when(F.col("kinds") == 1, F.col("least")).when(F.col("kinds") == 2, F.col("least") + 1).otherwise(F.coalesce("first", F.lit(255)))
    return found.select("image", "c", chosen.cast("int").alias("threshold"))


def linked_scalars(links: Sequence[tuple[str, str]]) -> list[str]:
    """Scalar maps tied to an object map."""
    return sorted({s.split(".")[0] for _, s in links})


def eligible_seeds(voxels: DataFrame, thresholds: DataFrame, links: Sequence[tuple[str, str]] = (), allowed: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """(x, y, z, position) of the voxels that may be seeds, in row-major order.

    A voxel counts with a label (an allowed one, if its map is listed) or an intensity at or over the threshold
    of a scalar map that is not linked.
    """
    objects = voxels.where(F.col("image").startswith("O") & (F.col("value") != 0))
    for image, ids in (allowed or {}).items():
        objects = objects.where((F.col("image") != image) | F.col("value").isin([float(i) for i in ids]))
    scalars = voxels.where(F.col("image").startswith("S") & ~F.col("image").isin(linked_scalars(links)))
    lit = scalars.join(F.broadcast(thresholds), ["image", "c"]).where(F.col("value") >= F.col("threshold"))  # a row for each channel
    places = objects.select(*AXES).union(lit.select(*AXES)).distinct()
    return with_row_id(places, *AXES, name="position")


def _layers(voxels: DataFrame, links: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, int]]]:
    """Object map -> its linked channels, as (scalar map, channel)."""
    out: dict[str, list[tuple[str, int]]] = {}
    for o, s in links:
        m, c = s.split(".")
        if (m, int(c)) not in out.setdefault(o.split(".")[0], []):
            out[o.split(".")[0]].append((m, int(c)))
    return out


def object_patches(members: DataFrame, voxels: DataFrame, image: str, channels: Sequence[tuple[str, int]], components: bool) -> DataFrame:
    """Patch rows of one object map: a row for each object of a neighbourhood, or for each of its connected components."""
    own = members.where(F.col("image") == image).select("radius", "nbhd", *AXES, F.col("value").cast("long").alias("object"))
    for k, (m, c) in enumerate(channels):
        scalar = voxels.where((F.col("image") == m) & (F.col("c") == c)).select(*AXES, F.col("value").alias(f"s{k}"))
        own = own.join(scalar, list(AXES), "left")
    s = F.array(*(F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(len(channels)))) if channels else F.array().cast("array<double>")
    if components:
        own = component_ids(own, ["radius", "nbhd", "object"])
    else:
        own = own.withColumn("component", F.lit(1).cast("long"))
    rows = own.groupBy("radius", "nbhd", "object", "component").agg(F.count("*").alias("area"), s.alias("s"))
    return rows.select("radius", F.lit(image).alias("grp"), "nbhd", (F.col("object") * 1_000_000 + F.col("component")).alias("patch_id"), "area", "object", "s")


def scalar_patches(members: DataFrame, thresholds: DataFrame, image: str, components: bool) -> DataFrame:
    """Patch rows of a scalar map on its own: voxels at or over the threshold and those under it, by channel."""
    own = members.where(F.col("image") == image).join(F.broadcast(thresholds), ["image", "c"])
    own = own.select("radius", "nbhd", "c", *AXES, "value", (F.col("value") >= F.col("threshold")).cast("int").alias("lit"))
    own = component_ids(own, ["radius", "nbhd", "c", "lit"]) if components else own.withColumn("component", F.lit(1).cast("long"))
    rows = own.groupBy("radius", "nbhd", "c", "lit", "component").agg(F.count("*").alias("area"), F.sum("value").alias("v"))
    grp = F.concat(F.lit(image + "."), F.col("c").cast("string"))
    # The channel's value stands at its place of the array; other places are 0 and belong to other groups.
    return rows.select("radius", grp.alias("grp"), "nbhd", ((1 - F.col("lit")) * 1_000_000 + F.col("component")).alias("patch_id"), "area", F.lit(None).cast("long").alias("object"), F.array("v").alias("s"))


def census_image(voxels: DataFrame, radii: dict[float, Sequence[float]] | float | Sequence[float], sample_size: int | Sequence[int] | None = None, links: Sequence[tuple[str, str]] = (), *, seeds: DataFrame | None = None, seed_indices: Sequence[int] | None = None, allowed: dict[str, Sequence[int]] | None = None, object_remap: dict[str, dict[int, int]] | None = None, random_state: int | str = 0, components: bool = False, two_dimensional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(wide census, patch rows) of images; coordinates of the census are one-based.

    radii maps a radius to its semi-axes in voxels, or lists isotropic ones (z is 1 for a flat image). All radii
    share one order of seeds and take a prefix. Values are the same with and without `components`; they only
    split patches for the null model.
    """
    for image, mapping in (object_remap or {}).items():
        voxels = remap_objects(voxels, image, mapping)
    axes = {float(r): [float(v) for v in a] for r, a in radii.items()} if isinstance(radii, dict) else {r: [r, r, 1.0 if two_dimensional else r] for r in normalize_radii(radii)}
    sizes = normalize_sizes(sample_size, len(axes))
    thresholds = isodata_thresholds(voxels)
    if seeds is None:
        pool = eligible_seeds(voxels, thresholds, links, allowed)
        if seed_indices is not None:
            from cellweave.plans.random_plan import sample_by_plan

            seeds = sample_by_plan(pool, seed_indices).select("nbhd", *AXES)
        else:
            if any(s is None for s in sizes):
                raise ValueError("without seeds their number is needed")
            seeds = sample_by_hash(pool, max(sizes), random_state, row="position").select("nbhd", *AXES)
    images = sorted(r["image"] for r in voxels.select("image").distinct().collect())
    object_maps, scalar_maps = ([i for i in images if image_group(i)[0] == k] for k in "OS")
    layers = _layers(voxels, links)
    alone = [s for s in scalar_maps if s not in linked_scalars(links)]
    patches = None
    rows = None
    for (radius, semi), size in zip(axes.items(), sizes, strict=True):
        own = seeds.where(F.col("nbhd") <= size) if size is not None else seeds
        joined = lattice_join(own.select(F.col("nbhd").cast("int").alias("nbhd"), *AXES), voxels, semi)
        members = joined.select(F.lit(radius).alias("radius"), "nbhd", *(F.col(f"p_{a}").alias(a) for a in AXES), F.col("p_image").alias("image"), F.col("p_c").alias("c"), F.col("p_value").alias("value"))
        parts = [object_patches(members, voxels, m, layers.get(m, []), components) for m in object_maps]
        parts += [scalar_patches(members, thresholds, s, components) for s in alone]
        for part in parts:
            patches = part if patches is None else patches.unionByName(part)
        place = own.select(F.lit(radius).alias("radius"), F.col("nbhd").cast("int").alias("nbhd"), *((F.col(a) + 1).cast("double").alias(a.upper()) for a in AXES))
        rows = place if rows is None else rows.unionByName(place)
    long = materialize(summarize_images(patches, links))
    names = variable_names(long)
    wide = to_wide(long, rows, ("radius", "nbhd"), names)
    return wide.select(*(F.col(f"`{n}`") for n in names), *AXES_UP, F.col("radius").alias("Radius")), patches


AXES_UP = [a.upper() for a in AXES]


def summarize_images(patches: DataFrame, links: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """As patches.summarize; the group of a scalar map's channel carries the channel in its name."""
    scalar = patches.where(F.col("object").isNull()).groupBy("radius", "grp", "nbhd").agg(F.sum("area").alias("area"), F.sum(F.get("s", F.lit(0))).alias("v"))
    means = scalar.select("radius", "nbhd", F.col("grp").alias("var"), (F.col("v") / F.col("area")).alias("value"))
    return summarize(patches.where(F.col("object").isNotNull()), links).unionByName(means)


def suggest_number(voxels: DataFrame, coverage: float, semi_axes: Sequence[Sequence[float]], dims: Sequence[int], links: Sequence[tuple[str, str]] = ()) -> list[int]:
    """Seeds that cover the foreground `coverage` times at each radius: ceil(coverage * foreground / ellipsoid volume)."""
    if not 0 < coverage < float("inf") or not semi_axes:
        raise ValueError("name radii and a positive coverage")
    if coverage > 5:
        warnings.warn("Coverage exceeding 5x will yield invalid inference due to pseudo-replication", RuntimeWarning, stacklevel=2)
    seen = voxels.where((F.col("value") != 0) & ~F.col("image").isin(linked_scalars(links))).select(*AXES).distinct().count()
    return [-int(-(coverage * seen) // ellipsoid_volume(s, dims)) for s in semi_axes]


def flat_voxels(df: DataFrame, image: str, x: str = "x", y: str = "y", z: str | None = None, channels: Sequence[str] = ("value",)) -> DataFrame:
    """Voxel rows of a table with a column for each channel."""
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("c"), F.col(c).cast("double").alias("value")) for k, c in enumerate(channels))))
    place = [F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), (F.col(z) if z else F.lit(0)).cast("long").alias("z")]
    return df.select(F.lit(image).alias("image"), *place, each.alias("e")).select("image", *AXES, "e.c", "e.value")


def first_seen_palette(pixels: DataFrame, background: str | None = None) -> DataFrame:
    """(color, label): colours numbered from 1 by their first pixel in column-major order, background left out."""
    first = pixels.groupBy("color").agg(F.min(F.struct("z", "x", "y")).alias("first"))
    if background is not None:
        first = first.where(F.col("color") != background)
    return first.select("color", F.row_number().over(Window.orderBy("first")).cast("int").alias("label"))


__all__ = ["census_image", "eligible_seeds", "first_seen_palette", "flat_voxels", "isodata_thresholds", "neighbourhoods", "remap_objects", "suggest_number"]
