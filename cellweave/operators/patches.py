"""Patches: summaries per neighbourhood, shuffled reference censuses, connected components.

A patch row is (radius, grp, nbhd, patch_id, area, object, s array<double>): `object` is null in a
scalar-only group, `s` holds the sums of the group's channels. Patches of objects alone may be gathered:
(radius, grp, nbhd, object, area, n) stands for n patches alike. Censuses stay long, (radius, nbhd, var, value),
until `to_wide`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.names import natural_sort
from cellweave.operators.range_join import interval_join
from cellweave.plans.random_plan import key_heads, materialize, running, shuffle_key, stored, with_row_id

PATCH = "radius double, grp string, nbhd int, patch_id long, area long, object long, s array<double>"


def _name(group: Column, suffix: Column) -> Column:
    return F.concat(group, F.lit("."), suffix.cast("string"))


def summarize(patches: DataFrame, links: Sequence[tuple[str, str]] = (), keys: Sequence[str] = ("radius",)) -> DataFrame:
    """(keys, nbhd, var, value): object percentages, channel means and linked means of each neighbourhood.

    links are (object variable, scalar variable) pairs such as ("O1.2", "S1.1"). Only patches with area
    count. Percentages are of the objects' own total. A scalar-only group whose map is linked is left out.
    """
    live = patches.where("area > 0").withColumn("map", F.split("grp", r"\.")[0])
    linked_maps = sorted({s.split(".")[0] for _, s in links})
    objects = live.where(F.col("object").isNotNull()).groupBy(*keys, "grp", "nbhd", "object").agg(F.sum("area").alias("area"))
    whole = Window.partitionBy(*keys, "grp", "nbhd")
    percent = objects.select(*keys, "nbhd", _name(F.col("grp"), F.col("object")).alias("var"), (100 * F.col("area") / F.sum("area").over(whole)).alias("value"))
    channels = live.where(F.col("object").isNull() & ~F.col("map").isin(linked_maps)).select(*keys, "nbhd", "map", "area", F.posexplode("s").alias("c", "v"))
    means = channels.groupBy(*keys, "nbhd", "map", "c").agg(F.sum("v").alias("v"), F.sum("area").alias("area"))
    means = means.select(*keys, "nbhd", _name(F.concat(F.lit("S"), F.substring("map", 2, 9)), F.col("c") + 1).alias("var"), (F.col("v") / F.col("area")).alias("value"))
    out = percent.unionByName(means)
    if links:
        wanted = F.array(*(F.lit(f"{o}_{s}") for o, s in links))
        inside = live.where(F.col("object").isNotNull()).select(*keys, "grp", "nbhd", "object", "area", F.posexplode("s").alias("c", "v"))
        inside = inside.groupBy(*keys, "grp", "nbhd", "object", "c").agg(F.sum("v").alias("v"), F.sum("area").alias("area"))
        maps = F.create_map(*(F.lit(x) for o, s in dict((o.split(".")[0], s.split(".")[0]) for o, s in links).items() for x in (o, s)))
        var = F.concat(_name(F.col("grp"), F.col("object")), F.lit("_"), _name(maps[F.col("grp")], F.col("c") + 1))
        linked = inside.select(*keys, "nbhd", var.alias("var"), (F.col("v") / F.col("area")).alias("value")).where(F.array_contains(wanted, F.col("var")))
        out = out.unionByName(linked)
    return out


def neighbourhoods(patches: DataFrame, keys: Sequence[str] = ("radius",)) -> DataFrame:
    """(keys, nbhd): 1 to the largest number seen, empty ones included."""
    most = patches.groupBy(*keys).agg(F.max("nbhd").alias("n"))
    return most.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nbhd"))


def variable_names(long: DataFrame) -> list[str]:
    """The variables of a long census in natural order; as many rows as the schema will have columns."""
    return natural_sort([r["var"] for r in long.select("var").distinct().collect()])


def to_wide(long: DataFrame, rows: DataFrame, keys: Sequence[str] = ("radius", "nbhd"), names: Sequence[str] | None = None) -> DataFrame:
    """One row for each of rows (keys, ...), a column for each variable, 0 where it is absent."""
    names = list(names) if names is not None else variable_names(long)
    wide = long.groupBy(*keys).pivot("var", names).agg(F.first("value")) if names else long.select(*keys).distinct()
    out = rows.join(wide, list(keys), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names))


def _ends(extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, grp, ne, ns, nbhd): where neighbourhoods (keys, grp, nbhd, total) start and end on the line."""
    by_nbhd = Window.partitionBy(*keys, "grp").orderBy("nbhd")
    extents = extents.withColumn("ne", F.sum("total").over(by_nbhd).cast("double")).withColumn("ns", F.col("ne") - F.col("total"))
    # Zero-area neighbourhoods share their end with an earlier one; ends count once.
    ends = extents.groupBy(*keys, "grp", "ne").agg(F.min("ns").alias("ns"))
    return ends.withColumn("nbhd", F.row_number().over(Window.partitionBy(*keys, "grp").orderBy("ne")).cast("int"))


def random_census(patches: DataFrame, order: Column | str, links: Sequence[tuple[str, str]] = (), keys: Sequence[str] = ("radius",), block: float | None = None) -> DataFrame:
    """(keys, nbhd, var, value) of a census of shuffled patches.

    Patches are laid end to end in `order` (a plan's position or a shuffle key); the line is cut where the
    neighbourhoods end. A patch gives each neighbourhood its share of area and of scalar mass. Neighbourhoods
    without area, but for a leading one, drop out and later ones move up, as in the original method.
    """
    if not links:
        # Without links the channels of objects count nowhere: they need not be sorted along.
        patches = patches.withColumn("s", F.when(F.col("object").isNull(), F.col("s")))
    extents = patches.groupBy(*keys, "grp", "nbhd").agg(F.sum("area").alias("total"))
    ends = _ends(extents, keys)
    line = running(patches.where("area > 0"), "area", "pe", [*keys, "grp"], order, "patch_id")
    line = line.withColumn("pe", F.col("pe").cast("double")).withColumn("ps", F.col("pe") - F.col("area"))
    line = line.select(*keys, "grp", "patch_id", "area", "object", "s", "ps", "pe")
    if block is None:
        block = float(extents.agg(F.greatest(F.max("total"), F.lit(1))).first()[0])
    cut = interval_join(line, ends, [*keys, "grp"], ("ps", "pe"), ("ns", "ne"), block)
    share = F.col("overlap_end") - F.col("overlap_start")
    cut = cut.withColumn("part", share / F.col("area")).withColumn("s", F.transform("s", lambda v: v * F.col("part")))
    pieces = cut.select(*keys, "grp", "nbhd", "patch_id", share.alias("area"), "object", "s")
    return summarize(pieces, links, keys)


#: Ends of neighbourhoods, over all replicates, that are sent to every task.
MAX_ENDS = 500_000
#: Sums that a task holds: bins of all replicates and objects.
MAX_SUMS = 1 << 24
#: Patches for each end, from which summing by bins is less than putting all in order.
BIN_ROWS = 100
#: Bins that are summed up as one row.
CHUNK_BINS = 1 << 10


def shuffled_objects(patches: DataFrame, areas: DataFrame, replicates: int, seed: int | str) -> DataFrame | None:
    """(radius, replicate, nbhd, var, value) as `random_census` of patches in md5 order, for each replicate; None if it does not apply.

    The first bits of the md5 keys cut the line into bins. A bin inside one neighbourhood is summed by object where its
    patches are made; only patches of bins with an end of a neighbourhood are dealt out and put in order. For patches of
    objects alone, many to each end; areas (radius, grp, nbhd, object, area) are theirs.
    """
    cells = [tuple(r) for r in areas.select("radius", "grp", "object").distinct().limit((MAX_SUMS >> 8) + 1).collect()]
    extents = areas.groupBy("radius", "grp", "nbhd").agg(F.sum("area").alias("total"))
    size = extents.groupBy("radius", "grp").agg(F.sum("total").alias("n"), F.count("*").alias("k")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("k").alias("most"), F.max("n").alias("line")).first()
    if not 0 < len(cells) <= MAX_SUMS >> 8 or any(c[2] is None for c in cells) or size["k"] * replicates > MAX_ENDS or size["n"] < BIN_ROWS * size["k"] or size["line"] >= 1 << 53:
        return None
    bits = (MAX_SUMS // (len(cells) * replicates)).bit_length() - 1
    if 1 << max(0, bits) < max(8 * size["most"], CHUNK_BINS):
        return None
    spark, shift, bins = patches.sparkSession, np.uint64(64 - bits), 1 << bits
    groups = sorted({c[:2] for c in cells})
    group = np.array([groups.index(c[:2]) for c in cells])
    ends: dict[int, list[float]] = {g: [] for g in range(len(groups))}
    for r in _ends(extents, ["radius"]).orderBy("radius", "grp", "ne").collect():
        ends[groups.index((r["radius"], r["grp"]))].append(r["ne"])
    names = F.broadcast(spark.createDataFrame([(*c, k, int(group[k])) for k, c in enumerate(cells)], "radius double, grp string, object long, cell int, g int"))
    each = patches.where("area > 0").join(names, ["radius", "grp", "object"]).select("patch_id", "area", "cell")

    def keyed(frames):
        for f in frames:
            rows = [b"%d" % i for i in f["patch_id"].tolist()]
            for step in range(replicates):
                yield f, step, (key_heads(f"{seed}-{step + 1}", rows) >> shift).astype(np.int64)

    def summed(frames):
        sums = np.zeros((replicates, len(cells) * bins), np.int64)
        for f, step, at in keyed(frames):
            np.add.at(sums[step], f["cell"].to_numpy(np.int64) * bins + at, f["area"].to_numpy(np.int64))
        for step in range(replicates):
            for cell in range(len(cells)):
                parts = sums[step, cell * bins : (cell + 1) * bins].reshape(-1, CHUNK_BINS)
                found = np.flatnonzero(parts.any(axis=1))
                if len(found):
                    yield pd.DataFrame({"g": int(group[cell]), "replicate": step + 1, "chunk": found, "cell": cell, "total": parts[found].sum(axis=1), "sums": [_packed(parts[k]) for k in found]})

    def merged(f):
        out = [(cell, sum(map(_unpacked, own["sums"]))) for cell, own in f.groupby("cell")]
        return pd.DataFrame([(f["g"][0], f["replicate"][0], f["chunk"][0], cell, x.sum(), _packed(x)) for cell, x in out], columns=["g", "replicate", "chunk", "cell", "total", "sums"])

    def placed(f):
        own = {c: _unpacked(x) for c, x in zip(f["cell"], f["sums"], strict=True)}
        area, ne = sum(own.values()), np.array(ends[int(f["g"][0])])
        stop = f["start"][0] + np.cumsum(area)
        first, last = np.searchsorted(ne, stop - area, "right"), np.searchsorted(ne, stop, "left")
        cut = np.flatnonzero((area > 0) & (first < last))
        out = [(-1, None, int(f["chunk"][0]) * CHUNK_BINS + k, float(stop[k] - area[k])) for k in cut.tolist()]
        for cell, x in own.items():
            x[cut] = 0
            live = np.flatnonzero(x)
            to, at = np.unique(first[live], return_inverse=True)
            out += [(cell, n + 1, None, v) for n, v in zip(to.tolist(), np.bincount(at, x[live], len(to)).tolist(), strict=True)]
        return pd.DataFrame([(f["g"][0], f["replicate"][0], *x) for x in out], columns=["g", "replicate", "cell", "nbhd", "bin", "value"]).astype({"nbhd": "Int64", "bin": "Int64"})

    counted = "g int, replicate int, chunk long, cell int, total long, sums binary"
    own = stored(each.mapInPandas(summed, counted).groupBy("g", "replicate", "chunk").applyInPandas(merged, counted))
    before = Window.partitionBy("g", "replicate").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("g", "replicate", "chunk").agg(F.sum("total").alias("total")).withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("double")).drop("total")
    told = stored(own.join(starts, ["g", "replicate", "chunk"]).groupBy("g", "replicate", "chunk").applyInPandas(placed, "g int, replicate int, cell int, nbhd long, bin long, value double"))
    near = told.where("cell < 0").select("g", "replicate", "bin", F.col("value").alias("start"))
    marks = [(r["g"], r["replicate"], r["bin"]) for r in near.select("g", "replicate", "bin").collect()]

    def beside_ends(frames):
        hit = np.zeros((replicates, len(groups), bins), bool)
        for g, step, k in marks:
            hit[step - 1, g, k] = True
        for f, step, at in keyed(frames):
            keep = hit[step, group[f["cell"].to_numpy(np.int64)], at]
            yield f[keep].assign(replicate=step + 1, bin=at[keep])

    dealt = each.mapInPandas(beside_ends, "patch_id long, area long, cell int, replicate int, bin long")
    dealt = dealt.join(names.select("cell", "g"), "cell").repartition("g", "replicate", "bin").withColumn("__order", shuffle_key(F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string")), F.col("patch_id")))
    inner = Window.partitionBy("g", "replicate", "bin").orderBy("__order", "patch_id").rowsBetween(Window.unboundedPreceding, 0)
    line = dealt.withColumn("pe", F.sum("area").over(inner)).join(near, ["g", "replicate", "bin"])
    line = line.select("g", "replicate", "cell", (F.col("start") + F.col("pe") - F.col("area")).alias("ps"), (F.col("start") + F.col("pe")).alias("pe"))
    block = float(extents.agg(F.greatest(F.max("total"), F.lit(1))).first()[0])
    where = _ends(extents, ["radius"]).join(names.select("radius", "grp", "g").distinct(), ["radius", "grp"]).select("g", "nbhd", "ns", "ne")
    cut = interval_join(line, where, ["g"], ("ps", "pe"), ("ns", "ne"), block).select("replicate", "cell", "nbhd", (F.col("overlap_end") - F.col("overlap_start")).alias("value"))
    pieces = told.where("cell >= 0").select("replicate", "cell", F.col("nbhd").cast("int").alias("nbhd"), "value").unionByName(cut)
    pieces = stored(pieces.groupBy("replicate", "cell", "nbhd").agg(F.sum("value").alias("area")).join(names, "cell"))
    return summarize(pieces.withColumn("s", F.lit(None).cast("array<double>")), (), ["radius", "replicate"])


#: Neighbourhoods times kinds of patches (objects and areas) whose sums one task draws.
MAX_DRAWN = 1 << 21


def drawn_line(counts: np.ndarray, areas: np.ndarray, ends: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """[interval, kind]: the area of each kind between ascending ends, when counts[kind] patches of areas[kind] are laid end to end in random order.

    Exact and for all patches, without making any: with independent uniform keys, which order patches like a shuffle, the
    first half of a range of keys holds a binomial number of each kind. Ranges are halved until no end lies inside, or a
    single patch, which is cut. Work grows with the ends and the logarithm of the patches.
    """
    out = np.zeros((len(ends), len(counts)), np.float64)
    start, held = np.zeros(1, np.int64), np.asarray(counts, np.int64)[None]
    while len(start):
        stop = start + held @ areas
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        whole, single = first == last, held.sum(axis=1) == 1
        np.add.at(out, first[whole], held[whole] * areas)
        for k in np.flatnonzero(single & ~whole).tolist():
            cuts = np.unique(np.concatenate(([start[k]], ends[first[k] : last[k]], [stop[k]])))
            np.add.at(out, (first[k] + np.arange(len(cuts) - 1), int(held[k].argmax())), np.diff(cuts))
        open_ = ~whole & ~single
        start, held = start[open_], held[open_]
        left = rng.binomial(held, 0.5)
        start, held = np.concatenate((start, start + left @ areas)), np.concatenate((left, held - left))
        live = held.any(axis=1)
        start, held = start[live], held[live]
    return out


def drawn_objects(patches: DataFrame, replicates: int, seed: int | str) -> DataFrame | None:
    """(radius, replicate, nbhd, var, value) as `random_census` of shuffled patches (radius, grp, nbhd, object, area, n), n alike a row, for each replicate.

    The order of a shuffle is drawn, not made, by `drawn_line`; a generator for each radius, group and replicate takes its
    seed from md5, so that partitions do not matter. None if a group has more neighbourhoods and kinds than a task should hold.
    """
    kinds = patches.groupBy("radius", "grp").agg(F.count_distinct("nbhd").alias("k"), F.count_distinct("object", "area").alias("c"), F.max(F.col("object").isNull()).alias("lacking"), F.sum(F.col("area") * F.col("n").cast("double")).alias("line"))
    found = kinds.agg(F.max(F.col("k") * F.col("c")).alias("most"), F.max("lacking").alias("lacking"), F.max("line").alias("line")).first()
    if found["lacking"]:
        raise ValueError("patches gathered by their number are of objects alone")
    if (found["most"] or 0) > MAX_DRAWN or (found["line"] or 0) >= 1 << 53:
        return None

    def drawn(f):
        radius, grp, replicate = f["radius"].iloc[0], f["grp"].iloc[0], int(f["replicate"].iloc[0])
        total = f["area"].to_numpy(np.int64) * f["n"].to_numpy(np.int64)
        # Neighbourhoods without area share their end with an earlier one, and ends count once.
        ends = np.unique(np.cumsum(pd.Series(total).groupby(f["nbhd"].to_numpy()).sum().to_numpy()))
        kind = f[total > 0].groupby(["object", "area"])["n"].sum().reset_index()
        areas = kind["area"].to_numpy(np.int64)
        key = hashlib.md5(f"{seed}-{replicate}|{float(radius)!r}|{grp}".encode()).digest()
        sums = drawn_line(kind["n"].to_numpy(np.int64), areas, ends, np.random.Generator(np.random.PCG64(int.from_bytes(key, "big"))))
        at, which = np.nonzero(sums)
        return pd.DataFrame({"radius": radius, "grp": grp, "replicate": replicate, "nbhd": at + 1, "object": kind["object"].to_numpy()[which], "area": sums[at, which]})

    each = patches.select("radius", "grp", "nbhd", "object", "area", "n").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    pieces = stored(each.groupBy("radius", "grp", "replicate").applyInPandas(drawn, "radius double, grp string, replicate int, nbhd int, object long, area double"))
    return summarize(pieces.withColumn("s", F.lit(None).cast("array<double>")), (), ["radius", "replicate"])


def _packed(x: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "i8") if k == "i8" or x.max() <= np.iinfo(k).max)
    return kind.encode() + zlib.compress(x.astype(kind).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[2:]), x[:2].decode()).astype(np.int64)


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. of the 26-connected components of a 3-D mask, in row-major order of their first voxel; 0 outside."""
    at = np.argwhere(mask)
    index = {tuple(p): k for k, p in enumerate(at.tolist())}
    parent = list(range(len(at)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    earlier = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)]
    for k, (x, y, z) in enumerate(at.tolist()):
        for a, b, c in earlier:
            if (j := index.get((x + a, y + b, z + c))) is not None:
                i, j = find(k), find(j)
                parent[max(i, j)] = min(i, j)
    out = np.zeros(mask.shape, np.int64)
    names: dict[int, int] = {}
    for k, p in enumerate(at.tolist()):
        out[tuple(p)] = names.setdefault(find(k), len(names) + 1)
    return out


def component_ids(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """members (keys, x, y, z, ...) with component (1.. inside each key, by first voxel), 26-connected."""
    place = [*keys, "x", "y", "z"]
    found = wide_components(members.select(*place), keys)
    nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy("component")).cast("long")
    return members.join(found.withColumn("component", nth), place).select(*members.columns, "component")


def wide_components(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """members (keys, x, y, z) with component: the number of its first voxel in row-major order.

    For masks of any size: neighbours meet in an equi-join on shifted places and components are closed over the
    edges, so no task holds a whole mask.
    """
    from cellweave.operators.networks import components

    at = ("x", "y", "z")
    numbered = materialize(with_row_id(members.distinct(), *keys, *at, name="id"))
    earlier = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)))
    moved = numbered.withColumn("o", F.explode(earlier)).select(*keys, *((F.col(a) + F.col(f"o.{a}")).alias(a) for a in at), F.col("id").alias("j"))
    edges = materialize(numbered.join(moved, [*keys, *at]).select(F.col("id").alias("i"), "j"))
    return numbered.join(components(numbered.select("id"), edges), "id").drop("id")


def patch_sizes(members: DataFrame) -> DataFrame:
    """(x, y, z, size, rank) of a mask's voxels: components ranked by size, the largest first, ties by first voxel."""
    labelled = wide_components(members.select("x", "y", "z"))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    ranked = with_row_id(sizes, F.desc("size"), "component", name="__rank").withColumn("rank", (F.col("__rank") + 1).cast("int")).drop("__rank")
    return labelled.join(ranked, "component").drop("component")


