"""Censuses of tables and images on hand-checked inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import volumes
from cellweave.operators import census, image, patches
from cellweave.plans import random_plan
from cellweave.sources.images import array_voxels


def rows(df, *columns):
    return [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]


CELLS = [(0.0, 0.0, 0.0, 9), (1.0, 0.0, 0.0, 1), (4.0, 0.0, 0.0, 2)] + [(100.0 + 10 * k, 0.0, 0.0, o) for k, o in enumerate((3, 4, 5, 6, 7, 8, 10, 11))]


def test_one_seed_of_an_allowed_object(spark):
    table = spark.createDataFrame(CELLS, "X double, Y double, Z double, Object long")
    got = census.census_table(table, 1.1, 1, seed_objects=[9], sample_indices=[0])
    assert got.census.columns == ["O1.1", "O1.9", "X", "Y", "Z", "Radius"]
    assert rows(got.census, *got.census.columns) == [(50.0, 50.0, 0.0, 0.0, 0.0, 1.1)]
    assert sorted(rows(got.patches, "nbhd", "area", "object")) == [(1, 1, 1), (1, 1, 9)]
    assert got.metadata["radius_keys"] == ["1.1"] and got.summary()["mean"] == 2


def test_linked_means_and_two_radii(spark):
    table = spark.createDataFrame([(float(k), 0.0, 0.0, o, float(10 * k)) for k, o in enumerate((1, 1, 2, 2, 1))], "X double, Y double, Z double, Object long, m double")
    got = census.census_table(table, [1.0, 1.5], 3, links=[("O1.1", "S1.1"), ("O1.2", "S1.1")], sample_indices=[0, 2, 4], order=["X"])
    first = {r["X"]: r for r in got.census.where("Radius = 1.5").collect()}
    assert first[0.0]["O1.1"] == 100 and first[0.0]["O1.1_S1.1"] == 5.0
    assert abs(first[2.0]["O1.1"] - 100 / 3) < 1e-12 and first[2.0]["O1.2_S1.1"] == 25.0
    assert got.census.count() == 6 and got.variables == ["O1.1", "O1.1_S1.1", "O1.2", "O1.2_S1.1"]


def test_errors_and_samples(spark):
    table = spark.createDataFrame(CELLS, "X double, Y double, Z double, Object long")
    with pytest.raises(ValueError, match="fewer objects"):
        census.census_table(table, 1.0, 20)
    with pytest.raises(ValueError, match="starts with"):
        census.census_table(table.drop("Z"), 1.0, 1)
    with pytest.raises(ValueError, match="finite"):
        census.census_table(table.withColumn("X", F.lit(float("nan"))), 1.0, 1)
    with pytest.raises(ValueError, match="numbers"):
        census.census_table(table.withColumn("s", F.lit("a")), 1.0, 1)
    with pytest.raises(ValueError, match="twice"):
        census.census_table(table, 1.0, 2, sample_indices=[0, 0])
    a, b = (rows(census.census_table(table, 2.0, 4, random_state=5).seeds, "nbhd", "x") for _ in range(2))
    assert sorted(a) == sorted(b) and len({x for _, x in a}) == 4


def test_coordinate_census(spark):
    table = spark.createDataFrame([(0.0, 0.0, 1, 2.0), (1.0, 0.0, 2, 4.0), (0.0, 1.0, 1, 6.0), (5.0, 5.0, 2, 8.0)], "x double, y double, object_id long, marker double")
    got = census.census_coordinates(table, 1.0, ["marker"], object_column="object_id", order=["marker"])
    assert got.columns == ["nbhd", "O1.1", "O1.2", "marker", "X", "Y", "Z", "Radius"]
    first = got.where("nbhd = 1").first()
    assert abs(first["O1.1"] - 200 / 3) < 1e-9 and first["marker"] == 4.0 and first["Z"] == 0.0
    with pytest.raises(ValueError):
        census.census_coordinates(table.drop("y"), 1.0)


def test_neighborhoods_are_ordered_by_distance(spark):
    points = spark.createDataFrame([(k, float(x), 0.0, 0.0) for k, x in enumerate((0, 3, 1, 2))], "row_id long, x double, y double, z double")
    got = census.create_neighborhoods(points, 2.0, max_neighborhoods=1).first()
    assert [m["row_id"] for m in got["members"]] == [0, 2, 3] and got["patch_id"].startswith("patch_")


def test_standardize(spark):
    a = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "`O1.10` double, `O1.1` double, X double, Radius double")
    b = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "`O1.2` double, `S1.1` double, Y double, Z double, Radius double")
    one, two = census.standardize([a, b])
    assert one.columns == two.columns == ["O1.1", "O1.2", "O1.10", "S1.1", "X", "Y", "Z", "Radius"]
    assert rows(one, *one.columns) == [(2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 4.0)]


PATCHES = [(1.0, "O1", 1, 0, 2, 1, [10.0]), (1.0, "O1", 1, 1, 1, 2, [9.0]), (1.0, "O1", 2, 2, 0, 0, [0.0]), (1.0, "O1", 3, 3, 3, 1, [12.0]), (1.0, "O1", 3, 4, 1, 2, [1.0])]


def test_patch_summary(spark):
    df = spark.createDataFrame(PATCHES, patches.PATCH)
    long = patches.summarize(df, [("O1.1", "S1.1")])
    wide = patches.to_wide(long, patches.neighbourhoods(df)).orderBy("nbhd")
    assert wide.columns == ["radius", "nbhd", "O1.1", "O1.1_S1.1", "O1.2"]
    got = [[round(v, 3) for v in r] for r in rows(wide, "O1.1", "O1.2", "O1.1_S1.1")]
    assert got == [[66.667, 33.333, 5.0], [0.0, 0.0, 0.0], [75.0, 25.0, 4.0]]


def test_scalar_only_group(spark):
    df = spark.createDataFrame([(1.0, "S2", 1, 0, 2, None, [4.0, 8.0]), (1.0, "S2", 1, 1, 1, None, [6.0, 3.0]), (1.0, "S2", 2, 2, 1, None, [1.0, 5.0])], patches.PATCH)
    got = {(r["nbhd"], r["var"]): r["value"] for r in patches.summarize(df).collect()}
    assert got[(1, "S2.2")] == 11 / 3 and patches.summarize(df, [("O1.1", "S2.1")]).isEmpty()


def test_random_census_keeps_area_and_density(spark):
    rows_ = [(1.0, "O1", n, k + 3 * (n - 1), a, 1, [2.0 * a]) for n in (1, 2) for k, a in enumerate((1, 2, 3))]
    df = spark.createDataFrame(rows_, patches.PATCH)
    got = {(r["nbhd"], r["var"]): r["value"] for r in patches.random_census(df, random_plan.shuffle_key(3, "patch_id"), [("O1.1", "S1.1")]).collect()}
    assert got == {(n, v): x for n in (1, 2) for v, x in (("O1.1", 100.0), ("O1.1_S1.1", 2.0))}


def test_random_census_by_a_plan(spark):
    # Area 2,1,3,2 in the order 4,3,2,1: neighbourhoods end at 3 and 8.
    df = spark.createDataFrame([(1.0, "O1", 1, 0, 2, 1, [4.0]), (1.0, "O1", 1, 1, 1, 2, [8.0]), (1.0, "O1", 2, 2, 3, 1, [12.0]), (1.0, "O1", 2, 3, 2, 2, [10.0])], patches.PATCH)
    got = {(r["nbhd"], r["var"]): round(r["value"], 6) for r in patches.random_census(df, F.desc("patch_id"), [("O1.1", "S1.1")]).collect()}
    assert got == {(1, "O1.1"): 33.333333, (1, "O1.2"): 66.666667, (2, "O1.1"): 80.0, (2, "O1.2"): 20.0, (1, "O1.1_S1.1"): 4.0, (2, "O1.1_S1.1"): 3.0}


def test_components():
    mask = np.zeros((4, 4, 4), bool)
    for p in ((0, 0, 0), (1, 1, 1), (3, 0, 0)):
        mask[p] = True
    labels = patches.label_components(mask)
    assert labels[0, 0, 0] == labels[1, 1, 1] == 1 and labels[3, 0, 0] == 2


def test_patch_sizes(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (3, 0, 0)], "x long, y long, z long")
    assert sorted(rows(patches.patch_sizes(df), "size", "rank")) == [(1, 2), (2, 1), (2, 1)]


def test_remap_is_simultaneous(spark):
    labels = array_voxels(spark, "O1", np.array([[7, 7, 8], [7, 8, 8], [0, 0, 0]]))
    own = spark.createDataFrame([(1, 1, 0, 0)], "nbhd int, x long, y long, z long")
    wide, _ = image.census_image(labels, {2.0: [2, 2, 1]}, seeds=own, object_remap={"O1": {7: 8}})
    assert "O1.7" not in wide.columns and wide.first()["O1.8"] == 100.0
    swapped = image.remap_objects(labels, "O1", {7: 8, 8: 7})
    assert swapped.where("value = 7").count() == 3


def test_linked_channels(spark):
    voxels = array_voxels(spark, "O1", np.ones((3, 3))).unionByName(array_voxels(spark, "S1", np.stack([np.full((3, 3), 10.0), np.full((3, 3), 20.0)], 2)))
    own = spark.createDataFrame([(1, 1, 1, 0)], "nbhd int, x long, y long, z long")
    wide, _ = image.census_image(voxels, {1.0: [1, 1, 1]}, links=[("O1.1", "S1.1"), ("O1.1", "S1.2")], seeds=own)
    row = wide.first()
    assert (row["O1.1_S1.1"], row["O1.1_S1.2"]) == (10.0, 20.0) and (row["X"], row["Y"], row["Z"]) == (2.0, 2.0, 1.0)


def test_scalar_patches_and_prefix(spark):
    voxels = array_voxels(spark, "O1", np.ones((5, 5))).unionByName(array_voxels(spark, "S2", np.eye(5) * 200))
    wide, rows_ = image.census_image(voxels, {1.0: [1, 1, 1], 2.0: [2, 2, 1]}, [5, 3], components=True)
    one, two = ([tuple(r)[-4:-1] for r in wide.where(F.col("Radius") == r).collect()] for r in (1.0, 2.0))
    assert len(one) == 5 and len(two) == 3 and set(two) <= set(one)
    total = rows_.where("grp = 'S2.1' AND radius = 2.0").groupBy("nbhd").agg(F.sum("area").alias("a")).collect()
    assert all(r["a"] <= 13 for r in total)


def test_thresholds(spark):
    seven = array_voxels(spark, "S1", np.full((2, 2), 7.0))
    two = array_voxels(spark, "S2", np.array([[0.0, 10.0]]))
    many = array_voxels(spark, "S3", np.array([[10.0, 12.0, 200.0, 210.0]]))
    got = {r["image"]: r["threshold"] for r in image.isodata_thresholds(seven.unionByName(two).unionByName(many)).collect()}
    assert got["S1"] == 7 and got["S2"] == 1
    t = next(t for t in range(11, 256) if (a := [v for v in (200, 210) if v > t]) and round(((lambda low: sum(low) / len(low) if low else 0)([v for v in (10, 12, 200, 210) if v < t]) + sum(a) / len(a)) / 2) == t)
    assert got["S3"] == t


def test_eligible_seeds(spark):
    objects = array_voxels(spark, "O1", np.array([[1, 0], [0, 0]]))
    scalars = array_voxels(spark, "S1", np.array([[0.0, 255.0], [0.0, 0.0]])).unionByName(array_voxels(spark, "S3", np.array([[0.0, 0.0], [0.0, 255.0]])))
    limits = spark.createDataFrame([("S1", 1, 128), ("S3", 1, 128)], "image string, c int, threshold int")
    got = image.eligible_seeds(objects.unionByName(scalars), limits, [("O1.1", "S1.1")])
    assert sorted(rows(got, "x", "y", "position")) == [(0, 0, 0), (1, 1, 1)]


def test_volumes_and_bins():
    assert volumes.ellipsoid_volumes([[1, 1, 1], [2, 2, 1]], [20, 20, 5]) == [7, 15]
    assert [volumes.compositional_bins(d, 4) for d in (1, 2, 3)] == [4, 10, 15]
    assert volumes.compositional_bins(2, 3, [80, 0, 0], [100, 50, 100]) == 7
    assert volumes.suggest_radii([10, 20], [0.284, 0.284, 0.5]) == [[35, 35, 20], [70, 70, 40]]
    with pytest.raises(ValueError):
        volumes.normalize_radii([0])


def test_suggested_numbers(spark):
    voxels = array_voxels(spark, "O1", np.ones((5, 5)))
    assert image.suggest_number(voxels, 2.0, [[1, 1, 1], [2, 2, 1]], [5, 5, 1]) == [10, 4]


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(5)
    got = sorted(rows(random_plan.with_row_id(df, "v"), "row_id", "v"))
    assert [r for r, _ in got] == list(range(1000)) and [v for _, v in got] == sorted(v for _, v in got)


def test_plans(spark):
    assert random_plan.composed([[0, 3, 2, 5, 1, 4], [2, 1, 5, 3, 0, 4]]) == [[0, 3, 2, 5, 1, 4], [2, 3, 4, 5, 0, 1]]
    with pytest.raises(ValueError):
        random_plan.permutation_plan(spark, [[0, 0]])
    got = random_plan.md5_permutations(spark.range(20).withColumnRenamed("id", "pos"), 3, 1)
    for step in range(3):
        own = rows(got.where(F.col("step") == step), "pos", "src")
        assert sorted(p for p, _ in own) == sorted(s for _, s in own) == list(range(20))


def test_components_of_any_size_equal_flood_fill(spark):
    rng = np.random.default_rng(4)
    masks = {k: rng.random((6, 7, 5)) < 0.2 for k in (1, 2)}
    members = [(k, *map(int, p)) for k, m in masks.items() for p in np.argwhere(m)]
    df = spark.createDataFrame(members, "k long, x long, y long, z long")
    got = {(r["k"], r["x"], r["y"], r["z"]): r["component"] for r in patches.component_ids(df, ["k"]).collect()}
    assert got == {m: int(patches.label_components(masks[m[0]])[m[1:]]) for m in members}
    sizes = {(r["x"], r["y"], r["z"]): r["size"] for r in patches.patch_sizes(df.where("k = 1").drop("k")).collect()}
    labels = patches.label_components(masks[1])
    assert sizes == {m[1:]: int((labels == labels[m[1:]]).sum()) for m in members if m[0] == 1}


def test_coordinate_census_joins_places_and_not_rows(spark, monkeypatch):
    from cellweave.operators import range_join

    # 2,000 rows on four places: their pairs are 4 million, those of places and objects at most 32.
    data = [(k, float(k % 2), float(k // 2 % 2), "ab"[k % 3 == 0], None if k % 5 == 0 else float(k)) for k in range(2000)]
    table = spark.createDataFrame(data, "row_id long, x double, y double, o string, v double")
    made = []
    monkeypatch.setattr(census, "ball_join", lambda *a, **k: made.append(range_join.ball_join(*a, **k)) or made[-1])
    got = {r["nbhd"]: r for r in census.census_coordinates(table, 1.0, ["v"], object_column="o").collect()}
    assert made[0].count() <= 32 and len(got) == 2000
    for nbhd in (1, 2, 3, 2000):
        own = data[nbhd - 1]
        near = [d for d in data if (d[1] - own[1]) ** 2 + (d[2] - own[2]) ** 2 <= 1]
        known = [d[4] for d in near if d[4] is not None]
        assert abs(got[nbhd]["O1.b"] - 100 * sum(d[3] == "b" for d in near) / len(near)) < 1e-9
        assert abs(got[nbhd]["v"] - sum(known) / len(known)) < 1e-9 and (got[nbhd]["X"], got[nbhd]["Y"]) == own[1:3]


def test_object_census_of_repeated_parts(spark, tmp_path, monkeypatch):
    import duckdb

    from cellweave import queries
    from cellweave.operators import range_join

    # 3,000 parts of three sizes and keys of one place: 1 million pairs of rows a place, but six of places and brands.
    rows_ = [(50 * k, k % 3 * 10, f"Brand#{k % 2}") for k in range(3000)]
    spark.createDataFrame(rows_, "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = []
    monkeypatch.setattr(census, "ball_join", lambda *a, **k: made.append(range_join.ball_join(*a, **k)) or made[-1])
    got = {tuple(r) for r in queries.coord_census_objects(spark, str(tmp_path)).collect()}
    assert made[0].count() == 6
    sql = queries.SQL["coord_census_objects"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall()) and len(got) == 6000
