"""Distributions, information, diversity, spatial statistics, patterns and networks on hand-checked inputs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import queries
from cellweave.functions.scalar import normal_sf, round_to_bins
from cellweave.operators import census, composition, distribution, networks, patterns, range_join, spatial, viewdata
from cellweave.operators import mutual_information as mi
from cellweave.plans import random_plan
from cellweave.plans.random_plan import permutation_plan


def values(df, column):
    return [r[column] for r in df.select(f"`{column}`").collect()]


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.9, 4.1, 5.0)], "v double")
    assert values(df.select(round_to_bins(F.col("v"), 0, 5, 4).alias("b")), "b") == [1, 2, 3, 3, 4]
    assert np.allclose(values(df.select(round_to_bins(F.col("v"), 0, 5, 4, True).alias("b")), "b"), [0, 5 / 3, 10 / 3, 10 / 3, 5])
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 2.5, 5.0, 6.0)], "v double")
    assert values(df.select(round_to_bins(F.col("v"), 0, 5, 3).alias("b")), "b") == [1, 1, 2, 3, 3]
    assert values(df.select(round_to_bins(F.col("v"), 3, 3, 3).alias("b")), "b") == values(df, "v")


def test_dist_and_smoothing(spark):
    df = spark.createDataFrame([(0.0, 10.0), (0.0, 20.0), (1.0, 10.0), (1.0, 20.0), (1.0, 20.0)], "`O1.1` double, `S1.1` double")
    got = sorted(map(tuple, distribution.build_dist(df, ["O1.1", "S1.1"]).collect()))
    assert got == [(0, 10, 1), (0, 20, 1), (1, 10, 1), (1, 20, 2)]
    one = spark.createDataFrame([(0.0, 1), (1.0, 2)], "`S1.1` double, freq long")
    freq = values(distribution.smooth_dist(one, ["S1.1"], 4, {"S1.1": (0.0, 3.0)}).orderBy("pos"), "freq")
    assert np.allclose(freq, [0.297619, 0.595238, 0.0535714, 0.0535714], atol=1e-6)
    two = spark.createDataFrame([(0.0, 10.0, 1), (1.0, 20.0, 2)], "`O1.1` double, `S1.1` double, freq long")
    freq = values(distribution.smooth_dist(two, ["O1.1", "S1.1"], [2, 3], {"O1.1": (0.0, 1.0), "S1.1": (10.0, 30.0)}).orderBy("pos"), "freq")
    assert np.allclose(freq, [0.297619, 0.0267857, 0.0267857, 0.595238, 0.0267857, 0.0267857], atol=1e-6)
    full = spark.createDataFrame([(0.0, 3), (1.0, 4)], "`S1.1` double, freq long")
    assert np.allclose(values(distribution.smooth_dist(full, ["S1.1"], 2, {"S1.1": (0.0, 1.0)}).orderBy("pos"), "freq"), [3 / 7, 4 / 7])
    mask = spark.createDataFrame([(0.0, 100.0, 5), (100.0, 0.0, 2)], "`O1.1` double, `O1.2` double, freq long")
    freq = values(distribution.smooth_dist(mask, ["O1.1", "O1.2"], 2, {"O1.1": (0.0, 100.0), "O1.2": (0.0, 100.0)}).orderBy("pos"), "freq")
    assert freq[3] is None and abs(sum(freq[:3]) - 1) < 1e-12


def test_entropy_of_pairs(spark):
    rows = spark.createDataFrame([(1.0, 0, [a, b], n) for a, b, n in ((1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2))], "radius double, replicate int, b array<long>, n long")
    got = mi.entropies(rows, [(0, 1)], 2).first()["h"]
    assert abs(got - 1.92192809488736) < 1e-12


def test_constant_census_has_no_information(spark):
    df = spark.createDataFrame([(100.0, 100.0, 1.1)] * 40, "`O1.1` double, `O2.1` double, Radius double")
    got = mi.measure_cis_mi(df, 2, [df, df], max_bins=5).collect()
    assert [(r["VA"], r["VB"], r["CisMI"], r["Zscore"], r["Pvalue"], r["Padjust"]) for r in got] == [("O1.1", None, 0, 0, 1, 1), ("O2.1", None, 0, 0, 1, 1), ("O1.1", "O2.1", 0, 0, 1, 1)]


def test_cis_mi_of_patches(spark):
    from cellweave.operators import patches

    rows = [(1.1, g, n, 0, 1, 1, []) for g in ("O1", "O2") for n in range(1, 41)]
    df = spark.createDataFrame([(100.0, 100.0, 1.1)] * 40, "`O1.1` double, `O2.1` double, Radius double")
    got = mi.measure_cis_mi(df, 2, patches=spark.createDataFrame(rows, patches.PATCH), bootstraps=2, max_bins=5)
    assert [(r["CisMI"], r["Zscore"], r["Pvalue"]) for r in got.collect()] == [(0, 0, 1)] * 3
    assert mi.null_provenance(True, False)["mode"] == "strict"


def test_cis_mi_against_counts(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 400).astype(float)
    b = np.where(rng.random(400) < 0.7, a, rng.integers(0, 4, 400)).astype(float)
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b, strict=True)], "`S1.1` double, `S1.2` double, Radius double")
    nulls = [spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, rng.permutation(b), strict=True)], df.schema) for _ in range(3)]

    def h(*columns):
        _, n = np.unique(np.stack(columns), axis=1, return_counts=True)
        p = n / n.sum()
        return -(p * np.log2(p)).sum()

    info = lambda x, y: h(x) + h(y) - h(x, y)
    base = [info(*np.array([tuple(r)[:2] for r in d.collect()]).T) for d in nulls]
    got = mi.measure_cis_mi(df, 2, nulls, bins=4).where("VB IS NOT NULL").first()
    assert abs(got["CisMI"] - (info(a, b) - np.mean(base))) < 1e-9
    z = (info(a, b) - np.mean(base)) / np.std(base, ddof=1)
    assert abs(got["Zscore"] - z) < 1e-6 and abs(got["Pvalue"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    assert mi.measure_cis_mi(df, 2, bootstraps=4, allow_permutation=True).count() == 3
    with pytest.raises(ValueError):
        mi.measure_cis_mi(df, 2)


SPECIMENS = [([20] * 20 + [80] * 20, [1] * 20 + [4] * 20), ([20] * 10 + [80] * 30, [1] * 30 + [4] * 10), ([20, 80] * 20, [1, 4] * 20), ([20, 20, 80, 80] * 10, [1, 4, 1, 4] * 10)]


def test_trans_mi_against_published_values(spark):
    frames = []
    for o, s in SPECIMENS:
        rows = [(float(x), 100.0 - x, float(y), x * y / 100, 0.0, 0.0, 0.0, 1.1) for x, y in zip(o, s, strict=True)]
        frames.append(spark.createDataFrame(rows, "`O1.1` double, `O1.2` double, `S1.1` double, `O1.1_S1.1` double, X double, Y double, Z double, Radius double"))
    got = mi.measure_trans_mi(frames, {"Status": ["A", "A", "B", "B"]}, 2, max_bins=5, plan=[[0, 3, 2, 5, 1, 4], [2, 1, 5, 3, 0, 4]])
    row = got.where("VA = 'O1.1' AND VB IS NULL").first()
    assert abs(row["TransMI"] - 0.08) < 1e-10 and abs(row["Zscore"] + 0.0707106781186554) < 1e-9 and abs(row["Pvalue"] - 0.528185988898509) < 1e-10
    assert got.count() == 10


def test_ensembles_and_variables():
    names = ["O1.1", "O1.2", "S1.1"]
    assert mi.ensembles(names, 2, all_of=["S1.1"]) == [(0,), (1,), (2,), (0, 2), (1, 2)]
    assert mi.ensembles(names, 2, any_of=["O1.1"]) == [(0,), (1,), (2,), (0, 1), (0, 2)]
    assert mi.chosen_variables([*names, "X", "Radius"], 2, not_of=["O1.2"]) == ["O1.1", "S1.1"]
    assert mi.chosen_variables(names, 2, all_of=["O1.1"], any_of=["S1.1"]) == ["O1.1", "S1.1"]
    assert mi.bins_for(20, 2) == 1 and mi.bins_for(999, 1) == 100


def test_tail(spark):
    got = values(spark.createDataFrame([(0.0,), (1.96,), (-1.0,)], "z double").select(normal_sf("z").alias("p")), "p")
    assert np.allclose(got, [0.5, 0.0249978951, 0.8413447461])


def test_diversity(spark):
    parts = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id int, mass double")
    got = composition.alpha_diversity(parts, ids=2).orderBy("id").collect()
    assert [round(r["percent"], 2) for r in got] == [66.67, 33.33] and abs(got[0]["entropy"] - 0.9182958340544896) < 1e-12
    both = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 2.0)], "parent int, id int, mass double")
    table, beta = composition.beta_diversity(both, spark.createDataFrame([(1, 2.0), (2, 2.0)], "parent int, weight double"), 2)
    assert {(r["parent"], r["id"]): (r["percent"], r["entropy"]) for r in table.collect()} == {(1, 1): (50, 1), (1, 2): (50, 1), (2, 1): (100, 0), (2, 2): (0, 0)}
    q, e = 0.75, 1e-6 / 2
    b = 0.5 * (0.5 * math.log2(0.5 / q) + 0.5 * math.log2(0.5 / 0.25)) + 0.5 * (1 / (1 + e) * math.log2(1 / (1 + e) / q) + e / (1 + e) * math.log2(e / (1 + e) / 0.25))
    assert abs(beta - b) < 1e-12


def test_merging(spark):
    profile = spark.createDataFrame([(1, 10, 1.0, 5.0), (2, 30, 3.0, 1.0), (3, 20, 9.0, 2.0)], "Object long, Count long, S1 double, S2 double")
    got = composition.merge_profile(profile, [[1, 2]]).orderBy("Object").collect()
    assert [tuple(r) for r in got] == [(1, 40, 2.5, 2.0), (2, 20, 9.0, 2.0)]
    with pytest.raises(ValueError):
        composition.merge_profile(profile, [[1, 9]])
    codes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "value long")
    assert sorted(values(composition.renumber(codes, "value", [[1, 2]], True), "value")) == [0, 1, 1, 2]
    assert composition.merge_palette(["red", "green", "blue"], [[1, 2]]) == ["red", "blue"]
    rest, chosen = composition.remaining_and_selected(profile, [[1, 2]])
    assert rest.count() == 1 and chosen.count() == 2


PLACES = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 1.0)]


@pytest.mark.parametrize("rule", spatial.RULES)
def test_weights_match_brute_force(spark, rule):
    points = spark.createDataFrame(PLACES, "row_id long, x double, y double")
    got = {(r["i"], r["j"]): r["w"] for r in spatial.weights(points, rule, threshold=1.5, k=2).collect()}
    xy = np.array([p[1:] for p in PLACES])
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    axes = (np.abs(xy[:, None] - xy[None]) > 1e-12).sum(2)
    box = np.abs(xy[:, None] - xy[None]).max(2)
    if rule == "knn":
        w = np.zeros_like(d)
        for i in range(5):
            w[i, np.argsort(d[i], kind="stable")[1:3]] = 1
        w = np.maximum(w, w.T)
    else:
        w = {"rook": ((axes == 1) & (box <= 1.5)) * 1.0, "queen": ((axes > 0) & (box <= 1.5)) * 1.0, "distance_band": ((d > 0) & (d <= 1.5)) * 1.0, "inverse_distance": np.where((d > 0) & (d <= 1.5), 1 / np.maximum(d, 1e-9), 0), "kernel": np.where(d <= 1.5, np.exp(-0.5 * (d / 1.5) ** 2), 0)}[rule]
    np.fill_diagonal(w, 0)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    for i in range(5):
        for j in range(5):
            assert abs(got.get((i, j), 0.0) - w[i, j]) < 1e-12


def test_spatial_statistics(spark):
    points = spark.createDataFrame([(*p, v) for p, v in zip(PLACES, (1.0, 2.0, 1.5, 4.0, 5.0), strict=True)], "row_id long, x double, y double, value double")
    edges = spatial.weights(points, "distance_band", threshold=1.5)
    w = np.zeros((5, 5))
    for r in edges.collect():
        w[r["i"], r["j"]] = r["w"]
    x = np.array([1.0, 2.0, 1.5, 4.0, 5.0])
    z = x - x.mean()
    i = spatial.morans_i(points, edges).first()
    assert abs(i["observed"] - 5 / w.sum() * (z @ w @ z) / (z @ z)) < 1e-12 and i["expected"] == -0.25
    s1, s2 = 0.5 * ((w + w.T) ** 2).sum(), ((w.sum(1) + w.sum(0)) ** 2).sum()
    b2, t = 5 * (z**4).sum() / (z @ z) ** 2, w.sum()
    var = (5 * (13 * s1 - 5 * s2 + 3 * t * t) - b2 * (20 * s1 - 10 * s2 + 6 * t * t)) / (24 * t * t) - 1 / 16
    assert abs(i["variance"] - max(var, spatial.EPS)) < 1e-10
    c = spatial.gearys_c(points, edges).first()
    assert abs(c["observed"] - 4 * (w * (x[:, None] - x[None]) ** 2).sum() / (2 * t * (z @ z))) < 1e-12
    s = z / x.std(ddof=1)
    lag = w @ s
    got = {r["row_id"]: r for r in spatial.lisa(points, edges).collect()}
    for k in range(5):
        assert abs(got[k]["local"] - s[k] * lag[k]) < 1e-12 and got[k]["quadrant"] == ("H" if s[k] >= 0 else "L") + ("H" if lag[k] >= 0 else "L")
    g = {r["row_id"]: r for r in spatial.getis_ord(points, edges).collect()}
    v = x.var(ddof=1) * np.maximum((5 * (w**2).sum(1) - w.sum(1) ** 2) / 4, 0)
    assert all(abs(g[k]["z"] - ((w @ x)[k] - x.mean() * w.sum(1)[k]) / math.sqrt(v[k])) < 1e-9 for k in range(5))
    with pytest.raises(ValueError):
        spatial.morans_i(points.withColumn("value", F.lit(1.0)), edges)
    assert spatial.describe_weights(points, edges)["mean_neighbors"] == w.astype(bool).sum(1).mean()


def test_line_of_four(spark):
    line = spark.createDataFrame([(k, float(k), 0.0) for k in range(4)], "row_id long, x double, y double")
    got = {(r["i"], r["j"]) for r in spatial.weights(line, "distance_band", threshold=1.1, row_standardize=False).collect()}
    assert (0, 1) in got and (0, 2) not in got
    assert spatial.default_threshold(line) == 1.0


def test_3d_connectivity(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "row_id long, x double, y double, z double")
    assert spatial.connectivity_summary(points, 6, 2.0)["num_edges"] == 1
    full = spatial.connectivity_summary(points, 26, 2.0)
    assert full["num_edges"] == 3 and full["num_components"] == 1 and full["mean_clustering_coefficient"] == 1.0
    assert spatial.default_threshold(points, ("x", "y", "z"), 3) == math.sqrt(2)
    weighted = spatial.weights_3d(points.withColumn("volume", F.lit(4.0)), 26, threshold=2.0, volume="volume", row_standardize=False)
    assert {(r["i"], r["j"]): r["w"] for r in weighted.collect()}[(0, 1)] == 4.0


def test_permutation_plan(spark):
    points = spark.createDataFrame([(k, float(k + 1), float(k), 0.0) for k in range(4)], "row_id long, value double, x double, y double")
    plan = permutation_plan(spark, [[3, 2, 1, 0], [1, 0, 3, 2]])
    out, null = spatial.permutation_test(points, lambda v, xy: v[0] - v[-1], plan=plan)
    assert out["observed"] == -3 and sorted(values(null, "value")) == [-1, 3] and out["p_value"] == 2 / 3
    assert spatial.volume_blocks(points.withColumn("volume", F.col("x"))).select("block").distinct().count() == 1


def test_som(spark):
    data = np.array([[float(k % 5), float(k // 5)] for k in range(15)])
    initial = np.array([[0.0, 0.0], [2.0, 1.0], [4.0, 2.0]])
    orders = [list(range(15)), list(range(14, -1, -1))]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "row_id long, v array<double>")
    som = patterns.fit_map(rows.repartition(3), plan=patterns.MapPlan(nodes=3, rounds=2), start=initial, orders=orders)
    w = initial.copy()
    for t in range(2):
        rate, radius = 0.05 * math.exp(-t / 2 * math.log(5)), max(1.0 * (1 - t / 2), 1.0)
        for k in orders[t]:
            best = int(((data[k] - w) ** 2).sum(1).argmin())
            w += rate * np.exp(-((np.arange(3) - best) ** 2) / (2 * radius**2))[:, None] * (data[k] - w)
    assert np.allclose(som.weights, w)
    far = ((data[:, None] - som.weights) ** 2).sum(2)
    got = {r["row_id"]: r["node"] for r in range_join.nearest(rows, som.weights.tolist(), "v").collect()}
    assert [got[k] for k in range(15)] == far.argmin(1).tolist()
    assert som.history["round"].tolist() == [0, 1] and np.isclose(som.history["error"].iloc[-1], np.sqrt(far.min(1)).mean())
    both = patterns.fit_maps(rows.withColumn("map", F.explode(F.array(F.lit("a"), F.lit("b")))), patterns.MapPlan(nodes=3, rounds=2), start=initial, orders=orders)
    assert {(r["map"], r["at"]): r["v"] for r in both.where("part = 'node'").collect()} == {(m, k): w.tolist() for m in "ab" for k, w in enumerate(som.weights)}
    with pytest.raises(ValueError, match="every row once"):
        patterns.train(data, patterns.MapPlan(nodes=3, rounds=1), initial, [[0] * 15])


def test_ring_and_bounds_of_a_map(monkeypatch, spark):
    assert patterns.MapPlan(ring=True).apart(5)[0].tolist() == [0, 1, 2, 2, 1] and patterns.MapPlan().apart(3)[2].tolist() == [2, 1, 0]
    monkeypatch.setattr(patterns, "MAX_ROWS", 3)
    with pytest.raises(ValueError, match="sample"):
        patterns.fit_map(spark.range(5).selectExpr("id row_id", "array(double(id)) v"))


def test_rolling_in_blocks_equals_one_window(spark, monkeypatch):
    df = spark.range(300).selectExpr("id pos", "int(id div 30) node", "double(id * 37 % 101) y")
    whole = patterns._rolling(df, "y", "Y", 5, [], 300, 0.9, "s", True).orderBy("pos").collect()
    monkeypatch.setattr(patterns, "BLOCK_ROWS", 7)
    assert patterns._rolling(df, "y", "Y", 5, [], 300, 0.9, "s", True).orderBy("pos").collect() == whole and len(whole) == 300


def test_learned_pattern(spark):
    rows = [(k, 20.0 * k, 5.0 - k, float(1 + k // 3), float(1 + k % 3), 1.0, 1.0) for k in range(6)]
    census = spark.createDataFrame(rows, "row_id long, `O1.1` double, `S1.1` double, X double, Y double, Z double, Radius double")
    table, som = patterns.learn_pattern(census, ["O1.1", "S1.1"], 1.0, smooth_window=2, rounds=2)
    assert table.count() == 12 and {"X", "Y", "Ymin", "Ymax", "V", "Enr", "Y_norm", "Ymin_norm", "Ymax_norm"} == set(table.columns)
    x = sorted(values(table.where("V = 'O1.1'"), "X"))
    assert np.allclose(x, np.linspace(0, 100, 6)) and set(values(table, "Enr")) == {1.0} and len(som.weights) == 6
    assert table.where("Ymin > Y OR Ymax < Y").isEmpty()
    enriched, _ = patterns.learn_pattern(census, ["O1.1"], 1.0, smooth_window=0, rounds=1, reference=census)
    assert all(abs(v) < 1e-12 for v in values(enriched, "Enr"))


def test_mapped_pattern(spark):
    path = spark.createDataFrame([(x, y, v) for v, ys in (("O1.1", (0.0, 50.0, 100.0)), ("S1.1", (0.0, 0.0, 0.0))) for x, y in zip((0.0, 50.0, 100.0), ys, strict=True)], "X double, Y double, V string")
    census = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0)], "`O1.1` double, `S1.1` double, X double, Y double, Z double, Radius double")
    voxels = spark.createDataFrame([(x, y, 0, 0.0 if (x, y) == (0, 0) else 1.0) for x in range(3) for y in range(3)], "x long, y long, z long, value double")
    got, palette = patterns.map_pattern(path, [[0, 40], [60, 100]], voxels, census, 1.0, [1, 1, 1], ["#FF0000", "#0000FF"])
    labels = {(r["x"], r["y"]): r["label"] for r in got.collect()}
    assert labels[(1, 1)] == 1 and labels[(0, 0)] == 0 and labels[(0, 1)] == 1 and palette == ["#FF0000", "#0000FF"]
    assert patterns.regions([[0, 40], [60, 100]]) == ([(0.0, 1), (40.0, 3), (60.0, 2)], 3)


def distances(spark, m):
    return spark.createDataFrame([(i, j, float(m[i][j])) for i in range(len(m)) for j in range(len(m))], "i long, j long, d double")


def test_networks(spark):
    m = [[0, 0.1, 2, 2], [0.1, 0, 2, 2], [2, 2, 0, 0.1], [2, 2, 0.1, 0]]
    net = networks.build(distances(spark, m), method="fixed", value=0.5, groups=["a", "a", "b", "b"])
    assert net.topology["num_edges"] == 2 and net.topology["num_components"] == 2
    found = networks.detect_communities(net, distances=distances(spark, m))
    assert found["num_communities"] == 2 and found["silhouette"] > 0.8 and found["stability"] == 1.0
    assert networks.detect_communities(net, "label_propagation")["num_communities"] == 2
    assert abs(found["modularity"] - 0.5) < 1e-12
    q = networks.group_modularity(net, plan=[[0, 2, 1, 3], [0, 1, 2, 3]])
    assert abs(q["observed"] - 0.5) < 1e-12 and q["null"][1] == q["observed"] and q["p_value"] == 2 / 3
    with pytest.raises(ImportError):
        networks.detect_communities(net, "leiden")
    with pytest.raises(ValueError):
        networks.build(distances(spark, [[0, 1], [2, 0]]))


def test_centrality_of_a_path(spark):
    path = networks.Network(spark.createDataFrame([(k, str(k), None) for k in range(4)], "id long, name string, group string"), spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "i long, j long, weight double"))
    got = {r["id"]: r for r in networks.analyze(path, ["degree", "betweenness", "closeness", "pagerank"])["centrality"].collect()}
    assert abs(got[1]["betweenness"] - 2 / 3) < 1e-12 and abs(got[0]["closeness"] - 0.5) < 1e-12 and abs(sum(r["pagerank"] for r in got.values()) - 1) < 1e-6
    assert abs(got[1]["degree"] - 2 / 3) < 1e-12


def test_joins(spark):
    rng = np.random.default_rng(0)
    a = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((60, 2)) * 10)]
    df = spark.createDataFrame(a, "row_id long, x double, y double")
    got = {(r["row_id"], r["p_row_id"]) for r in range_join.ball_join(df, df, 1.7, ("x", "y")).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in a if (x - u) ** 2 + (y - v) ** 2 <= 1.7**2}
    near = {}
    for r in range_join.knn(df, 3).orderBy("i", "rank").collect():
        near.setdefault(r["i"], []).append(r["j"])
    for i, x, y in a:
        assert near[i] == [j for _, j in sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in a if j != i)[:3]]


def test_intervals_of_many_alike_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = [(int(k), n, float(s), float(s + d)) for n, (k, s, d) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-20, 40, 300), rng.integers(0, 30, 300), strict=True))]
    b = [(int(k), n, float(s), float(s + 5)) for n, (k, s) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(-2, 3, 200) * 7, strict=True))]
    a, b = a + [a[0], (0, 900, None, 5.0), (None, 901, 0.0, 5.0)], b + [b[0], (1, 900, 3.0, 3.0), (0, 901, 0.0, None), (None, 902, 0.0, 5.0)]
    left, right = spark.createDataFrame(a, "k int, i long, s1 double, e1 double"), spark.createDataFrame(b, "k int, j long, s2 double, e2 double")
    want = sorted((k, i, j, max(s, u), min(e, v)) for k, i, s, e in a for q, j, u, v in b if None not in (k, s, e, q, u, v) and k == q and max(s, u) < min(e, v))
    for size, meet, cells in ((128, 50_000, 100_000), (3, 40, 0), (2, 5, 100)):
        for name, value in (("LIST", size), ("MEET", meet), ("MAX_CELLS", cells)):
            monkeypatch.setattr(range_join, name, value)
        got = range_join.interval_join_alike(left, right, ["k"], ("s1", "e1"), ("s2", "e2"), 4.0)
        assert sorted(tuple(r) for r in got.select("k", "i", "j", "overlap_start", "overlap_end").collect()) == want and want
    assert range_join.interval_join_alike(left, right.where("j < 0"), ["k"], ("s1", "e1"), ("s2", "e2"), 4.0).count() == 0


def test_interval_overlap_keeps_many_pairs_in_few_bytes(spark, tmp_path):
    orders, customers = spark.range(3000).selectExpr("id o_orderkey", "id * 11 % 500 o_custkey"), spark.range(126_000).selectExpr("id c_custkey")
    for name, rows in (("orders", orders), ("customer", customers)):
        rows.repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    queries.QUERIES["interval_overlap"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    a = spark.read.parquet(f"{tmp_path}/orders.parquet").groupBy((F.col("o_custkey") % 7).alias("k"), (F.col("o_orderkey") % 1000).alias("s"), (F.col("o_custkey") % 30).alias("d")).count().collect()
    b = spark.read.parquet(f"{tmp_path}/customer.parquet").groupBy((F.col("c_custkey") % 7).alias("k"), (F.col("c_custkey") % 900).alias("s")).count().collect()
    pairs = sum(x["count"] * y["count"] for x in a for y in b if x["k"] == y["k"] and x["s"] < y["s"] + 5 and y["s"] < x["s"] + 1 + x["d"])
    assert rows.count() == rows.select("o_orderkey", "c_custkey").distinct().count() == pairs
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * pairs


def test_view_tables(spark):
    profile = spark.createDataFrame([(1, 1, 0.0, 5.0), (2, 1, 10.0, 5.0)], "Object int, Count int, a double, b double")
    table = lambda *a: {(r["Object"], r["component"]): r["value"] for r in viewdata.normalize_profiles(profile, *a).collect()}
    assert table("A", "U") == {(1, "a"): 0, (2, "a"): 1, (1, "b"): 0, (2, "b"): 0}
    assert table("W", "U") == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1, (2, "b"): 0}
    assert abs(table("B", "Z")[(1, "a")] + 5 / np.std([0, 5, 10, 5], ddof=1)) < 1e-12
    schema = "radius double, VA string, VB string, CisMI double, Zscore double, Pvalue double, Padjust double"
    mi_rows = spark.createDataFrame([(10.0, "O1.1", "O1.2", 0.4, 3.0, 0.01, 0.02), (20.0, "O1.1", "O1.2", 0.6, -4.0, 0.001, 0.002)], schema)
    by = viewdata.mi_by_radius(mi_rows, ["O1.2", "O1.1"]).collect()
    assert [r["metric"] for r in by] == [0.4, 0.6] and np.allclose([r["log10_p"] for r in by], [-2, -3]) and [r["size"] for r in by] == [0.5, 1.5]
    with pytest.raises(ValueError):
        viewdata.mi_by_radius(mi_rows, ["O1.3"])
    ranked, variables = viewdata.mi_rank(mi_rows, 20.0)
    assert ranked.first()["rank"] == 1 and {r["V"]: (r["z"], r["size"]) for r in variables.collect()} == {"O1.1": (4.0, 0.5), "O1.2": (4.0, 0.5)}
    assert viewdata.mi_rank(mi_rows, 20.0, mi_threshold=0.7)[0].isEmpty()
    zero = spark.createDataFrame([(1.0, f"O1.{k}", None, 0.5, z, p, p) for k, (z, p) in enumerate(((1.0, 1e-1), (2.0, 1e-2), (3.0, 1e-3), (4.0, 0.0)))], schema)
    got = viewdata.mi_rank(zero, 1.0, p_threshold=1.0)[0].orderBy("rank").first()
    assert got["z"] == 4.0 and abs(got["log10_p"] + 4) < 1e-6
    plan = {"hue_offset": 0.0, "hue_order": [1, 0], "saturation": [1.0, 1.0], "value": [1.0, 0.5]}
    assert viewdata.make_palette(2, plan=plan) == ["#00FFFF", "#800000"] and len(viewdata.make_palette(12)) == 12
    census = spark.createDataFrame([(float(k % 2), 1.0) for k in range(7)], "`S1.1` double, Radius double")
    freq = values(viewdata.distribution(census, ["S1.1"], 1.0, 5).orderBy("pos"), "freq")
    assert np.allclose(freq, [4 / 7, 3 / 7]) and viewdata.distribution(census, ["S1.1"], 1.0).count() == 7


def test_benjamini_hochberg_in_blocks_equals_one_window(spark, monkeypatch):
    monkeypatch.setattr(random_plan, "BLOCK_ROWS", 7)
    p = [None if k % 11 == 0 else (k * 37 % 101) / 101 for k in range(120)]
    got = distribution.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k long, p double"), "p").collect()
    known = sorted(v for v in p if v is not None)
    expected = {v: min(1.0, min(known[j] * len(known) / (j + 1) for j in range(len(known)) if known[j] >= v)) for v in known}
    assert len(got) == 120 and all((r["Padjust"] is None) if r["p"] is None else abs(r["Padjust"] - expected[r["p"]]) < 1e-12 for r in got)


def test_running_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(random_plan, "BLOCK_ROWS", 5)
    df = spark.range(60).selectExpr("id", "id % 3 as k", "id * id % 17 as v")
    got = {r["id"]: r["s"] for r in random_plan.running(df, "v", "s", ["k"], F.desc("id")).collect()}
    assert got == {i: sum(j * j % 17 for j in range(i, 60, 3)) for i in range(60)}
    blocks = spatial.volume_blocks(spark.range(53).selectExpr("id row_id", "double(id * 7 % 53) volume"))
    assert [r["count"] for r in blocks.groupBy("block").count().orderBy("block").collect()] == [6, 6, 6] + [5] * 7


def points_3d():
    rng = np.random.default_rng(3)
    at = [(x, y, z) for x in range(4) for y in range(4) for z in range(2)]
    return [(k, *map(float, p), float(rng.normal() + p[0]), float(rng.integers(1, 9))) for k, p in enumerate(at)]


def dense_weights(rows, volumes):
    xyz, v = np.array([r[1:4] for r in rows]), np.array([r[5] for r in rows])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    w = np.where((d > 0) & (d <= 1.5), 1 / np.where(d > 0, d, 1), 0) * (np.sqrt(v[:, None] * v[None]) if volumes else 1)
    return w / w.sum(1, keepdims=True)


def test_3d_moran_and_permutations(spark):
    rows = points_3d()
    points = spark.createDataFrame(rows, "row_id long, x double, y double, z double, value double, volume double")
    x = np.array([r[4] for r in rows])
    dense = lambda v, w: len(v) / w.sum() * ((v - v.mean()) @ w @ (v - v.mean())) / ((v - v.mean()) ** 2).sum()
    for volume in (None, "volume"):
        w = dense_weights(rows, volume)
        whole, local = spatial.morans_i_3d(points, volume=volume, threshold=1.5)
        assert abs(whole.first()["observed"] - dense(x, w)) < 1e-12 and local.count() == len(rows) and whole.first()["interpretation"].startswith("3D (26")
        steps = [list(np.random.default_rng(k).permutation(len(rows))) for k in range(4)]
        out, null = spatial.permutation_test_3d(points, volume=volume, threshold=1.5, plan=permutation_plan(spark, steps))
        assert np.allclose(sorted(values(null, "value")), sorted(dense(x[s], w) for s in steps)) and out["method"] == "explicit" and abs(out["observed"] - dense(x, w)) < 1e-12
    out, null = spatial.permutation_test_3d(points, lambda v, at, size: float(v @ size), volume="volume", permutations=6)
    assert out["method"] == "3d_volume_preserving" and out["permutations"] == 6 and abs(out["observed"] - sum(r[4] * r[5] for r in rows)) < 1e-9
    # Values stay inside blocks of like volume.
    blocked = spatial.volume_blocks(points)
    moved = spatial.permuted(blocked, 2, None, 0, "block").join(blocked.select("row_id", "block"), "row_id")
    own = {b: sorted(values(blocked.where(F.col("block") == b), "value")) for b in set(values(blocked, "block"))}
    assert all(sorted(values(moved.where((F.col("block") == b) & (F.col("step") == 1)), "value")) == v for b, v in own.items())
    with pytest.raises(ValueError, match="volume"):
        spatial.permutation_test_3d(points.withColumn("volume", F.lit(0.0)), volume="volume", permutations=1)


def test_networks_of_named_samples_and_limits(spark, monkeypatch):
    d = spark.createDataFrame([(i, j, 0.1 if i // 2 == j // 2 else 2.0) for i in range(6) for j in range(6) if i != j], "i long, j long, d double")
    net = networks.build(d, names=list("abcdef"), groups=list("xxyyzz"), method="fixed", value=0.5)
    assert {(r["name"], r["group"]) for r in net.vertices.collect()} == set(zip("abcdef", "xxyyzz", strict=True))
    assert net.topology["num_components"] == 3 and net.topology["component_sizes"] == [(2, 3)]
    assert networks._agreement({0: 0, 1: 0, 2: 1}, {0: 0, 1: 1, 2: 1}) == 1 / 3
    told = networks.group_modularity(net, nulls=3)
    assert abs(told["observed"] - 2 / 3) < 1e-12
    for package in ("leiden", "infomap"):
        with pytest.raises(ImportError):
            networks.detect_communities(net, package, iterations=1)
    monkeypatch.setattr(networks, "MAX_EDGES", 2)
    with pytest.raises(ValueError, match="too large"):
        networks.detect_communities(net)


def test_map_tables(spark):
    got = viewdata.spatial_map(spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "row_id long, value double"), classes=[(0.5, "high"), (0.0, "low")]).orderBy("row_id").collect()
    assert [(r["shade"], r["class"]) for r in got] == [(0.0, "low"), (0.5, "high"), (1.0, "high")]
    legend = viewdata.palette_table(spark, ["#FF0000", "#00FF10"], ["a", "b"]).collect()
    assert [(r["label"], r["name"], r["r"], r["g"], r["b"]) for r in legend] == [(1, "a", 255, 0, 0), (2, "b", 0, 255, 16)]


def test_patch_nulls_sum_bins_and_sort_only_near_ends(spark, monkeypatch):
    from cellweave.operators import patches

    rng = np.random.default_rng(2)
    rows = [(r, "O1", n, k, int(rng.integers(0, 4)), int(rng.integers(1, 4)), [1.0]) for r in (1.0, 2.0) for n in (1, 2, 4) for k in range(500)]
    df = spark.createDataFrame(rows, patches.PATCH)
    names = ["O1.1", "O1.2", "O1.3"]
    known = lambda: sorted((r["radius"], r["replicate"], [round(x, 9) for x in r["v"]]) for r in mi.patch_nulls(df, names, 3, 7).collect())
    sorted_rows = []
    monkeypatch.setattr(patches, "running", lambda df, *a: sorted_rows.append(df.count()) or random_plan.running(df, *a))
    monkeypatch.setattr(patches, "BIN_ROWS", 10**9)
    whole = known()
    assert len(whole) == 24 and sorted_rows
    # By bins nothing but their edges is put in order, and coarser bins change nothing.
    sorted_rows.clear()
    monkeypatch.setattr(patches, "BIN_ROWS", 1)
    assert known() == whole and not sorted_rows
    monkeypatch.setattr(patches, "CHUNK_BINS", 4)
    monkeypatch.setattr(patches, "MAX_SUMS", 1 << 12)
    assert known() == whole and not sorted_rows
    # More objects than a task has sums for are put in order as a whole.
    monkeypatch.setattr(patches, "MAX_SUMS", 1 << 10)
    assert known() == whole and sorted_rows


def test_permuted_columns_ship_packed_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(k, float(r), float(rng.integers(0, 4)), float(rng.integers(0, 300)), float(rng.normal())) for r in (1, 2) for k in range(0, 2100 * r, 3)]
    df = spark.createDataFrame(data, "row_id long, Radius double, `S1.1` double, `S1.2` double, `S1.3` double").repartition(5)
    names = ["S1.1", "S1.2", "S1.3"]
    expected = []
    for r in (1.0, 2.0):
        own = [d for d in data if d[1] == r]
        for k in (1, 2):
            order = [sorted(own, key=lambda d, k=k, a=a: hashlib.md5(f"9-{k}-{a}|{d[0]}".encode()).hexdigest()) for a in range(3)]
            expected += [(r, k, order[0][i][2], order[1][i][3], order[2][i][4]) for i in range(len(own))]
    monkeypatch.setattr(random_plan, "SLICE_VALUES", 700)
    monkeypatch.setattr(random_plan, "DEAL_ROWS", 100)
    # No row of a replicate is numbered by itself.
    numbered = []
    monkeypatch.setattr(random_plan, "with_row_id", lambda *a, **k: numbered.append(1))
    got = [(r["radius"], r["replicate"], *r["v"]) for r in mi.permuted_nulls(df, names, 2, 9).collect()]
    assert sorted(got) == sorted(expected) and not numbered


def test_drawn_lines_are_those_of_shuffles():
    import itertools

    from cellweave.operators import patches

    counts, areas, ends = np.array([2, 1, 1]), np.array([1, 2, 3]), np.array([0, 2, 3, 7])

    def cut(order):
        out, at = np.zeros((4, 3)), 0
        for k in order:
            for i in range(4):
                out[i, k] += max(0, min(ends[i], at + areas[k]) - max(ends[i - 1] if i else 0, at))
            at += areas[k]
        return tuple(out.ravel())

    orders = [cut(o) for o in itertools.permutations(np.repeat(range(3), counts))]
    rng = np.random.default_rng(0)
    drawn = [tuple(patches.drawn_line(counts, areas, ends, rng).ravel()) for _ in range(6000)]
    assert set(drawn) == set(orders)
    assert sum((drawn.count(o) - 6000 * orders.count(o) / len(orders)) ** 2 / (6000 * orders.count(o) / len(orders)) for o in set(orders)) < 3 * len(set(orders))
    # Of 3 * 10^9 patches all are dealt out, as many to each neighbourhood as it had.
    many, n = np.array([10**9, 2 * 10**9 + 1]), np.arange(1, 3001) * 10**6 + (np.arange(1, 3001) == 3000)
    got = patches.drawn_line(many, np.array([1, 1]), n, rng)
    assert (got.sum(axis=0) == many).all() and (got.sum(axis=1) == np.diff(n, prepend=0)).all()
    assert abs(got[:, 0].std() / math.sqrt(10**6 * 2 / 9) - 1) < 0.1


def test_gathered_patches_are_shuffled_as_their_members(spark, monkeypatch):
    from cellweave.operators import patches

    rows = [(r, "O1", n, o, 1, 40 * n + 10 * o) for r in (1.0, 2.0) for n in (1, 2, 4) for o in (1, 2)]
    df = spark.createDataFrame(rows, "radius double, grp string, nbhd int, object long, area long, n long")
    known = lambda frame=df: sorted((r["radius"], r["replicate"], *r["v"]) for r in mi.patch_nulls(frame, ["O1.1", "O1.2"], 10, 7).collect())
    whole = known()
    assert known(df.repartition(3)) == whole and len(set(whole)) > 60
    # More than a task draws are made again and put in order, with a spread of the same kind.
    monkeypatch.setattr(patches, "MAX_DRAWN", 1)
    monkeypatch.setattr(patches, "BIN_ROWS", 10**9)
    made = known()
    assert len(made) == len(whole) and made != whole
    for own in (whole, made):
        share = [w[2] for w in own if w[2]]
        # Later neighbourhoods move up to the empty third.
        assert len(share) == 60 and len(own) == 80 and abs(np.mean(share) - 100 * 310 / 650) < 2 and 1.5 < np.std(share) < 6
    with pytest.raises(ValueError, match="gathered"):
        mi.patch_nulls(df, ["O1.1"], 1, 0, [("O1.1", "S1.1")])


def test_cismi_patches_makes_no_row_for_each_member(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(census, "member_patches", lambda *a: pytest.fail("members are made one by one"))
    got = queries.QUERIES["cismi_patches"](spark, sf_dir).collect()
    assert [(r["VA"], r["VB"]) for r in got] == [("O1.1", None), ("O1.2", None), ("O1.3", None), ("O1.1", "O1.2"), ("O1.1", "O1.3"), ("O1.2", "O1.3")]
    monkeypatch.undo()
    table, own = queries._table(spark, sf_dir), queries.seeds(spark, sf_dir).where("nbhd <= 40")
    members, alike = (census.census_table(table, 2.0, None, seeds=own, gathered=g) for g in (False, True))
    assert all(abs(members.summary()[k] - v) < 1e-9 for k, v in alike.summary().items())
    count = members.patches.groupBy("radius", "grp", "nbhd", "object", "area").agg(F.count("*").alias("n"))
    assert count.exceptAll(alike.patches.select(count.columns)).isEmpty() and alike.patches.select(count.columns).exceptAll(count).isEmpty()
