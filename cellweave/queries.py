"""Registered queries of the spatial engine over the driver's tables, with their DuckDB SQL.

Points: lineitem as cells at X = l_quantity, Y = 100 l_discount, Z = 100 l_tax, Object by l_returnflag, with
l_extendedprice as scalar. The lattice of their sites doubles as a voxel image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import volumes
from cellweave.functions.scalar import normal_sf, round_to_bins
from cellweave.names import col
from cellweave.operators import census, composition, distribution, image, networks, patches, patterns, range_join, spatial, viewdata
from cellweave.operators import mutual_information as mi
from cellweave.plans import random_plan
from cellweave.sources import example

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    """Six decimals, never -0.0: both engines then write the same number."""
    return F.round(c, 6) + F.lit(0.0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- inputs

def _upper_sql(z: str) -> str:
    """The upper normal tail by Simpson's rule over 600 steps: SQL here has no error function."""
    terms = f"list_sum([(CASE WHEN q IN (0, 600) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({z} * q / 600.0::DOUBLE)^2) for q in range(601)])"
    return f"(0.5 - {z} * {terms} / 1800 / sqrt(2 * pi()))"

PTS = """pts AS (SELECT l_quantity AS x, round_even(100 * l_discount, 0) AS y, round_even(100 * l_tax, 0) AS z,
 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS object, l_extendedprice AS s FROM lineitem)"""
SITES = PTS + ", sites AS (SELECT x, y, z, object, count(*) AS area, sum(s) AS s FROM pts GROUP BY ALL)"
SEEDS = """seeds AS (SELECT row_number() OVER (ORDER BY x, y, z)::INTEGER AS nbhd, x, y, z FROM (SELECT DISTINCT l_quantity AS x, round_even(100 * l_discount, 0) AS y,
 round_even(100 * l_tax, 0) AS z FROM lineitem))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    obj = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long")
    return line.select(F.col("l_quantity").alias("x"), F.rint(100 * F.col("l_discount")).alias("y"), F.rint(100 * F.col("l_tax")).alias("z"), obj.alias("object"), F.array("l_extendedprice").alias("s"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site is a seed."""
    line = read(spark, sf_dir, "lineitem")
    places = line.select(F.col("l_quantity").alias("x"), F.rint(100 * F.col("l_discount")).alias("y"), F.rint(100 * F.col("l_tax")).alias("z")).distinct()
    return random_plan.with_row_id(places, "x", "y", "z").select((F.col("row_id") + 1).cast("int").alias("nbhd"), "x", "y", "z")


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("object").alias("Object"), F.col("s")[0].alias("price"))


# ---------------------------------------------------------------- censuses

def _census_sql(radius: float) -> str:
    return f"""WITH {SITES}, {SEEDS},
 m AS (SELECT nbhd, object, sum(area) AS area FROM seeds e JOIN sites p ON (e.x - p.x)^2 + (e.y - p.y)^2 + (e.z - p.z)^2 <= {radius * radius} GROUP BY ALL)
SELECT nbhd, 'O1.' || object AS var, round(100.0 * area / sum(area) OVER (PARTITION BY nbhd), 6) + 0.0 AS value FROM m"""


def _census_points(spark: SparkSession, sf_dir: str, radius: float) -> DataFrame:
    rows = census.census_of_seeds(seeds(spark, sf_dir), points(spark, sf_dir), radius, 1)
    return patches.summarize(rows).select("nbhd", "var", r6(F.col("value")).alias("value"))


@query(_census_sql(1.0))
def census_points_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census_points(spark, sf_dir, 1.0)


@query(_census_sql(2.0))
def census_points_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census_points(spark, sf_dir, 2.0)


@query(f"""WITH {SITES}, {SEEDS}, radii AS (SELECT unnest([1.0, 2.0])::DOUBLE AS r),
 m AS (SELECT r, nbhd, e.x, e.y, e.z, object, sum(area) AS area FROM radii, seeds e JOIN sites p ON (e.x - p.x)^2 + (e.y - p.y)^2 + (e.z - p.z)^2 <= r * r GROUP BY ALL),
 t AS (SELECT *, 100.0 * area / sum(area) OVER (PARTITION BY r, nbhd) AS v FROM m)
SELECT round(coalesce(max(v) FILTER (object = 1), 0), 6) AS "O1.1", round(coalesce(max(v) FILTER (object = 2), 0), 6) AS "O1.2", round(coalesce(max(v) FILTER (object = 3), 0), 6) AS "O1.3",
 x AS "X", y AS "Y", z AS "Z", r AS "Radius" FROM t GROUP BY r, nbhd, x, y, z""")
def census_multi_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = census.census_table(_table(spark, sf_dir), [1.0, 2.0], None, seeds=seeds(spark, sf_dir)).census
    return got.select(*(r6(col(f"O1.{k}")).alias(f"O1.{k}") for k in (1, 2, 3)), "X", "Y", "Z", "Radius")


@query(f"""WITH {SITES}, {SEEDS},
 m AS (SELECT nbhd, object, sum(area) AS area, sum(s) AS s FROM seeds e JOIN sites p ON (e.x - p.x)^2 + (e.y - p.y)^2 + (e.z - p.z)^2 <= 4 GROUP BY ALL)
SELECT nbhd, 'O1.' || object || '_S1.1' AS var, round(s / area + 0.0000013, 4) AS value FROM m WHERE object IN (1, 3)""")
def census_linked_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = census.census_of_seeds(seeds(spark, sf_dir), points(spark, sf_dir), 2.0, 1)
    long = patches.summarize(rows, [("O1.1", "S1.1"), ("O1.3", "S1.1")])
    return long.where(F.col("var").contains("_")).select("nbhd", "var", F.round(F.col("value") + 0.0000013, 4).alias("value"))


@query(f"""WITH {SITES}, {SEEDS},
 m AS (SELECT nbhd, sum(area)::BIGINT AS n FROM seeds e JOIN sites p ON (e.x - p.x)^2 + (e.y - p.y)^2 + (e.z - p.z)^2 <= 4 GROUP BY nbhd)
SELECT count(*) AS count, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, round(median(n), 6)::DOUBLE AS median, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max FROM m""")
def neighborhood_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = census.census_of_seeds(seeds(spark, sf_dir), points(spark, sf_dir), 2.0)
    n = rows.groupBy("nbhd").agg(F.sum("area").alias("n"))
    return n.agg(F.count("*").alias("count"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("median"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y, p_retailprice AS v, p_brand AS b FROM part)
SELECT a.i + 1 AS nbhd, a.x AS "X", a.y AS "Y", 0.0::DOUBLE AS "Z", 1.5::DOUBLE AS "Radius", round(avg(b.v) + 0.0000013, 4) AS price, count(*) AS n
FROM p a JOIN p b ON (a.x - b.x)^2 + (a.y - b.y)^2 <= 2.25 GROUP BY a.i, a.x, a.y""")
def coord_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    table = random_plan.with_row_id(part, "p_partkey").select("row_id", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"), F.col("p_retailprice").alias("price"))
    got = census.census_coordinates(table, 1.5, ["price"])
    places = table.groupBy("x", "y").agg(F.count("*").alias("c"))
    n = range_join.ball_join(places.select("x", "y"), places, 1.5, ("x", "y")).groupBy(F.col("x").alias("X"), F.col("y").alias("Y")).agg(F.sum("p_c").alias("n"))
    return got.join(n, ["X", "Y"]).select("nbhd", "X", "Y", "Z", "Radius", F.round(F.col("price") + 0.0000013, 4).alias("price"), "n")


@query("""WITH p AS (SELECT p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y, p_brand AS o, row_number() OVER (ORDER BY p_partkey) AS nbhd FROM part),
 m AS (SELECT a.nbhd, b.o, count(*) AS c FROM p a JOIN p b ON (a.x - b.x)^2 + (a.y - b.y)^2 <= 1 GROUP BY ALL)
SELECT nbhd, 'O1.' || o AS var, round(100.0 * c / sum(c) OVER (PARTITION BY nbhd), 6) + 0.0 AS value FROM m""")
def coord_census_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    table = random_plan.with_row_id(part, "p_partkey").select("row_id", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"), F.col("p_brand").alias("brand"))
    wide = census.census_coordinates(table, 1.0, [], object_column="brand")
    names = [c for c in wide.columns if c.startswith("O1.")]
    long = wide.select("nbhd", F.explode(F.array(*(F.struct(F.lit(n).alias("var"), col(n).alias("value")) for n in names))).alias("e"))
    # What is there counts, even if its share rounds to 0.
    return long.where("e.value > 0").select("nbhd", "e.var", r6(F.col("e.value")).alias("value"))


@query("""WITH p AS (SELECT p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y, p_partkey AS k FROM part), s AS (SELECT DISTINCT x, y FROM p)
SELECT s.x::DOUBLE AS x, s.y::DOUBLE AS y, count(*) AS members, min(k) AS least FROM s JOIN p ON (s.x - p.x)^2 + (s.y - p.y)^2 <= 4 GROUP BY ALL""")
def neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"), F.col("p_partkey").alias("k"))
    own = rows.select("x", "y").distinct().withColumn("nbhd", F.xxhash64("x", "y"))
    got = census.create_neighborhoods(rows, 2.0, own, axes=("x", "y"))
    return got.select(F.col("center")[0].alias("x"), F.col("center")[1].alias("y"), F.size("members").cast("long").alias("members"), F.array_min(F.transform("members", lambda m: m["k"])).alias("least"))


@query("""SELECT 'O1.1' AS variable, round(avg("O1.1"), 6) AS mean, count(*) AS n FROM (SELECT p_size::DOUBLE AS "O1.1" FROM part UNION ALL SELECT 0.0 FROM supplier)
UNION ALL SELECT 'S1.1', round(avg(v), 6), count(*) FROM (SELECT 0.0::DOUBLE AS v FROM part UNION ALL SELECT s_acctbal FROM supplier)""")
def standardize_censuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("O1.1"), F.lit(1.0).alias("Radius"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("S1.1"), F.lit(1.0).alias("Radius"))
    both = census.standardize([a, b])
    every = both[0].unionByName(both[1])
    out = [every.agg(F.lit(n).alias("variable"), F.round(F.avg(col(n)), 6).alias("mean"), F.count("*").alias("n")) for n in ("O1.1", "S1.1")]
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- joins

@query("""SELECT p.p_partkey, s.s_suppkey, (p.p_size - s.s_suppkey % 50)^2 + (p.p_partkey % 40 - s.s_nationkey)^2 AS d2 FROM part p JOIN supplier s
ON (p.p_size - s.s_suppkey % 50)^2 + (p.p_partkey % 40 - s.s_nationkey)^2 <= 9""")
def ball_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    b = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return range_join.ball_join(a, b, 3.0, ("x", "y")).select("p_partkey", F.col("p_s_suppkey").alias("s_suppkey"), "d2")


@query("""WITH a AS (SELECT o_custkey % 7 AS k, o_orderkey, (o_orderkey % 1000)::DOUBLE AS s, (o_orderkey % 1000 + 1 + o_custkey % 30)::DOUBLE AS e FROM orders),
 b AS (SELECT c_custkey % 7 AS k, c_custkey, (c_custkey % 900)::DOUBLE AS s, (c_custkey % 900 + 5)::DOUBLE AS e FROM customer)
SELECT a.k, o_orderkey, c_custkey, greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").selectExpr("o_custkey % 7 k", "o_orderkey", "double(o_orderkey % 1000) s1", "double(o_orderkey % 1000 + 1 + o_custkey % 30) e1")
    b = read(spark, sf_dir, "customer").selectExpr("c_custkey % 7 k", "c_custkey", "double(c_custkey % 900) s2", "double(c_custkey % 900 + 5) e2")
    return range_join.interval_join_alike(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), 16.0).select("k", "o_orderkey", "c_custkey", "overlap_start", "overlap_end")


@query("""WITH p AS (SELECT s_suppkey AS i, s_acctbal AS x, (s_nationkey * 100)::DOUBLE AS y FROM supplier),
 d AS (SELECT a.i, b.i AS j, (a.x - b.x)^2 + (a.y - b.y)^2 AS d2, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x)^2 + (a.y - b.y)^2, b.i) AS r FROM p a JOIN p b ON a.i <> b.i)
SELECT i, j, round(d2, 4) AS d2, r::INTEGER AS rank FROM d WHERE r <= 4""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey row_id", "s_acctbal x", "double(s_nationkey * 100) y")
    return range_join.knn(rows, 4).select("i", "j", F.round("d2", 4).alias("d2"), "rank")


@query("""SELECT event_id, CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'mid' ELSE 'low' END AS region FROM (SELECT event_id, (event_id * 37 % 100)::DOUBLE AS value FROM events)""")
def region_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 100).cast("double").alias("value"))
    return rows.select("event_id", range_join.asof(F.col("value"), [(0.0, "low"), (25.0, "mid"), (75.0, "high")]).alias("region"))


# ---------------------------------------------------------------- voxels

VOX = PTS + """, c AS (SELECT x, y, z, object, count(*) AS n, sum(s) AS s FROM pts GROUP BY ALL),
 vo AS (SELECT x, y, z, arg_min(object, (-n, object)) AS label FROM c GROUP BY ALL),
 vs AS (SELECT x, y, z, least(255, floor(sum(s) / sum(n) / 300))::INTEGER AS v FROM c GROUP BY ALL)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).groupBy("x", "y", "z", "object").agg(F.count("*").alias("n"), F.sum(F.col("s")[0]).alias("s"))
    both = rows.groupBy("x", "y", "z").agg(F.min_by("object", F.struct(-F.col("n"), "object")).cast("double").alias("label"), F.least(F.floor(F.sum("s") / F.sum("n") / 300), F.lit(255)).cast("double").alias("v"))
    return image.flat_voxels(both, "O1", z="z", channels=["label"]).unionByName(image.flat_voxels(both, "S1", z="z", channels=["v"]))


@query(f"""WITH {VOX} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, (CASE label WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE label END)::DOUBLE AS value FROM vo""")
def object_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.remap_objects(voxels(spark, sf_dir), "O1", {1: 3, 3: 1}).where("image = 'O1'").select("x", "y", "z", "value")


@query(f"""WITH {VOX}, h AS (SELECT v, count(*) AS n FROM vs GROUP BY v), lo AS (SELECT min(v) AS m, count(*) AS k, (SELECT min(v) FROM h WHERE v > 0) AS p FROM h),
 t AS (SELECT unnest(range(1, 256)) AS t), e AS (SELECT t, (SELECT sum(v * n) / nullif(sum(n), 0) FROM h WHERE v >= 1 AND v < t) AS low, (SELECT sum(v * n) / nullif(sum(n), 0) FROM h WHERE v > t) AS high FROM t, lo WHERE t > p),
 f AS (SELECT min(t) AS t FROM e WHERE high IS NULL OR round_even((coalesce(low, 0) + high) / 2, 0) = t)
SELECT 'S1' AS image, 1::INTEGER AS c, (CASE WHEN k = 1 THEN m WHEN k = 2 THEN m + 1 ELSE coalesce((SELECT CASE WHEN e.high IS NULL THEN f.t - 1 ELSE f.t END FROM f JOIN e USING (t)), 255) END)::INTEGER AS threshold FROM lo""")
def isodata_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.isodata_thresholds(voxels(spark, sf_dir))


@query(f"""WITH {VOX}, b AS (SELECT x, y, z FROM vo WHERE label IN (1, 2) UNION SELECT x, y, z FROM vs WHERE v >= 128)
SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, row_number() OVER (ORDER BY x, y, z) - 1 AS position FROM b""")
def seed_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("S1", 1, 128)], "image string, c int, threshold int")
    return image.eligible_seeds(voxels(spark, sf_dir), limits, allowed={"O1": [1, 2]}).select("x", "y", "z", "position")


@query(f"""WITH {VOX}, e AS (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) AS nbhd FROM vo),
 m AS (SELECT e.nbhd, label, sum(1) AS a, sum(v) AS s FROM e JOIN vo p ON ((p.x - e.x) / 2)^2 + ((p.y - e.y) / 2)^2 + ((p.z - e.z) / 1)^2 <= 1 JOIN vs q ON q.x = p.x AND q.y = p.y AND q.z = p.z GROUP BY ALL),
 t AS (SELECT nbhd, max(a) FILTER (label = 1) AS a1, max(a) FILTER (label = 2) AS a2, max(a) FILTER (label = 3) AS a3, sum(a) AS a, max(s) FILTER (label = 2) AS s2 FROM m GROUP BY nbhd)
SELECT round(100.0 * coalesce(a1, 0) / a, 6) AS "O1.1", round(100.0 * coalesce(a2, 0) / a, 6) AS "O1.2", round(100.0 * coalesce(a3, 0) / a, 6) AS "O1.3", round(coalesce(s2 / a2, 0), 6) AS "O1.2_S1.1",
 (x + 1)::DOUBLE AS "X", (y + 1)::DOUBLE AS "Y", (z + 1)::DOUBLE AS "Z", 2.0::DOUBLE AS "Radius" FROM t JOIN e USING (nbhd)""")
def voxel_image_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    own = random_plan.with_row_id(v.where("image = 'O1'").select("x", "y", "z"), "x", "y", "z").select((F.col("row_id") + 1).cast("int").alias("nbhd"), "x", "y", "z")
    wide, _ = image.census_image(v, {2.0: [2, 2, 1]}, links=[("O1.2", "S1.1")], seeds=own)
    return wide.select(*(r6(col(n)).alias(n) for n in ("O1.1", "O1.2", "O1.3", "O1.2_S1.1")), "X", "Y", "Z", "Radius")


@query(f"""WITH {VOX}, e AS (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) AS nbhd FROM vo)
SELECT e.nbhd::INTEGER AS nbhd, 'S1.1' AS var, round(avg(v), 6) + 0.0 AS value FROM e JOIN vs p ON (p.x - e.x)^2 + (p.y - e.y)^2 + (p.z - e.z)^2 <= 1 GROUP BY e.nbhd""")
def scalar_channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).where("image = 'S1'")
    own = random_plan.with_row_id(v.select("x", "y", "z"), "x", "y", "z").select((F.col("row_id") + 1).cast("int").alias("nbhd"), "x", "y", "z")
    _, rows = image.census_image(v, {1.0: [1, 1, 1]}, seeds=own)
    return image.summarize_images(rows).select("nbhd", "var", r6(F.col("value")).alias("value"))


@query()
def image_patches_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    own = random_plan.with_row_id(v.where("image = 'O1'").select("x", "y", "z"), "x", "y", "z").select((F.col("row_id") + 1).cast("int").alias("nbhd"), "x", "y", "z")
    _, rows = image.census_image(v, {2.0: [2, 2, 2]}, seeds=own, components=True)
    return rows.groupBy("grp", "nbhd", "object").agg(F.count("*").alias("patches"), F.sum("area").alias("area"))


@query()
def patch_components_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voxel with the size of its patch of one label; a whole image has no SQL, tests hold it against flood fill."""
    own = patches.wide_components(voxels(spark, sf_dir).where("image = 'O1'").select(F.col("value").cast("long").alias("label"), "x", "y", "z"), ["label"])
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(sizes, "component").select("label", "x", "y", "z", "size")


@query("""WITH r AS (SELECT unnest([1, 2, 3]) AS k, unnest([1.0, 2.0, 3.0])::DOUBLE AS a, unnest([1.0, 1.0, 3.0])::DOUBLE AS c)
SELECT k::INTEGER AS k, count(*) AS volume FROM r JOIN (SELECT unnest(range(-3, 4)) AS x) ON true JOIN (SELECT unnest(range(-3, 4)) AS y) ON true JOIN (SELECT unnest(range(-2, 3)) AS z) ON true
WHERE sqrt((x / a)^2 + (y / a)^2 + (z / c)^2) <= 1 GROUP BY k""")
def ellipsoid_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = volumes.ellipsoid_volumes([[1, 1, 1], [2, 2, 1], [3, 3, 3]], [20, 20, 5])
    return spark.createDataFrame(list(enumerate(found, 1)), "k int, volume long")


@query("""SELECT i, count(*) AS volume FROM (SELECT unnest(range(200)) AS i) JOIN (SELECT unnest(range(-12, 13)) AS x) ON true JOIN (SELECT unnest(range(-12, 13)) AS y) ON true JOIN (SELECT unnest(range(-4, 5)) AS z) ON true
WHERE sqrt((x / (1 + i % 12)::DOUBLE)^2 + (y / (1 + 3 * i % 12)::DOUBLE)^2 + (z / (1 + i % 4)::DOUBLE)^2) <= 1 GROUP BY i""")
def volumes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = volumes.ellipsoid_volumes([[1 + i % 12, 1 + 3 * i % 12, 1 + i % 4] for i in range(200)], [100, 100, 20])
    return spark.createDataFrame(list(enumerate(found)), "i long, volume long")


@query("""WITH v AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_quantity, round_even(100 * l_discount, 0), round_even(100 * l_tax, 0) FROM lineitem))
SELECT ceil(2.0 * n / 7)::BIGINT AS r1, ceil(2.0 * n / 33)::BIGINT AS r2 FROM v""")
def suggest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = image.suggest_number(voxels(spark, sf_dir), 2.0, [[1, 1, 1], [2, 2, 2]], [50, 11, 9])
    return spark.createDataFrame([tuple(found)], "r1 long, r2 long")


@query("""SELECT p_size::BIGINT AS target, greatest(1, round_even(p_size / 0.284::DOUBLE, 0))::BIGINT AS x, greatest(1, round_even(p_size / 0.5::DOUBLE, 0))::BIGINT AS z FROM (SELECT DISTINCT p_size FROM part)""")
def suggest_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = sorted(r["p_size"] for r in read(spark, sf_dir, "part").select("p_size").distinct().collect())  # fifty sizes
    found = volumes.suggest_radii(targets, [0.284, 0.284, 0.5])
    return spark.createDataFrame([(t, x, z) for t, (x, _, z) in zip(targets, found, strict=True)], "target long, x long, z long")


@query("""WITH k AS (SELECT unnest(range(4)) AS k), c AS (SELECT unnest(range(3)) AS c)
SELECT (SELECT count(*) FROM k) AS d1, (SELECT count(*) FROM k a, k b WHERE a.k + b.k <= 3) AS d2, (SELECT count(*) FROM (SELECT unnest(range(5)) AS k) a, (SELECT unnest(range(5)) AS k) b, k WHERE a.k + b.k = 4 AND k.k < 3) AS d3,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM c a, c b WHERE 80 + 10 * a.c + 25 * b.c <= 100 UNION ALL SELECT count(*) FROM c a, c b WHERE 80 + 10 * a.c + 50 * b.c <= 100 UNION ALL SELECT count(*) FROM c a, c b WHERE 25 * a.c + 50 * b.c <= 100)) AS custom""")
def comp_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = (volumes.compositional_bins(1, 4), volumes.compositional_bins(2, 4), volumes.compositional_bins(3, 4), volumes.compositional_bins(2, 3, [80, 0, 0], [100, 50, 100]))
    return spark.createDataFrame([row], "d1 long, d2 long, d3 long, custom long")


# ---------------------------------------------------------------- distributions

BINS = """b AS (SELECT greatest(least(round_even((l_quantity - (SELECT min(l_quantity) FROM lineitem)) * 4 / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 0), 4), 0)::INTEGER AS i,
 greatest(least(round_even((l_tax - (SELECT min(l_tax) FROM lineitem)) * 2 / (SELECT max(l_tax) - min(l_tax) FROM lineitem), 0), 2), 0)::INTEGER AS j FROM lineitem)"""


def _line_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("S1.1"), F.col("l_tax").alias("S1.2"), F.lit(1.0).alias("Radius"))


@query("""WITH r AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)
SELECT bin::DOUBLE AS bin, count(*) AS n FROM (SELECT greatest(least(round_even((l_extendedprice - a) * 9 / (b - a), 0), 9), 0) + 1 AS bin FROM lineitem, r) GROUP BY bin""")
def round_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    low, high = line.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return line.select(round_to_bins(F.col("l_extendedprice"), low, high, 10).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {BINS}, r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem)
SELECT round(a + i * (b - a) / 4, 6) AS "S1.1", round(c + j * (d - c) / 2, 6) AS "S1.2", count(*) AS freq FROM b, r GROUP BY ALL""")
def build_dist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_census(spark, sf_dir)
    ranges = distribution.ranges_of(rows, ["S1.1", "S1.2"])
    rows = distribution.bin_columns(distribution.bin_columns(rows, {"S1.1": ranges["S1.1"]}, 5), {"S1.2": ranges["S1.2"]}, 3)
    got = distribution.build_dist(rows, ["S1.1", "S1.2"])
    return got.select(r6(col("S1.1")).alias("S1.1"), r6(col("S1.2")).alias("S1.2"), "freq")


@query("""WITH e AS (SELECT floor(log2(event_id + 1.5))::INTEGER AS i, (event_id * 104729 % 40)::INTEGER AS j FROM events),
 d AS (SELECT i, j, count(*) AS freq FROM e GROUP BY ALL), g AS (SELECT i, j FROM (SELECT unnest(range(30)) AS i) JOIN (SELECT unnest(range(40)) AS j) ON true),
 t AS (SELECT sum(freq)::DOUBLE AS n, coalesce(sum(freq) FILTER (freq = 1), 0)::DOUBLE AS n1, coalesce(sum(freq) FILTER (freq = 2), 0)::DOUBLE AS n2 FROM d),
 m AS (SELECT n, (CASE WHEN n1 = 0 THEN 0.5 ELSE n1 END) AS f1, n2 FROM t), q AS (SELECT f1 / (n + 1) * (n * f1) / (n * f1 + 2 * n2) AS miss FROM m),
 f AS (SELECT g.i, g.j, coalesce(freq, 0)::DOUBLE AS freq FROM g LEFT JOIN d ON g.i = d.i AND g.j = d.j), z AS (SELECT sum(freq) AS total, count(*) FILTER (freq = 0) AS zeros FROM f)
SELECT (i + 30 * j)::BIGINT AS pos, round(CASE WHEN zeros = 0 THEN freq / total WHEN freq > 0 THEN freq / total * (1 - miss) ELSE miss / zeros END, 9) AS freq FROM f, z, q""")
def smooth_dist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.floor(F.log2(F.col("event_id") + 1.5)).cast("double").alias("S1.1"), (F.col("event_id") * 104729 % 40).cast("double").alias("S1.2"))
    got = distribution.smooth_dist(distribution.build_dist(rows, ["S1.1", "S1.2"]), ["S1.1", "S1.2"], [30, 40], {"S1.1": (0.0, 29.0), "S1.2": (0.0, 39.0)})
    return got.select("pos", F.round("freq", 9).alias("freq"))


@query("""WITH p AS (SELECT event_id, ((event_id * 7919 % 10007) / 10007.0)::DOUBLE AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS k, count(*) OVER () AS n FROM p)
SELECT event_id, round(least(min(p * n / k) OVER (ORDER BY k DESC), 1.0), 9) AS padj FROM r""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 10007 / F.lit(10007.0)).cast("double").alias("p"))
    return distribution.benjamini_hochberg(rows, "p", out="padj").select("event_id", F.round("padj", 9).alias("padj"))


# ---------------------------------------------------------------- information

def _mi_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_quantity").alias("S1.1"), F.rint(100 * F.col("l_discount")).alias("S1.2"), F.rint(100 * F.col("l_tax")).alias("S1.3"), F.lit(1.0).alias("Radius"))


MI = """v AS (SELECT l_quantity AS a, round_even(100 * l_discount, 0) AS b, round_even(100 * l_tax, 0) AS c FROM lineitem),
 r AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM v),
 d AS (SELECT round_even((a - a0) * 5 / (a1 - a0), 0) AS a, round_even((b - b0) * 5 / (b1 - b0), 0) AS b, round_even((c - c0) * 5 / (c1 - c0), 0) AS c FROM v, r),
 n AS (SELECT count(*)::DOUBLE AS n FROM d)"""


def _h(columns: str) -> str:
    return f"(SELECT -sum(k / n * log2(k / n)) FROM (SELECT count(*) AS k FROM d GROUP BY {columns}), n)"


@query(f"WITH {MI} SELECT unnest([0, 1, 2, 3, 4, 5])::INTEGER AS ens, round(unnest([{_h('a')}, {_h('b')}, {_h('c')}, {_h('a, b')}, {_h('a, c')}, {_h('b, c')}]), 6) AS h")
def entropy_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S1.1", "S1.2", "S1.3"]
    found = mi.ensembles(names, 2)
    rows = mi.binned(mi.census_rows(_mi_census(spark, sf_dir), names), 6, len(names))
    return mi.entropies(rows, found, 6).select("ens", F.round("h", 6).alias("h"))


@query(f"""WITH {MI}, h AS (SELECT {_h('a')} AS a, {_h('b')} AS b, {_h('c')} AS c, {_h('a, b')} AS ab, {_h('a, c')} AS ac, {_h('b, c')} AS bc, {_h('a, b, c')} AS abc)
SELECT unnest([0, 1, 2, 3, 4, 5, 6])::INTEGER AS ens, round(unnest([a, b, c, a + b - ab, a + c - ac, b + c - bc, a + b + c - ab - ac - bc + abc]), 5) + 0.0 AS mi FROM h""")
def mi_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S1.1", "S1.2", "S1.3"]
    found = mi.ensembles(names, 3)
    rows = mi.binned(mi.census_rows(_mi_census(spark, sf_dir), names), 6, len(names))
    return mi.information(mi.entropies(rows, found, 6), found).select("ens", (F.round("mi", 5) + 0.0).alias("mi"))


CIS = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, floor(o_totalprice / 50000)::BIGINT AS a, (o_custkey % 7)::BIGINT AS b FROM orders),
 s AS (SELECT unnest(range(1, 6)) AS k), pa AS (SELECT k, a, row_number() OVER (PARTITION BY k ORDER BY md5('0-' || k || '-0|' || i), i) AS p FROM o, s), pb AS (SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY md5('0-' || k || '-1|' || i), i) AS p FROM o, s),
 q AS (SELECT 0 AS k, a, b FROM o UNION ALL SELECT pa.k, a, b FROM pa JOIN pb ON pa.k = pb.k AND pa.p = pb.p),
 n AS (SELECT count(*)::DOUBLE AS n FROM o), r AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM o),
 d AS (SELECT k, round_even((a - a0) * 3.0::DOUBLE / (a1 - a0), 0) AS a, round_even((b - b0) * 3.0::DOUBLE / (b1 - b0), 0) AS b FROM q, r),
 ha AS (SELECT k, -sum(c / n * log2(c / n)) AS h FROM (SELECT k, a, count(*) AS c FROM d GROUP BY ALL), n GROUP BY k), hb AS (SELECT k, -sum(c / n * log2(c / n)) AS h FROM (SELECT k, b, count(*) AS c FROM d GROUP BY ALL), n GROUP BY k),
 hab AS (SELECT k, -sum(c / n * log2(c / n)) AS h FROM (SELECT k, a, b, count(*) AS c FROM d GROUP BY ALL), n GROUP BY k),
 m AS (SELECT k, ha.h + hb.h - hab.h AS mi FROM ha JOIN hb USING (k) JOIN hab USING (k))"""


@query(f"""WITH {CIS} SELECT 'S1.1' AS "VA", 'S1.2' AS "VB", round(max(mi) FILTER (k = 0) - avg(mi) FILTER (k > 0), 6) + 0.0 AS "CisMI",
 round((max(mi) FILTER (k = 0) - avg(mi) FILTER (k > 0)) / stddev_samp(mi) FILTER (k > 0), 3) + 0.0 AS "Zscore" FROM m""")
def cismi_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    rows = random_plan.with_row_id(rows, "o_orderkey").select("row_id", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("S1.1"), (F.col("o_custkey") % 7).cast("double").alias("S1.2"), F.lit(1.0).alias("Radius"))
    got = mi.measure_cis_mi(rows, 2, bootstraps=5, random_state=0, allow_permutation=True, bins=4)
    return got.where("VB IS NOT NULL").select("VA", "VB", r6(F.col("CisMI")).alias("CisMI"), (F.round("Zscore", 3) + 0.0).alias("Zscore"))


@query()
def cismi_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cisMI of the cells' census against censuses of shuffled patches."""
    got = census.census_table(_table(spark, sf_dir), 2.0, None, seeds=seeds(spark, sf_dir), gathered=True)
    return mi.measure_cis_mi(got.census, 2, patches=got.patches, bootstraps=5, max_bins=5)


CIS3 = f"""o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, floor(o_totalprice / 50000)::BIGINT AS a, (o_custkey % 7)::BIGINT AS b, (o_orderkey % 3)::BIGINT AS c FROM orders), s AS (SELECT unnest(range(1, 11)) AS k),
 pa AS (SELECT k, a, row_number() OVER (PARTITION BY k ORDER BY md5('0-' || k || '-0|' || i), i) AS p FROM o, s), pb AS (SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY md5('0-' || k || '-1|' || i), i) AS p FROM o, s),
 pc AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY md5('0-' || k || '-2|' || i), i) AS p FROM o, s),
 q AS (SELECT 0 AS k, a, b, c FROM o UNION ALL SELECT pa.k, a, b, c FROM pa JOIN pb ON pa.k = pb.k AND pa.p = pb.p JOIN pc ON pa.k = pc.k AND pa.p = pc.p),
 n AS (SELECT count(*)::DOUBLE AS n, least(100, floor(sqrt((count(*) + 1) / 10.0::DOUBLE) + 1e-12)) - 1 AS top FROM o), r AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM o),
 d AS (SELECT k, round_even((a - a0) * top / (a1 - a0)::DOUBLE, 0) AS a, round_even((b - b0) * top / (b1 - b0)::DOUBLE, 0) AS b, round_even((c - c0) * top / (c1 - c0)::DOUBLE, 0) AS c FROM q, r, n),
 h AS ({" UNION ALL ".join(f"SELECT k, '{e}' AS e, -sum(m / n * log2(m / n)) AS h FROM (SELECT k, count(*) AS m FROM d GROUP BY k, {', '.join(e)}), n GROUP BY k" for e in ("a", "b", "c", "ab", "ac", "bc"))}),
 mi AS (SELECT k, e, h AS v FROM h WHERE length(e) = 1 UNION ALL SELECT x.k, x.e, y.h + z.h - x.h FROM h x JOIN h y ON y.k = x.k AND y.e = x.e[1] JOIN h z ON z.k = x.k AND z.e = x.e[2] WHERE length(x.e) = 2),
 t AS (SELECT e, max(v) FILTER (k = 0) - avg(v) FILTER (k > 0) AS v, stddev_samp(v) FILTER (k > 0) AS sd FROM mi GROUP BY e),
 w AS (SELECT e, CASE WHEN abs(v) < 1e-12 THEN 0 ELSE v END AS v, CASE WHEN abs(v) < 1e-12 THEN 0 ELSE v / sd END AS z FROM t),
 u AS (SELECT e, v, z, 2 * {_upper_sql("abs(z)")} AS p FROM w), v AS (SELECT *, row_number() OVER (ORDER BY p, e) AS rank FROM u),
 f AS (SELECT e, v, z, p, least(1.0, min(p * 6 / rank) OVER (ORDER BY rank DESC)) AS padj FROM v)"""
_VARIABLE = "CASE {} WHEN 'a' THEN 'S1.1' WHEN 'b' THEN 'S1.2' WHEN 'c' THEN 'S1.3' END"


@query(f"""WITH {CIS3} SELECT 1.0::DOUBLE AS radius, {_VARIABLE.format("e[1]")} AS "VA", {_VARIABLE.format("e[2]")} AS "VB", round(v, 6) + 0.0 AS "CisMI", round(z, 3) + 0.0 AS "Zscore", round(p, 6) + 0.0 AS "Pvalue", round(padj, 6) + 0.0 AS "Padjust" FROM f""")
def cismi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _cismi(spark, sf_dir)
    return got.select("radius", "VA", "VB", *((F.round(c, k) + 0.0).alias(c) for c, k in (("CisMI", 6), ("Zscore", 3), ("Pvalue", 6), ("Padjust", 6))))


def _cismi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = random_plan.with_row_id(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey")
    rows = rows.select("row_id", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("S1.1"), (F.col("o_custkey") % 7).cast("double").alias("S1.2"), (F.col("o_orderkey") % 3).cast("double").alias("S1.3"), F.lit(1.0).alias("Radius"))
    return mi.measure_cis_mi(rows, 2, bootstraps=10, allow_permutation=True)


def _specimens(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    line = read(spark, sf_dir, "lineitem")
    rows = line.select((F.col("l_suppkey") % 4).alias("g"), F.col("l_quantity").alias("S1.1"), (F.col("l_partkey") % 11).cast("double").alias("S1.2"), F.lit(1.0).alias("Radius"))
    return [rows.where(F.col("g") == k).drop("g") for k in range(4)]


TRANS = """v AS (SELECT l_suppkey % 4 AS g, l_quantity AS a, (l_partkey % 11)::DOUBLE AS b FROM lineitem), r AS (SELECT g, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM v GROUP BY g),
 d AS (SELECT v.g, (round_even((a - a0) * 2 / (a1 - a0), 0) + 3 * round_even((b - b0) * 2 / (b1 - b0), 0))::BIGINT AS pos FROM v JOIN r USING (g)),
 c AS (SELECT g, pos, count(*)::DOUBLE AS f FROM d GROUP BY ALL), p AS (SELECT g, pos, f / sum(f) OVER (PARTITION BY g) AS p FROM c),
 k AS (SELECT x.g AS i, y.g AS j, sum(0.5 * (x.p - y.p) * log2(x.p / y.p)) AS d FROM p x JOIN p y ON x.pos = y.pos AND x.g < y.g GROUP BY ALL)"""


@query(f"WITH {TRANS} SELECT i::INTEGER AS i, j::INTEGER AS j, round(d, 8) + 0.0 AS d FROM k")
def transmi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S1.1", "S1.2"]
    d = mi.divergences(mi.smoothed(mi.specimen_rows(_specimens(spark, sf_dir), names), names, [(0, 1)], 3))
    return d.select("i", "j", (F.round("d", 8) + 0.0).alias("d"))


@query(f"""WITH {TRANS}, s AS (SELECT i, j, 1 - d / (SELECT max(d) FROM k) AS s FROM k), w AS (SELECT i, j, s FROM s UNION ALL SELECT j, i, s FROM s UNION ALL SELECT DISTINCT g, g, 1.0 FROM r),
 t AS (SELECT sum(s) AS w FROM w), q AS (SELECT i % 2 AS c, sum(s) AS o, sum(s) FILTER (i % 2 = j % 2) AS n FROM w GROUP BY i % 2)
SELECT round(sum((n - o * o / w) / w), 6) + 0.0 AS q FROM q, t""")
def transmi_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S1.1", "S1.2"]
    d = mi.divergences(mi.smoothed(mi.specimen_rows(_specimens(spark, sf_dir), names), names, [(0, 1)], 3))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    vector = d.agg(F.array_sort(F.collect_list(F.struct("i", "j", "d"))).alias("l")).select(F.transform("l", lambda x: x["d"]).alias("d"))
    return vector.select(r6(mi.modularity(F.col("d"), ["a", "b", "a", "b"], pairs)).alias("q"))


def _trans_sql(code: str, ens: int) -> str:
    """(ens, nth, d): the divergences of the six pairs of specimens over one ensemble's bins."""
    return f"""SELECT {ens} AS ens, nth, coalesce(d, 0) AS d FROM pairs LEFT JOIN (SELECT x.g AS i, y.g AS j, sum(0.5 * (x.p - y.p) * log2(x.p / y.p)) AS d FROM (SELECT g, {code} AS pos, count(*)::DOUBLE / max(n) AS p FROM b JOIN sizes USING (g) GROUP BY ALL) x
 JOIN (SELECT g, {code} AS pos, count(*)::DOUBLE / max(n) AS p FROM b JOIN sizes USING (g) GROUP BY ALL) y ON x.pos = y.pos AND x.g < y.g GROUP BY ALL) USING (i, j)"""


# The steps of the plan one after another, composed by hand.
@query(f"""WITH v AS (SELECT l_suppkey % 4 AS g, l_quantity AS a, (l_partkey % 11)::DOUBLE AS b FROM lineitem), r AS (SELECT g, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM v GROUP BY g), sizes AS (SELECT g, count(*) AS n FROM v GROUP BY g),
 b AS (SELECT v.g, round_even((a - a0) * 2 / (a1 - a0), 0)::BIGINT AS a, round_even((b - b0) * 2 / (b1 - b0), 0)::BIGINT AS b FROM v JOIN r USING (g)),
 pairs AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS nth, unnest([0, 0, 0, 1, 1, 2]) AS i, unnest([1, 2, 3, 2, 3, 3]) AS j),
 d AS ({_trans_sql("a", 0)} UNION ALL {_trans_sql("b", 1)} UNION ALL {_trans_sql("a + 3 * b", 2)}),
 steps AS (SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest([[0, 1, 2, 3, 4, 5], [0, 3, 2, 5, 1, 4], [2, 3, 4, 5, 0, 1], [1, 0, 5, 4, 3, 2], [0, 1, 4, 5, 2, 3]]) AS src),
 s AS (SELECT step, d.ens, p.i, p.j, 1 - d / max(d) OVER (PARTITION BY step, d.ens) AS s FROM steps, pairs p, d WHERE d.nth = src[p.nth + 1]),
 w AS (SELECT step, ens, i, j, s FROM s UNION ALL SELECT step, ens, j, i, s FROM s UNION ALL SELECT DISTINCT step, ens, i, i, 1.0 FROM s UNION ALL SELECT DISTINCT step, ens, 3, 3, 1.0 FROM s),
 o AS (SELECT step, ens, i % 2 AS c, sum(s) AS o, sum(s) FILTER (i % 2 = j % 2) AS n FROM w GROUP BY ALL), q AS (SELECT step, ens, sum(n / t - (o / t)^2) AS q FROM o JOIN (SELECT step, ens, sum(s) AS t FROM w GROUP BY ALL) USING (step, ens) GROUP BY ALL),
 k AS (SELECT ens, max(q) FILTER (step = 0) AS o, avg(q) FILTER (step > 0) AS m, stddev_samp(q) FILTER (step > 0) AS sd FROM q GROUP BY ens), z AS (SELECT ens, o, CASE WHEN sd > 1e-14 THEN (o - m) / sd ELSE 0 END AS z FROM k),
 u AS (SELECT ens, o, z, {_upper_sql("z")} AS p FROM z), n AS (SELECT *, row_number() OVER (ORDER BY p, ens) AS rank FROM u)
SELECT 1.0::DOUBLE AS radius, CASE WHEN ens = 1 THEN 'S1.2' ELSE 'S1.1' END AS "VA", CASE WHEN ens = 2 THEN 'S1.2' END AS "VB", round(o, 6) + 0.0 AS "TransMI", round(z, 4) + 0.0 AS "Zscore", round(p, 6) + 0.0 AS "Pvalue", round(least(1.0, min(p * 3 / rank) OVER (ORDER BY rank DESC)), 6) + 0.0 AS "Padjust" FROM n""")
def transmi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [[0, 3, 2, 5, 1, 4], [2, 1, 5, 3, 0, 4], [5, 4, 3, 2, 1, 0], [1, 0, 3, 2, 5, 4]]
    got = mi.measure_trans_mi(_specimens(spark, sf_dir), {"Status": ["A", "B", "A", "B"]}, 2, max_bins=3, plan=plan)
    return got.select("radius", "VA", "VB", *((F.round(c, k) + 0.0).alias(c) for c, k in (("TransMI", 6), ("Zscore", 4), ("Pvalue", 6), ("Padjust", 6))))


@query("""WITH p AS (SELECT (o_custkey % 40 + 1)::INTEGER AS nbhd, o_orderkey AS id, (1 + o_orderkey % 4)::BIGINT AS area, (o_orderkey % 3 + 1)::BIGINT AS object FROM orders),
 e AS (SELECT nbhd, sum(sum(area)) OVER (ORDER BY nbhd) AS ne, sum(area) AS t FROM p GROUP BY nbhd),
 l AS (SELECT id, area, object, sum(area) OVER (ORDER BY md5('5|' || id), id ROWS UNBOUNDED PRECEDING) AS pe FROM p),
 m AS (SELECT n.k AS nbhd, object, sum(least(pe, ne) - greatest(pe - area, ne - t)) AS a FROM l JOIN (SELECT *, row_number() OVER (ORDER BY ne) AS k FROM e) n ON pe - area < ne AND ne - t < pe GROUP BY ALL)
SELECT nbhd::INTEGER AS nbhd, 'O1.' || object AS var, round(100.0 * a / sum(a) OVER (PARTITION BY nbhd), 6) + 0.0 AS value FROM m""")
def random_census_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.lit(1.0).alias("radius"), F.lit("O1").alias("grp"), (F.col("o_custkey") % 40 + 1).cast("int").alias("nbhd"), F.col("o_orderkey").alias("patch_id"), (1 + F.col("o_orderkey") % 4).alias("area"), (F.col("o_orderkey") % 3 + 1).alias("object"), F.array().cast("array<double>").alias("s"))
    got = patches.random_census(rows, random_plan.shuffle_key(5, "patch_id"))
    return got.select("nbhd", "var", r6(F.col("value")).alias("value"))


@query("""WITH s AS (SELECT unnest(range(3)) AS step), a AS (SELECT step, c_custkey AS src, row_number() OVER (PARTITION BY step ORDER BY md5('9-' || step || '|' || c_custkey), c_custkey) AS p FROM customer, s),
 b AS (SELECT c_custkey AS pos, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) SELECT step::INTEGER AS step, pos, src FROM a JOIN b USING (p)""")
def permutation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_plan.md5_permutations(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos")), 3, 9)


# ---------------------------------------------------------------- composition

ALPHA = """m AS (SELECT n_regionkey AS parent, (c_nationkey % 6 + 1)::INTEGER AS id, count(*)::DOUBLE AS mass FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 g AS (SELECT parent, id FROM (SELECT DISTINCT parent FROM m) JOIN (SELECT unnest(range(1, 7))::INTEGER AS id) ON true), f AS (SELECT g.parent, g.id, coalesce(mass, 0) AS mass FROM g LEFT JOIN m ON g.parent = m.parent AND g.id = m.id),
 p AS (SELECT parent, id, mass / sum(mass) OVER (PARTITION BY parent) AS p FROM f)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("parent"), (F.col("c_nationkey") % 6 + 1).cast("int").alias("id")).agg(F.count("*").cast("double").alias("mass"))


@query(f"WITH {ALPHA} SELECT parent, id, round(100 * p, 6) AS percent, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) OVER (PARTITION BY parent), 6) AS entropy FROM p")
def alpha_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = composition.alpha_diversity(_parts(spark, sf_dir), ["parent"], 6)
    return got.select("parent", "id", F.round("percent", 6).alias("percent"), F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {ALPHA}, w AS (SELECT parent, sum(mass) / (SELECT sum(mass) FROM m) AS w FROM m GROUP BY parent), q0 AS (SELECT id, sum(w * p) AS q FROM p JOIN w USING (parent) GROUP BY id),
 q AS (SELECT id, q / sum(q) OVER () AS q FROM (SELECT id, CASE WHEN q = 0 THEN 1e-6 / 6 ELSE q END AS q FROM q0)), pp AS (SELECT parent, id, p / sum(p) OVER (PARTITION BY parent) AS p FROM (SELECT parent, id, CASE WHEN p = 0 THEN 1e-6 / 6 ELSE p END AS p FROM p))
SELECT round(sum(w * p * log2(p / q)), 6) AS beta FROM pp JOIN q USING (id) JOIN w USING (parent)""")
def beta_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    _, beta = composition.beta_diversity(parts, parts.groupBy("parent").agg(F.sum("mass").alias("weight")), 6)
    return spark.createDataFrame([(round(beta, 6),)], "beta double")


@query("""WITH p AS (SELECT s_nationkey + 1 AS o, count(*) AS c, round(avg(s_acctbal), 2) AS v FROM supplier GROUP BY s_nationkey), g AS (SELECT CASE WHEN o IN (1, 3) THEN 1 WHEN o IN (5, 6, 7) THEN 5 ELSE o END AS g, c, v FROM p)
SELECT row_number() OVER (ORDER BY g) AS "Object", sum(c)::BIGINT AS "Count", round(sum(v * c) / sum(c), 4) AS "S1" FROM g GROUP BY g""")
def merge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = read(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 1).alias("Object")).agg(F.count("*").alias("Count"), F.round(F.avg("s_acctbal"), 2).alias("S1"))
    got = composition.merge_profile(profile.withColumn("Object", F.col("Object").cast("long")), [[1, 3], [5, 6, 7]])
    return got.select("Object", "Count", F.round("S1", 4).alias("S1"))


@query("""WITH m AS (SELECT c_custkey, (CASE WHEN c_nationkey IN (1, 4) THEN 1 WHEN c_nationkey IN (2, 9) THEN 2 ELSE c_nationkey END)::BIGINT AS g FROM customer), t AS (SELECT g, dense_rank() OVER (ORDER BY g) AS n FROM (SELECT DISTINCT g FROM m WHERE g <> 0))
SELECT c_custkey, coalesce(n, 0)::BIGINT AS value FROM m LEFT JOIN t USING (g)""")
def merge_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("value"))
    return composition.renumber(rows, "value", [[1, 4], [2, 9]], keep_zero=True)


@query("""SELECT s_nationkey + 1 AS "Object", count(*) AS n, (s_nationkey + 1 IN (2, 3, 8))::INTEGER AS selected FROM supplier GROUP BY s_nationkey""")
def merge_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = read(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 1).alias("Object")).agg(F.count("*").alias("n"))
    rest, chosen = composition.remaining_and_selected(profile, [[2, 3], [8]])
    return rest.withColumn("selected", F.lit(0)).unionByName(chosen.withColumn("selected", F.lit(1)))


# ---------------------------------------------------------------- spatial statistics

LAT = """c AS (SELECT l_quantity AS x, round_even(100 * l_discount, 0) AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), p AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS i, x, y, v FROM c)"""


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x"), F.rint(100 * F.col("l_discount")).alias("y")).agg(F.avg("l_extendedprice").alias("value"))
    return random_plan.with_row_id(rows, "x", "y")


def _weights_sql(condition: str, weight: str = "1.0") -> str:
    return f"""WITH {LAT}, e AS (SELECT a.i, b.i AS j, {weight} AS w FROM p a JOIN p b ON a.i <> b.i AND {condition})
SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 8) AS w FROM e"""


def _edges(df: DataFrame) -> DataFrame:
    return df.select("i", "j", F.round("w", 8).alias("w"))


D2 = "(a.x - b.x)^2 + (a.y - b.y)^2"


@query(_weights_sql(f"{D2} <= 4"))
def weights_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "distance_band", threshold=2.0))


@query(_weights_sql(f"{D2} <= 4", f"1 / sqrt({D2})"))
def weights_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "inverse_distance", threshold=2.0))


@query(_weights_sql(f"{D2} <= 4", f"exp(-0.5 * ({D2}) / 2.25)"))
def weights_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "kernel", threshold=2.0, bandwidth=1.5))


@query(_weights_sql("(a.x = b.x) <> (a.y = b.y) AND greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 1"))
def weights_rook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "rook", threshold=1.0))


@query(_weights_sql("greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 1"))
def weights_queen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "queen"))


@query(f"""WITH {LAT}, n AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {D2}, b.i) - 1 AS r FROM p a JOIN p b ON true), k AS (SELECT i, j FROM n WHERE r BETWEEN 1 AND 5 AND i <> j),
 e AS (SELECT i, j FROM k UNION SELECT j, i FROM k) SELECT i, j, round(1.0 / count(*) OVER (PARTITION BY i), 8) AS w FROM e""")
def weights_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights(_lattice(spark, sf_dir), "knn", k=5))


STAT = f"""{LAT}, e0 AS (SELECT a.i, b.i AS j FROM p a JOIN p b ON a.i <> b.i AND greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 1), e AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM e0),
 m AS (SELECT count(*)::DOUBLE AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM p), u AS (SELECT sum((v - mean)^2) AS m2, sum((v - mean)^4) AS m4 FROM p, m),
 t AS (SELECT e.i, e.j, w, a.v AS vi, b.v AS vj FROM e JOIN p a ON e.i = a.i JOIN p b ON e.j = b.i)"""


def _stat_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _lattice(spark, sf_dir)
    return rows, spatial.weights(rows, "queen", threshold=1.0)


@query(f"""WITH {STAT}, g AS (SELECT sum(w) AS w, sum(w * (vi - mean) * (vj - mean)) AS x FROM t, m), s1 AS (SELECT 0.5 * sum((a.w + coalesce(b.w, 0))^2) AS s1 FROM e a LEFT JOIN e b ON a.i = b.j AND a.j = b.i),
 s2 AS (SELECT sum(s * s) AS s2 FROM (SELECT i, sum(w) AS s FROM (SELECT i, w FROM e UNION ALL SELECT j, w FROM e) GROUP BY i)),
 f AS (SELECT n / w * x / m2 AS o, -1 / (n - 1) AS x0, n, w, s1, s2, n * m4 / (m2 * m2) AS b2 FROM m, u, g, s1, s2),
 v AS (SELECT o, x0, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - x0 * x0 AS var FROM f)
SELECT round(o, 8) AS observed, round(x0, 8) AS expected, round(var, 8) AS variance, round((o - x0) / sqrt(var), 5) AS z, round(2 * {_upper_sql("abs((o - x0) / sqrt(var))")}, 7) + 0.0 AS p FROM v""")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.morans_i(*_stat_edges(spark, sf_dir))
    return got.select(F.round("observed", 8).alias("observed"), F.round("expected", 8).alias("expected"), F.round("variance", 8).alias("variance"), F.round("z", 5).alias("z"), (F.round("p", 7) + 0.0).alias("p"))


@query(f"""WITH {STAT}, g AS (SELECT n, (n - 1) * sum(w * (vi - vj)^2) / (2 * sum(w) * max(m2)) AS o FROM t, m, u GROUP BY n), z AS (SELECT o, 1 / (n - 1) AS var, (o - 1) / sqrt(1 / (n - 1)) AS z FROM g)
SELECT round(o, 8) AS observed, 1.0::DOUBLE AS expected, round(var, 8) AS variance, round(z, 6) AS z, round(2 * {_upper_sql("abs(z)")}, 7) + 0.0 AS p FROM z""")
def gearys_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.gearys_c(*_stat_edges(spark, sf_dir))
    return got.select(F.round("observed", 8).alias("observed"), "expected", F.round("variance", 8).alias("variance"), F.round("z", 6).alias("z"), (F.round("p", 7) + 0.0).alias("p"))


@query(f"""WITH {STAT}, l AS (SELECT i, (max(vi) - max(mean)) / max(sd) AS s, (sum(w * vj) - max(mean) * sum(w)) / max(sd) AS lag, sum(w * w) AS w2 FROM t, m GROUP BY i)
SELECT i AS row_id, round(s * lag, 6) + 0.0 AS local, round(s * lag / sqrt(w2), 6) + 0.0 AS z, round(lag, 6) + 0.0 AS lag, CASE WHEN s >= 0 AND lag >= 0 THEN 'HH' WHEN s < 0 AND lag < 0 THEN 'LL' WHEN s >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM l""")
def lisa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.lisa(*_stat_edges(spark, sf_dir)).select("row_id", *(r6(F.col(c)).alias(c) for c in ("local", "z", "lag")), "quadrant")


@query(f"""WITH {STAT}, l AS (SELECT i, sum(w * vj) AS g, max(mean) * sum(w) AS e, max(sd)^2 * greatest((max(n) * sum(w * w) - sum(w)^2) / (max(n) - 1), 0) AS var FROM t, m GROUP BY i)
SELECT i AS row_id, round(g, 4) AS g, round(CASE WHEN var > 0 THEN (g - e) / sqrt(var) ELSE 0 END, 6) + 0.0 AS z FROM l""")
def getis_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.getis_ord(*_stat_edges(spark, sf_dir)).select("row_id", F.round("g", 4).alias("g"), r6(F.col("z")).alias("z"))


@query(f"""WITH {STAT}, l AS (SELECT i, (max(vi) - max(mean)) / max(sd) * (sum(w * vj) - max(mean) * sum(w)) / max(sd) / sqrt(sum(w * w)) AS z FROM t, m GROUP BY i)
SELECT i AS row_id, round(2 * {_upper_sql("abs(z)")}, 7) + 0.0 AS p, round({_upper_sql("z")}, 7) + 0.0 AS upper FROM l""")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.lisa(*_stat_edges(spark, sf_dir)).select("row_id", (F.round("p", 7) + 0.0).alias("p"), (F.round(normal_sf("z"), 7) + 0.0).alias("upper"))


@query(f"""WITH {LAT}, v AS (SELECT i, x, y, (i * 37 % 101 / 101.0::DOUBLE)::DOUBLE AS v FROM p), o AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY {D2}, b.i) - 1 AS r FROM v a JOIN v b ON true),
 k AS (SELECT i, j FROM o WHERE r BETWEEN 1 AND 8 AND i <> j), e0 AS (SELECT i, j FROM k UNION SELECT j, i FROM k), e AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM e0),
 m AS (SELECT count(*)::DOUBLE AS n, avg(v) AS mean FROM v), cr AS (SELECT sum(w) AS w, sum(w * (a.v - mean) * (b.v - mean)) AS x FROM e JOIN v a ON e.i = a.i JOIN v b ON e.j = b.i, m),
 f AS (SELECT greatest(1, floor(n * (1 - 0.5 * greatest(0, n / w * x / (SELECT sum((v - mean)^2) FROM v, m)))))::DOUBLE AS tests FROM m, cr), r AS (SELECT i, v, row_number() OVER (ORDER BY v) AS r FROM v),
 ad AS (SELECT i, least(1.0, min(v * tests / r) OVER (ORDER BY r DESC)) AS corrected FROM r, f) SELECT i AS row_id, round(corrected, 9) AS corrected, corrected < 0.05 AS rejected FROM ad""")
def spatial_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir).withColumn("p", (F.col("row_id") * 37 % 101 / 101).cast("double"))
    return spatial.fdr_correction(rows)[0].select("row_id", F.round("corrected", 9).alias("corrected"), "rejected")


@query(f"""WITH {LAT}, s AS (SELECT unnest(range(20)) AS step), a AS (SELECT step, v, row_number() OVER (PARTITION BY step ORDER BY md5('3-' || step || '|' || i), i) AS r FROM p, s)
SELECT step::INTEGER AS step, round(sum(a.v * p.x), 2) AS value FROM a JOIN p ON p.i + 1 = a.r GROUP BY step""")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir)
    null = spatial.permutation_test(rows, lambda v, xy: float((v * xy[:, 0]).sum()), permutations=20, seed=3)[1]
    return null.select("step", F.round("value", 2).alias("value"))


LAT3 = "p AS (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS i, * FROM (SELECT DISTINCT l_quantity AS x, round_even(100 * l_discount, 0) AS y, round_even(100 * l_tax, 0) AS z FROM lineitem))"


def _lattice3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.rint(100 * F.col("l_discount")).alias("y"), F.rint(100 * F.col("l_tax")).alias("z")).distinct()
    return random_plan.with_row_id(rows, "x", "y", "z")


@query(f"""WITH {LAT3}, e AS (SELECT a.i, b.i AS j, 1 / sqrt((a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) AS w FROM p a JOIN p b ON a.i <> b.i AND (a.x <> b.x)::INT + (a.y <> b.y)::INT + (a.z <> b.z)::INT <= 2
 AND (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 <= 2.25) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 8) AS w FROM e""")
def weights_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spatial.weights_3d(_lattice3(spark, sf_dir), 18, threshold=1.5))


@query(f"""WITH {LAT3}, e AS (SELECT a.i, b.i AS j FROM p a JOIN p b ON a.i < b.i AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1)
SELECT (SELECT count(*) FROM p) AS num_points, (SELECT count(*) FROM e) AS num_edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM p), 6) AS mean_degree""")
def connectivity_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.connectivity_summary(_lattice3(spark, sf_dir), 6, 1.0)
    return spark.createDataFrame([(got["num_points"], got["num_edges"], round(got["mean_degree"], 6))], "num_points long, num_edges long, mean_degree double")


LAT3V = """c3 AS (SELECT l_quantity AS x, round_even(100 * l_discount, 0) AS y, round_even(100 * l_tax, 0) AS z, avg(l_extendedprice) AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
 p AS (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS i, * FROM c3)"""
NEAR3 = "(a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2"


def _valued3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x"), F.rint(100 * F.col("l_discount")).alias("y"), F.rint(100 * F.col("l_tax")).alias("z"))
    return random_plan.with_row_id(rows.agg(F.avg("l_extendedprice").alias("value"), F.count("*").cast("double").alias("volume")), "x", "y", "z")


@query(f"""WITH {LAT3V}, e0 AS (SELECT a.i, b.i AS j, 1 / sqrt({NEAR3}) AS w FROM p a JOIN p b ON a.i <> b.i AND {NEAR3} <= 2.25), e AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM e0),
 m AS (SELECT count(*)::DOUBLE AS n, avg(v) AS mean FROM p), u AS (SELECT sum((v - mean)^2) AS m2 FROM p, m)
SELECT round(max(m.n) / sum(w) * sum(w * (a.v - mean) * (b.v - mean)) / max(m2), 7) AS observed, round(-1 / (max(m.n) - 1), 8) AS expected FROM e JOIN p a ON e.i = a.i JOIN p b ON e.j = b.i, m, u""")
def morans_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = spatial.morans_i_3d(_valued3(spark, sf_dir), connectivity=26, threshold=1.5)
    return whole.select(F.round("observed", 7).alias("observed"), F.round("expected", 8).alias("expected"))


@query(f"""WITH {LAT3V}, e0 AS (SELECT a.i, b.i AS j, sqrt(a.n * b.n) / sqrt({NEAR3}) AS w FROM p a JOIN p b ON a.i <> b.i AND {NEAR3} <= 1), e AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM e0),
 b AS (SELECT i, v, ntile(10) OVER (ORDER BY n, i) AS block FROM p), s AS (SELECT unnest(range(8)) AS step),
 h AS (SELECT step, block, i, row_number() OVER (PARTITION BY step, block ORDER BY i) AS r FROM b, s), g AS (SELECT step, block, v, row_number() OVER (PARTITION BY step, block ORDER BY md5('4-' || step || '|' || i), i) AS r FROM b, s),
 d AS (SELECT h.step, h.i, g.v - (SELECT avg(v) FROM p) AS d FROM h JOIN g ON h.step = g.step AND h.block = g.block AND h.r = g.r)
SELECT x.step::INTEGER AS step, round((SELECT count(*) FROM p) / (SELECT sum(w) FROM e) * sum(w * x.d * y.d) / (SELECT sum((v - (SELECT avg(v) FROM p))^2) FROM p), 7) AS value
FROM e JOIN d x ON e.i = x.i JOIN d y ON e.j = y.i AND x.step = y.step GROUP BY x.step""")
def volume_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = spatial.permutation_test_3d(_valued3(spark, sf_dir), volume="volume", threshold=1.0, permutations=8, seed=4)[1]
    return null.select("step", F.round("value", 7).alias("value"))


@query(f"""WITH {LAT}, e AS (SELECT a.i, b.i AS j FROM p a JOIN p b ON a.i <> b.i AND (a.x - b.x)^2 + (a.y - b.y)^2 <= 4), d AS (SELECT p.i, count(e.j) AS n FROM p LEFT JOIN e ON p.i = e.i GROUP BY p.i)
SELECT n, count(*) AS points, true AS symmetric FROM d GROUP BY n""")
def weight_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir)
    told = spatial.describe_weights(rows, spatial.weights(rows, "distance_band", threshold=2.0, row_standardize=False))
    return spark.createDataFrame([(n, k, told["symmetric"]) for n, k in told["histogram"].items()], "n long, points long, symmetric boolean")


# ---------------------------------------------------------------- patterns

NODES = [[0.0, 0.0, 0.0], [25.0, 5.0, 2.0], [50.0, 10.0, 8.0], [10.0, 9.0, 4.0]]


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS i, * FROM (SELECT DISTINCT l_quantity AS x, round_even(100 * l_discount, 0) AS y, round_even(100 * l_tax, 0) AS z FROM lineitem)),
 n AS (SELECT unnest([0, 1, 2, 3]) AS node, unnest([0, 25, 50, 10]) AS a, unnest([0, 5, 10, 9]) AS b, unnest([0, 2, 8, 4]) AS c), d AS (SELECT i, node, sqrt((x - a)^2 + (y - b)^2 + (z - c)^2) AS d FROM p, n)
SELECT node::INTEGER AS node, count(*) AS n, round(avg(d), 6) AS error FROM (SELECT i, arg_min(node, (d, node)) AS node, min(d) AS d FROM d GROUP BY i) GROUP BY node""")
def som_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("x", "y", "z").distinct().select(F.array("x", "y", "z").alias("v"))
    return range_join.nearest(rows, NODES, "v").groupBy("node").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query(f"""WITH {VOX}, e AS (SELECT x, y, z, (x % 3 + 1)::INTEGER AS region, ((y + 1) / 16)::DOUBLE AS c FROM vo),
 s AS (SELECT p.x, p.y, p.z, region, sum(c) AS score FROM e JOIN vo p ON ((p.x - e.x) / 2)^2 + ((p.y - e.y) / 2)^2 + (p.z - e.z)^2 <= 1 GROUP BY ALL)
SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, arg_min(region, (-score, region)) AS region FROM s GROUP BY x, y, z""")
def map_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).where("image = 'O1'")
    rows = v.select("x", "y", "z", (F.col("x") % 3 + 1).cast("int").alias("region"), ((F.col("y") + 1) / 16).alias("confidence"))
    return patterns.vote(rows, v, [2, 2, 1])


@query()
def som_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir).select("row_id", F.array("x", "y").alias("v"))
    som = patterns.fit_map(rows, plan=patterns.MapPlan(nodes=20, rounds=5, seed=1))
    return spark.createDataFrame([(k, [float(x) for x in w]) for k, w in enumerate(som.weights)], "node int, w array<double>")


@query()
def learn_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir).select("row_id", F.col("x").alias("O1.1"), F.col("y").alias("S1.1"), F.lit(1.0).alias("Radius"))
    return patterns.learn_pattern(rows, ["O1.1", "S1.1"], 1.0, rounds=3, smooth_window=10, reference=rows)[0]


@query(f"""WITH {VOX}, k AS (SELECT x, y, z, x * 2 AS a, y * 4 AS b FROM vo), n AS (SELECT unnest([0, 1, 2]) AS k, unnest([0, 50, 100]) AS a, unnest([0, 20, 40]) AS b, unnest([1, 3, 2]) AS region),
 d AS (SELECT k.x, k.y, k.z, arg_min(region, (sqrt((k.a - n.a)^2 + (k.b - n.b)^2), n.k)) AS region, min(sqrt((k.a - n.a)^2 + (k.b - n.b)^2)) AS d FROM k, n GROUP BY ALL),
 e AS (SELECT x, y, z, region, 1 - d / (SELECT max(d) FROM d) - 0.0001 AS w FROM d), s AS (SELECT p.x, p.y, p.z, region, sum(w) AS score FROM e JOIN vo p ON ((p.x - e.x) / 2)^2 + ((p.y - e.y) / 2)^2 + ((p.z - e.z) / 2)^2 <= 1 GROUP BY ALL),
 b AS (SELECT x, y, z, arg_max(region, (score, -region)) AS region, max(score) AS score FROM s GROUP BY ALL)
SELECT vo.x::BIGINT AS x, vo.y::BIGINT AS y, vo.z::BIGINT AS z, (CASE WHEN score >= 0.000001 THEN region ELSE 0 END)::INTEGER AS label FROM vo LEFT JOIN b ON vo.x = b.x AND vo.y = b.y AND vo.z = b.z""")
def map_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.createDataFrame([(x, y, v) for v, top in (("O1.1", 100.0), ("O1.2", 40.0)) for x, y in ((0.0, 0.0), (50.0, top / 2), (100.0, top))], "X double, Y double, V string")
    v = voxels(spark, sf_dir)
    rows = v.where("image = 'O1'").select((F.col("x") * 2).cast("double").alias("O1.1"), (F.col("y") * 4).cast("double").alias("O1.2"), *((F.col(a) + 1).cast("double").alias(a.upper()) for a in "xyz"), F.lit(2.0).alias("Radius"))
    return patterns.map_pattern(path, [[0, 40], [60, 100]], v.where("image = 'O1'"), rows, 2.0, [2, 2, 2], ["#FF0000", "#0000FF"])[0]


# ---------------------------------------------------------------- networks

NET = """a AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
 d AS (SELECT p.label AS i, q.label AS j, round(sqrt(sum((p.m - q.m)^2)), 9) AS d FROM a p JOIN a q ON p.i = q.i AND p.label < q.label GROUP BY ALL), s AS (SELECT i, j, d, 1 / (1 + d) AS s FROM d)"""


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = rows.select(F.col("label").alias("i"), "k", F.col("m").alias("mi")), rows.select(F.col("label").alias("j"), "k", F.col("m").alias("mj"))
    d = a.join(b, "k").groupBy("i", "j").agg(F.round(F.sqrt(F.sum((F.col("mi") - F.col("mj")) * (F.col("mi") - F.col("mj")))), 9).alias("d"))
    return d


@query(f"""WITH {NET}, q AS (SELECT least(quantile_cont(s, 0.75), (SELECT min(s) FROM (SELECT s FROM s ORDER BY s DESC LIMIT 10))) AS c FROM s) SELECT i::BIGINT AS i, j::BIGINT AS j, round(d, 6) AS distance, round(s, 6) AS weight FROM s, q WHERE s >= c""")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.build(_distances(spark, sf_dir)).edges.select("i", "j", F.round("distance", 6).alias("distance"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {NET}, q AS (SELECT least(quantile_cont(s, 0.75), (SELECT min(s) FROM (SELECT s FROM s ORDER BY s DESC LIMIT 10))) AS c FROM s), e AS (SELECT i, j FROM s, q WHERE s >= c), v AS (SELECT DISTINCT label FROM embeddings)
SELECT (SELECT count(*) FROM v) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v), 6) AS average_degree""")
def network_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = networks.build(_distances(spark, sf_dir)).topology
    return spark.createDataFrame([(t["num_nodes"], t["num_edges"], round(t["average_degree"], 6))], "num_nodes long, num_edges long, average_degree double")


@query(f"""WITH {NET}, q AS (SELECT least(quantile_cont(s, 0.75), (SELECT min(s) FROM (SELECT s FROM s ORDER BY s DESC LIMIT 10))) AS c FROM s), e AS (SELECT i, j, s AS w FROM s, q WHERE s >= c),
 b AS (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e), t AS (SELECT sum(w) AS m FROM b), g AS (SELECT i % 2 AS c, sum(w) AS o, coalesce(sum(w) FILTER (i % 2 = j % 2), 0) AS n FROM b GROUP BY i % 2)
SELECT round(sum(n / m - (o / m)^2), 8) + 0.0 AS q FROM g, t""")
def network_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _distances(spark, sf_dir)
    groups = ["even" if k % 2 == 0 else "odd" for k in range(d.select("i").distinct().count())]
    told = networks.group_modularity(networks.build(d, groups=groups), nulls=5)
    return spark.createDataFrame([(round(told["observed"], 8) + 0.0,)], "q double")


@query(f"WITH {TRANS} SELECT i::INTEGER AS i, j::INTEGER AS j, round(d, 8) + 0.0 AS d FROM k UNION ALL SELECT j::INTEGER, i::INTEGER, round(d, 8) + 0.0 FROM k")
def distance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["S1.1", "S1.2"]
    d = mi.divergences(mi.smoothed(mi.specimen_rows(_specimens(spark, sf_dir), names), names, [(0, 1)], 3))
    pairs = d.select(F.col("i").alias("left"), F.col("j").alias("right"), F.lit("S1.1_S1.2").alias("variable"), F.col("d").alias("value"))
    return mi.distance_table(pairs, "S1.1_S1.2").select("i", "j", (F.round("d", 8) + 0.0).alias("d"))


@query()
def network_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _distances(spark, sf_dir)
    return networks.detect_communities(networks.build(d), iterations=3, distances=d)["communities"]


@query(f"""WITH RECURSIVE {NET}, q AS (SELECT least(quantile_cont(s, 0.75), (SELECT min(s) FROM (SELECT s FROM s ORDER BY s DESC LIMIT 10))) AS c FROM s), e AS (SELECT i, j FROM s, q WHERE s >= c), v AS (SELECT DISTINCT label FROM embeddings), n AS (SELECT count(*)::DOUBLE AS n FROM v),
 b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e), paths AS (SELECT label AS s, label AS t, [label] AS p FROM v UNION ALL SELECT s, b.j, list_append(p, b.j) FROM paths JOIN b ON b.i = paths.t WHERE NOT list_contains(p, b.j)),
 short AS (SELECT s, t, p, len(p) - 1 AS d, count(*) OVER (PARTITION BY s, t) AS k FROM (SELECT *, min(len(p)) OVER (PARTITION BY s, t) AS least FROM paths) WHERE len(p) = least),
 near AS (SELECT s, count(DISTINCT t) - 1.0::DOUBLE AS reached, sum(d / k::DOUBLE) AS total FROM short GROUP BY s), inner_nodes AS (SELECT unnest(p[2:len(p) - 1]) AS id, 1.0::DOUBLE / k AS share FROM short WHERE len(p) > 2),
 passed AS (SELECT id, sum(share) AS x FROM inner_nodes GROUP BY id), deg AS (SELECT i AS id, count(*) AS k FROM b GROUP BY i)
SELECT label::BIGINT AS id, round(coalesce(deg.k, 0) / (n - 1), 8) AS degree, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 8) + 0.0 AS betweenness, round(CASE WHEN total > 0 THEN reached / total * reached / (n - 1) ELSE 0 END, 8) AS closeness
FROM v CROSS JOIN n LEFT JOIN near ON near.s = label LEFT JOIN passed ON passed.id = label LEFT JOIN deg ON deg.id = label""")
def network_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = networks.analyze(networks.build(_distances(spark, sf_dir)))["centrality"]
    return got.select("id", *(F.round(c, 8).alias(c) for c in ("degree", "betweenness", "closeness")))


@query()
def network_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.pagerank(networks.build(_distances(spark, sf_dir)))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS i, s_suppkey % 50 AS x, s_nationkey AS y FROM supplier), e AS (SELECT a.i, b.i AS j FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), r(a, b) AS (SELECT i, i FROM p UNION SELECT r.a, e.j FROM r JOIN e ON r.b = e.i)
SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey row_id", "double(s_suppkey % 50) x", "double(s_nationkey) y")
    edges = spatial.weights(rows, "rook", threshold=1.0).where("i < j").select("i", "j")
    return networks.components(rows.select(F.col("row_id").alias("id")), edges)


# ---------------------------------------------------------------- tables behind plots

@query("""WITH p AS (SELECT n_regionkey AS "Object", avg(c_acctbal) AS a, count(*)::DOUBLE AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey), l AS (SELECT "Object", 'S1' AS component, a AS v FROM p UNION ALL SELECT "Object", 'S2', b FROM p)
SELECT "Object", component, round(coalesce((v - min(v) OVER (PARTITION BY component)) / nullif(max(v) OVER (PARTITION BY component) - min(v) OVER (PARTITION BY component), 0), 0), 6) AS value FROM l""")
def profile_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("Object")).agg(F.avg("c_acctbal").alias("S1"), F.count("*").cast("double").alias("S2"), F.lit(1).alias("Count"))
    return viewdata.normalize_profiles(rows, "A", "U").withColumn("value", F.round("value", 6))


@query(f"""WITH {CIS3}, g AS (SELECT e, abs(z) AS z, coalesce((abs(v) - min(abs(v)) OVER g) / nullif(max(abs(v)) OVER g - min(abs(v)) OVER g, 0) + 0.1, 0.5) AS size FROM f WINDOW g AS (PARTITION BY length(e))),
 x AS (SELECT unnest(['a', 'b', 'c']) AS x), y AS (SELECT x, sum(z) / 6 AS z, sum(size) / 6 AS size FROM x JOIN g ON contains(e, x) GROUP BY x)
SELECT {_VARIABLE.format("x")} AS "V", round(z, 3) + 0.0 AS z, round(coalesce((size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0) + 0.1, 0.5), 5) AS size FROM y""")
def mi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = viewdata.mi_rank(_cismi(spark, sf_dir), 1.0, p_threshold=1.0, mi_threshold=0.0)[1]
    return got.select("V", (F.round("z", 3) + 0.0).alias("z"), F.round("size", 5).alias("size"))


@query("""WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem),
 g AS (SELECT i, j FROM (SELECT unnest(range(4)) AS i) JOIN (SELECT unnest(range(4)) AS j) ON true),
 o AS (SELECT greatest(least(round_even((l_quantity - a) * 3 / (b - a), 0), 3), 0)::INTEGER AS i, greatest(least(round_even((l_tax - c) * 3 / (d - c), 0), 3), 0)::INTEGER AS j, count(*)::DOUBLE AS f FROM lineitem, r GROUP BY ALL)
SELECT (g.i + 4 * g.j)::BIGINT AS pos, round(f / sum(f) OVER (), 8) AS freq FROM g JOIN o ON g.i = o.i AND g.j = o.j""")
def plot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = viewdata.distribution(_line_census(spark, sf_dir), ["S1.1", "S1.2"], 1.0, 4)
    return got.where("freq > 0").select("pos", F.round("freq", 8).alias("freq"))


@query(f"""WITH {VOX} SELECT x::BIGINT AS x, y::BIGINT AS y, (CASE label WHEN 1 THEN 255 WHEN 2 THEN 0 ELSE 16 END)::INTEGER AS r, (CASE label WHEN 2 THEN 128 ELSE 0 END)::INTEGER AS g, (CASE label WHEN 3 THEN 32 ELSE 0 END)::INTEGER AS b
FROM vo WHERE z = 3 AND label IN (1, 3)""")
def object_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voxels(spark, sf_dir).where("image = 'O1'")
    return viewdata.object_pixels(rows, ["#FF0000", "#008000", "#100020"], 3, [1, 3]).select("x", "y", "r", "g", "b")


@query(f"""WITH {VOX}, t AS (SELECT *, least(v / (SELECT max(v) FROM vs WHERE z = 3)::DOUBLE, 1) AS s FROM vs WHERE z = 3)
SELECT x::BIGINT AS x, y::BIGINT AS y, 0::INTEGER AS r, least(round_even(s * 255, 0), 255)::INTEGER AS g, least(round_even(s * 128, 0), 255)::INTEGER AS b FROM t""")
def scalar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewdata.scalar_pixels(voxels(spark, sf_dir).where("image = 'S1'"), ["#00FF80"], 3).select("x", "y", "r", "g", "b")


@query(f"""WITH {LAT}, t AS (SELECT p.*, min(v) OVER () AS a, max(v) OVER () AS b FROM p) SELECT i AS row_id, x, y, round((v - a) / (b - a), 8) AS shade, CASE WHEN v >= a + (b - a) / 2 THEN 'high' ELSE 'low' END AS class FROM t""")
def spatial_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = viewdata.spatial_map(_lattice(spark, sf_dir), "value", [(0.0, "low"), (0.5, "high")])
    return got.select("row_id", "x", "y", F.round("shade", 8).alias("shade"), "class")


# ---------------------------------------------------------------- sources and sinks

def _fresh(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the JVM closes its file systems."""
    import uuid

    top = f"{random_plan.shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return top


@query("""SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS format, n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region FROM nation""")
def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in each format and read back."""
    from cellweave.sources import bundle, tables

    top, out = _fresh(spark), None
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for kind in ("csv", "tsv", "json", "parquet"):
        tables.write_table(rows, f"{top}/nation.{kind}")
        back = bundle.load_data(spark, f"{top}/nation.{kind}") if kind == "json" else tables.read_table(spark, f"{top}/nation.{kind}")
        one = back.select(F.lit(kind).alias("format"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_size::DOUBLE AS "X", (p_partkey % 50)::DOUBLE AS "Y", 1.0::DOUBLE AS "Z", p_partkey AS "Object" FROM part""")
def object_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object table without Z gets Z = 1."""
    from cellweave.sources import tables

    path = f"{_fresh(spark)}/objects.csv"
    tables.write_table(read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("X"), (F.col("p_partkey") % 50).cast("double").alias("Y"), F.col("p_partkey").alias("Object")), path)
    got = tables.load_table(spark, path, "O")
    return got.select(*(F.col(a).cast("double").alias(a) for a in "XYZ"), F.col("Object").cast("long").alias("Object"))


@query("""SELECT p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y, p_retailprice AS marker FROM part""")
def coordinate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources import tables

    path = f"{_fresh(spark)}/places.parquet"
    tables.write_table(read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 50).cast("double").alias("y"), F.col("p_retailprice").alias("marker")), path)
    return tables.load_coordinate_table(spark, path)


@query(f"WITH {VOX} SELECT label::BIGINT AS \"Object\", count(*) AS \"Count\", 'name' || label AS name FROM vo GROUP BY label")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with other numbers finds its labels by the counts."""
    from cellweave.sources import tables

    labels = voxels(spark, sf_dir).where("image = 'O1'")
    profile = labels.groupBy("value").agg(F.count("*").alias("Count")).select((F.col("value") + 40).cast("long").alias("Object"), "Count", F.concat(F.lit("name"), F.col("value").cast("long").cast("string")).alias("name"))
    return tables.profile_by_counts(profile, labels).select("Object", "Count", "name")


@query(f"""WITH {VOX}, f AS (SELECT label, min(struct_pack(x := x, y := y, z := z)) AS p FROM vo GROUP BY label) SELECT label::BIGINT AS "Object", (p.x + 1)::BIGINT AS "X", (p.y + 1)::BIGINT AS "Y", (p.z + 1)::BIGINT AS "Z" FROM f""")
def profile_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with other numbers finds its labels by one place of each object."""
    from cellweave.sources import tables

    labels = voxels(spark, sf_dir).where("image = 'O1'")
    first = labels.groupBy("value").agg(F.min(F.struct("x", "y", "z")).alias("p"))
    profile = first.select((F.col("value") + 40).cast("long").alias("Object"), *((F.col(f"p.{a.lower()}") + 1).cast("long").alias(a) for a in "XYZ"))
    return tables.profile_by_coordinates(profile, labels).select("Object", "X", "Y", "Z")


@query("SELECT 'O1.' || i AS object, 'S1.' || j AS scalar FROM (SELECT unnest(range(1, 6)) AS i) JOIN (SELECT unnest(range(1, 5)) AS j) ON (i * j) % 3 = 0")
def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources import tables

    regions = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("i"))
    matrix = regions.select(F.concat(F.lit("O1."), F.col("i").cast("string")).alias("object"), *((F.col("i") * j % 3 == 0).cast("int").alias(f"S1.{j}") for j in range(1, 5)))
    path = f"{_fresh(spark)}/links.csv"
    tables.write_table(matrix, path)
    return spark.createDataFrame(tables.load_table(spark, path, "L"), "object string, scalar string")


@query(f"WITH {VOX} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, v::DOUBLE AS value FROM vs WHERE v > 0")
def tiff_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar map written as pages of a TIFF file and read back."""
    import numpy as np

    from cellweave.sources import images

    own = voxels(spark, sf_dir).where("image = 'S1'")
    cube = images.voxel_array(own, (51, 11, 9))  # the lattice's bounds
    top = _fresh(spark)
    raw = images.write_tiff([cube[:, :, k].astype(np.uint8) for k in range(9)])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/map.tif")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw))
    out.close()
    return images.load_scalar_image(spark, f"{top}/map.tif", 1).where("value > 0").select("x", "y", "z", "value")


@query("""SELECT n_regionkey AS region, count(*) AS n, 7::BIGINT AS note FROM nation GROUP BY n_regionkey""")
def result_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result saved as a bundle and loaded again."""
    from cellweave.sources import bundle

    top = f"{_fresh(spark)}/result".removeprefix("file://")
    table = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    bundle.save_result({"table": table, "notes": [7]}, top)
    back = bundle.load_result(spark, top)
    return back["table"].withColumn("note", F.lit(back["notes"][0]).cast("long"))


@query("""WITH s AS (SELECT s_suppkey AS nbhd, (s_suppkey % 50 + 1)::DOUBLE AS x, (s_nationkey % 11)::DOUBLE AS y, (s_suppkey % 9)::DOUBLE AS z FROM supplier),
 """ + SITES + """, m AS (SELECT nbhd, object, sum(area) AS a FROM s JOIN sites p ON (s.x - p.x)^2 + (s.y - p.y)^2 + (s.z - p.z)^2 <= 1 GROUP BY ALL)
SELECT nbhd, round(100.0 * coalesce(max(a) FILTER (object = 1), 0) / sum(a), 6) + 0.0 AS "O1.1", round(100.0 * coalesce(max(a) FILTER (object = 2), 0) / sum(a), 6) + 0.0 AS "O1.2" FROM m GROUP BY nbhd""")
def stream_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers arrive as a stream of seeds against the static cells; the written batches are read back."""
    import uuid

    from cellweave.streaming.census_stream import census_stream as start

    known = read(spark, sf_dir, "supplier").schema
    arriving = spark.readStream.schema(known).option("pathGlobFilter", "supplier.parquet").parquet(sf_dir)
    arriving = arriving.select(F.col("s_suppkey").alias("nbhd"), (F.col("s_suppkey") % 50 + 1).cast("double").alias("x"), (F.col("s_nationkey") % 11).cast("double").alias("y"), (F.col("s_suppkey") % 9).cast("double").alias("z"))
    top = f"{random_plan.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    start(arriving, points(spark, sf_dir), 1.0, [1, 2], ["nbhd"], f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("nbhd", *(r6(col(f"O1.{k}")).alias(f"O1.{k}") for k in (1, 2)))


@query("""SELECT 'table' AS type, (SELECT count(*) FROM part) AS n, true AS valid""")
def validate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.sources.validate import validate

    report = validate(read(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")))
    return spark.createDataFrame([(report["type"], report["rows"], report["valid"])], "type string, n long, valid boolean")


@query("""SELECT round(avg("O1.1"), 6) AS a, round(avg("S1.1"), 6) AS b, count(*) AS n, "Radius" FROM (SELECT (i % 20) * 100 / 19.0 AS "O1.1", 5 - (i % 20) * 100 / 19.0 / 20 AS "S1.1", CASE WHEN i < 20 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS "Radius" FROM (SELECT unnest(range(40)) AS i)) GROUP BY "Radius" """)
def example_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example.example_census(spark).groupBy("Radius").agg(F.round(F.avg("`O1.1`"), 6).alias("a"), F.round(F.avg("`S1.1`"), 6).alias("b"), F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n, round(sum(value) / (SELECT sum(value) FROM events), 9) AS share FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def group_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.sum("value").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0)))
    return own.select("event_type", F.round("m", 6).alias("mean"), "n", F.round(share, 9).alias("share"))
