"""Exact top-k inner products over norm-sorted vectors.

Components become floor(1024 x). Vectors are sorted into strips of falling length and rotated by the
singular vectors of their second moments, so that the first coordinates carry most of each product. The
longest vectors give every query a first k-th score; by Cauchy-Schwarz (|q| |x|) a block of queries then
needs only the strips whose longest vector can still reach it. Within a strip, partial sums over the first
rotated coordinates plus the product of the residual lengths bound each score, candidates below the
query's current k-th score are pruned, and the survivors are scored exactly in integers.

The rotation is fitted on at most about `SAMPLE` vectors: it steers the pruning, not the result. Blocks of
queries and strips of candidates meet in one task each, so a task's size is fixed.

Nulls: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no
part. Shorter vectors are padded with zeros. Repeated rows are separate candidates; only a query's own row
is left out. Scores outside a long are set to its nearest end. An empty table, or one without queries,
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import write_table

STRIP, BLOCK, SAMPLE, SEEDS = 8192, 1024, 20_000, 1024
HEADS = (8, 16, 32)
_LONG = (-(1 << 63), (1 << 63) - 1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long) and norm of the vectors that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    if len(rows) and all(len(r) == width for r in rows):
        return np.stack(rows.to_numpy()).astype(np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of all rows of q and x: exact in doubles below 2^53, else in Python integers."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    wide = q.astype(object) @ x.astype(object).T
    return np.vectorize(lambda s: min(max(int(s), _LONG[0]), _LONG[1]), otypes=[np.int64])(wide) if wide.size else np.zeros(wide.shape, np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    # ~s falls as s rises, without the overflow that -s has at the end of the range.
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def scan(q: pd.DataFrame, x: pd.DataFrame, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """For the queries q (uid, vec_id, v, norm, floor), their best k among the strip x (uid, vec_id, v, norm)."""
    width = len(rotation)
    x = x.sort_values(["norm", "vec_id"], ascending=[False, True])
    qi, xi = _matrix(q["v"], width), _matrix(x["v"], width)
    qr, xr = qi @ rotation, xi @ rotation
    floor = q["floor"].to_numpy(float).copy()
    q_uid, x_uid, x_id, norm, q_norm = (s.to_numpy() for s in (q["uid"], x["uid"], x["vec_id"], x["norm"], q["norm"]))
    heads = [h for h in HEADS if h < width]
    rest = lambda m, h: np.sqrt((m[:, h:] ** 2).sum(1))
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    for start in range(0, len(x), 1024):
        part = np.arange(start, min(start + 1024, len(x)))
        slack = 1e-6 * (1 + q_norm[:, None] * norm[part][None, :])
        open_ = q_norm[:, None] * norm[part][None, :] + slack >= floor[:, None]
        for a, h in zip([0, *heads], heads, strict=False):
            rows, cols = open_.any(1), open_.any(0)
            if not rows.any():
                break
            qs, part, open_, slack = np.flatnonzero(rows), part[cols], open_[:, cols], slack[:, cols]
            bound = qr[qs, :h] @ xr[part, :h].T + np.outer(rest(qr[qs], h), rest(xr[part], h))
            open_[qs] &= bound + slack[qs] >= floor[qs, None]
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            continue
        scores = exact(qi[rows], xi[part])
        for r, i in enumerate(rows):
            own = open_[i] & (x_uid[part] != q_uid[i])
            if not own.any():
                continue
            s, at = np.concatenate([held[i][0], scores[r][own]]), np.concatenate([held[i][1], part[own]])
            top = best(s, x_id[at], k)
            held[i] = (s[top], at[top])
            if len(top) == k:
                floor[i] = max(floor[i], float(s[top[-1]]))
    counts = [len(h[0]) for h in held]
    at = np.concatenate([h[1] for h in held]).astype(np.int64)
    return pd.DataFrame({"uid": np.repeat(q_uid, counts), "query_id": np.repeat(q["vec_id"].to_numpy(), counts), "vec_id": x_id[at], "score": np.concatenate([h[0] for h in held]).astype(np.int64)})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (vec_id, embedding) for each row whose id `every` divides."""
    spark = vectors.sparkSession
    found = integers(vectors)
    shape = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    if not shape["n"] or not shape["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, width = shape["n"], shape["width"]
    strips = max(1, -(-n // STRIP))
    dealt = found.repartitionByRange(strips, F.desc("norm"), "vec_id", F.xxhash64("v"))
    rows = write_table(dealt.select(F.spark_partition_id().alias("strip"), F.monotonically_increasing_id().alias("uid"), "vec_id", "v", "norm"), "strips")
    # At most about SAMPLE rows.
    sample = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    m = _matrix(sample.select("v").toPandas()["v"], width).astype(float)
    rotation = np.linalg.svd(m / max(1.0, np.abs(m).max(initial=0)), full_matrices=False)[2].T if len(m) >= width > 0 else np.eye(width)
    seeds = rows.orderBy(F.desc("norm"), "uid").limit(SEEDS).toPandas()

    def first_floor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in frames:
            if len(q):
                got = scan(q.assign(floor=-np.inf), seeds, rotation, k)
                kth = got.groupby("uid")["score"].agg(lambda s: float(s.min()) if len(s) == k else -np.inf)
                yield q.assign(floor=q["uid"].map(kth).fillna(-np.inf).astype(float))

    queries = rows.where(F.col("vec_id") % every == 0).select("uid", "vec_id", "v", "norm").mapInPandas(first_floor, "uid long, vec_id long, v array<long>, norm double, floor double")
    blocks = max(1, -(-shape["queries"] // BLOCK))
    queries = write_table(queries.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), "queries")
    # One row for 8,192 vectors and one for 1,024 queries, 16 bytes each, are compared on the driver: 2 MB for a thousand million vectors.
    strip_rows = rows.groupBy("strip").agg(F.max("norm").alias("longest")).toPandas().sort_values("strip")
    strip_list, lengths = strip_rows["strip"].to_numpy(), np.maximum.accumulate(strip_rows["longest"].to_numpy()[::-1])[::-1]
    reach = F.when(F.col("norm") > 0, F.col("floor") * (1 - 1e-9) / F.col("norm")).otherwise(F.when(F.col("floor") > 0, float("inf")).otherwise(float("-inf")))
    least = queries.groupBy("block").agg(F.min(reach).alias("least")).toPandas()
    least["strips"] = np.searchsorted(-lengths, -least["least"].to_numpy(), "right")
    least = least[least["strips"] > 0]
    if not len(least):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Strips are numbered by falling length: a block meets the first ones, up to its last.
    meet = spark.createDataFrame(pd.DataFrame({"block": least["block"].astype("int32"), "last": strip_list[least["strips"] - 1].astype("int32")}), "block int, last int")
    meet = meet.select("block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("strip"))
    left = queries.join(meet, "block")
    right = rows.join(meet, "strip")

    def pair(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return scan(q, x, rotation, k)

    got = left.groupBy("strip", "block").cogroup(right.groupBy("strip", "block")).applyInPandas(pair, "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
