"""Randomness as data: every draw is a table (step, pos, src) that can be stored, shared and replayed.

Without a plan, order comes from md5 of a seed and a row number: the same in any partitioning and in any
engine that has md5.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffle_key(seed: Column | int | str, row: Column | str) -> Column:
    """A sort key that stands for a random permutation."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit("|"), (row if isinstance(row, Column) else F.col(row)).cast("string")))


def key_heads(prefix: str, rows: Sequence[bytes]) -> np.ndarray:
    """The first 64 bits of the keys of `shuffle_key`, which order them but for ties of these bits; rows are numbers as text."""
    start, md5 = f"{prefix}|".encode(), hashlib.md5
    return np.frombuffer(b"".join([md5(start + r).digest() for r in rows]), ">u8")[::2].astype(np.uint64)


#: Rows of a block that one task sums along; blocks are then summed among themselves.
BLOCK_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/cellweave-checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """df as it is now, for plans that read it twice: a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as it is now, like `materialize`, but in compressed columns: Parquet in the shared folder, removed when the JVM ends."""
    spark = df.sparkSession
    top = f"{shared_folder(spark).rstrip('/')}/cellweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{top}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{top}/rows")


def with_row_id(df: DataFrame, *order: Column | str, name: str = "row_id") -> DataFrame:
    """Zero-based positions in the order of `order`, without a single-partition sort.

    Rows are dealt by ranges of the order; a running count inside each range is added to the rows of earlier
    ranges, of which there is one small row each. The dealt rows are stored, as the borders of ranges come
    from a sample and would differ between two readings.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper 31 bits of the id are the partition, the lower 33 the position in it.
    dealt = dealt.withColumn("__id", F.monotonically_increasing_id())
    plain = all(re.fullmatch(r"(tinyint|smallint|int|bigint|float|double|string|boolean|date|timestamp|decimal.*|array<(int|bigint|double|string)>)", kind) for _, kind in dealt.dtypes)
    numbered = stored(dealt) if plain and len(set(map(str.lower, dealt.columns))) == len(dealt.columns) else materialize(dealt)
    numbered = numbered.withColumn("__part", F.shiftright("__id", 33)).withColumn("__pos", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # One row a range: sent to the rows, which else would all move again with every reading.
    return numbered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__pos")).drop("__part", "__pos", "__start")


def running(df: DataFrame, value: Column | str, out: str, keys: Sequence[str], *order: Column | str, least: bool = False) -> DataFrame:
    """df with out, the sum (or least) of value over the rows of the same keys up to each row, in `order`.

    Rows are numbered by range partitions and cut into blocks of `BLOCK_ROWS`; a block is summed in one task, and what
    comes before it is the sum over the totals of earlier blocks, one small row each.
    """
    over, start = (F.min, F.lit(None)) if least else (F.sum, F.lit(0))
    numbered = with_row_id(df.withColumn("__v", value if isinstance(value, Column) else F.col(value)), *keys, *order, name="__at")
    numbered = numbered.withColumn("__block", F.floor(F.col("__at") / BLOCK_ROWS))
    inside = numbered.withColumn(out, over("__v").over(Window.partitionBy(*keys, "__block").orderBy("__at")))
    totals = numbered.groupBy(*keys, "__block").agg(over("__v").alias("__total"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__block", F.coalesce(over("__total").over(before), start).alias("__start"))
    joined = inside.join(starts, [*keys, "__block"])
    both = F.least(out, "__start") if least else F.col(out) + F.col("__start")
    return joined.withColumn(out, both).drop("__v", "__at", "__block", "__start")


def permutation_plan(spark: SparkSession, steps: Sequence[Sequence[int]]) -> DataFrame:
    """(step, pos, src) of explicit permutations: position pos of a step takes the row src."""
    rows = []
    for step, order in enumerate(steps):
        if sorted(order) != list(range(len(order))):
            raise ValueError("a step of the plan leaves out or repeats a position")
        rows += [(step, pos, int(src)) for pos, src in enumerate(order)]
    return spark.createDataFrame(rows, "step int, pos long, src long")


def composed(steps: Sequence[Sequence[int]]) -> list[list[int]]:
    """Each step applied to the outcome of the steps before it."""
    now, out = list(range(len(steps[0]))) if steps else [], []
    for step in steps:
        now = [now[i] for i in step]
        out.append(list(now))
    return out


def md5_permutations(positions: DataFrame, steps: int, seed: int | str, pos: str = "pos") -> DataFrame:
    """(step, pos, src): for each step a permutation of the positions in the order of md5(seed-step | position).

    All steps are numbered together by range partitions, so a step may be larger than a task.
    """
    each = positions.select(F.col(pos).alias("src")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    key = shuffle_key(F.concat(F.lit(f"{seed}-"), F.col("step").cast("string")), "src")
    ranked = materialize(with_row_id(positions.select(F.col(pos).alias("at")), "at", name="pos"))
    # Every step has as many rows as there are positions, so its k-th row stands at step * n + k.
    n = ranked.count()
    shuffled = with_row_id(each.withColumn("__key", key), "step", "__key", "src", name="__at").withColumn("pos", F.col("__at") % max(1, n))
    # Positions need not be 0 .. n - 1: the k-th of them takes the k-th of the shuffled order.
    return shuffled.join(ranked, "pos").select("step", F.col("at").alias("pos"), "src")


def sample_by_plan(rows: DataFrame, indices: Sequence[int], position: str = "position") -> DataFrame:
    """Rows at the plan's zero-based positions, numbered from 1 in the plan's order as nbhd."""
    if len(set(indices)) != len(indices) or any(i < 0 for i in indices):
        raise ValueError("the plan names a seed twice, or a negative one")
    plan = rows.sparkSession.createDataFrame([(k + 1, int(i)) for k, i in enumerate(indices)], f"nbhd int, {position} long")
    return rows.join(F.broadcast(plan), position) if len(indices) <= 100_000 else rows.join(plan, position)


def sample_by_hash(rows: DataFrame, size: int, seed: int | str, row: str = "row_id") -> DataFrame:
    """`size` rows in md5 order, numbered from 1 as nbhd: a top-k, so no full sort and no partition of everything."""
    top = rows.withColumn("__k", shuffle_key(seed, row)).orderBy("__k", row).limit(size)
    return top.withColumn("nbhd", F.row_number().over(Window.orderBy("__k", row))).drop("__k")


#: Values that one task puts in order, about.
SLICE_VALUES = 1_500_000
#: Rows that are dealt out together.
DEAL_ROWS = 1 << 19
#: Counts of keys that every task gets.
MAX_COUNTS = 1 << 22


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers or doubles in few bytes: distinct ones once if there are few."""
    found, at = np.unique(x, return_inverse=True)
    if len(found) <= 256:
        return b"c" + len(found).to_bytes(2, "little") + zlib.compress(found.tobytes() + at.astype(np.uint8).tobytes(), 1)
    return b"r" + zlib.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    if x[:1] == b"r":
        return np.frombuffer(zlib.decompress(x[1:]), kind)
    n, raw = int.from_bytes(x[1:3], "little"), zlib.decompress(x[3:])
    return np.frombuffer(raw[: 8 * n], kind)[np.frombuffer(raw[8 * n :], np.uint8)]


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ascending numbers as their first and the gaps between them."""
    gaps = np.diff(ids)
    kind = next(k for k in ("u1", "u2", "u4", "u8") if k == "u8" or not len(gaps) or gaps.max() <= np.iinfo(k).max)
    return kind.encode() + int(ids[0]).to_bytes(8, "little", signed=True) + zlib.compress(gaps.astype(kind).tobytes(), 1)


def _unpacked_ids(x: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(x[10:]), x[:2].decode()).astype(np.int64)
    return np.concatenate(([0], np.cumsum(gaps))) + int.from_bytes(x[2:10], "little", signed=True)


def _in_order(prefix: str, ids: np.ndarray) -> np.ndarray:
    """Positions of ids in the order of their keys, then ids."""
    rows = [b"%d" % i for i in ids.tolist()]
    heads = key_heads(prefix, rows)
    order = np.lexsort((ids, heads))
    if (heads[order][1:] == heads[order][:-1]).any():
        whole = [hashlib.md5(f"{prefix}|".encode() + r).hexdigest() for r in rows]
        order = np.array(sorted(range(len(ids)), key=lambda k: (whole[k], ids[k])))
    return order


def permuted_columns(rows: DataFrame, width: int, replicates: int, seed: int | str) -> DataFrame | None:
    """(radius, replicate, v, n): how often the values v meet when each column is put in md5 order by itself; None if it does not apply.

    rows (row_id long, radius, v array<double>) without nulls. Keys are counted by their first bits, so the bits tell a
    row's rank nearly; a task gets a range of ranks of all columns, as packed row numbers and values, and makes the keys again.
    """
    told = rows.groupBy("radius").agg(F.count("*").alias("n"), F.max(F.exists("v", lambda x: x.isNull()) | F.col("row_id").isNull()).alias("lacking")).orderBy("radius").limit(1001).collect()
    sizes = [r["n"] for r in told]
    if not told or len(told) > 1000 or any(r["lacking"] or r["radius"] is None for r in told):
        return None
    step = max(1, SLICE_VALUES // width)
    bits = (8 * -(-max(sizes) // step)).bit_length()
    if (len(told) * replicates * width) << bits > MAX_COUNTS:
        return None
    spark, bins, shift = rows.sparkSession, 1 << bits, np.uint64(64 - bits)
    radii = F.broadcast(spark.createDataFrame([(r["radius"], g) for g, r in enumerate(told)], "radius double, g int"))
    each = rows.join(radii, "radius").select("g", "row_id", "v")

    def blocks(frames):
        """(g, ids, values) of rows in the order of their numbers."""
        held, size = [], 0
        for f in frames:
            held.append((f["g"].to_numpy(np.int64), f["row_id"].to_numpy(np.int64), np.array(f["v"].tolist(), float).reshape(-1, width)))
            size += len(f)
            if size >= DEAL_ROWS:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)

    def cut(held):
        g, ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, g))
        for one in np.unique(g).tolist():
            at = order[g[order] == one]
            yield one, ids[at], v[at]

    def keyed(frames):
        for g, ids, v in blocks(frames):
            texts = [b"%d" % i for i in ids.tolist()]
            for replicate in range(1, replicates + 1):
                for at in range(width):
                    yield g, replicate, at, ids, v[:, at], (key_heads(f"{seed}-{replicate}-{at}", texts) >> shift).astype(np.int64)

    def counted(frames):
        sums: dict[tuple, np.ndarray] = {}
        for g, replicate, at, _, _, k in keyed(frames):
            sums[g, replicate, at] = sums.get((g, replicate, at), 0) + np.bincount(k, minlength=bins)
        if sums:
            yield pd.DataFrame([(*key, x.tolist()) for key, x in sums.items()], columns=["g", "replicate", "at", "n"])

    found = each.mapInPandas(counted, "g int, replicate int, at int, n array<long>")
    found = found.groupBy("g", "replicate", "at").agg(F.array(*(F.sum(F.col("n")[k]) for k in range(bins))).alias("n")) if bins <= 64 else found.select("g", "replicate", "at", F.posexplode("n").alias("k", "n")).groupBy("g", "replicate", "at", "k").agg(F.sum("n").alias("n")).groupBy("g", "replicate", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"]).alias("n"))
    ranks = {}
    for r in found.collect():
        n = np.array(r["n"], np.int64)
        ranks[r["g"], r["replicate"], r["at"]] = (np.cumsum(n) - n, n)
    # Of each bin the first rank and the ranges of ranks that it touches; an empty one touches none.
    spans = {key: (start, start // step, np.where(n > 0, (start + n - 1) // step, -1)) for key, (start, n) in ranks.items()}

    def dealt(frames):
        for g, replicate, at, ids, values, k in keyed(frames):
            _, first, last = spans[g, replicate, at]
            low, high, out = first[k], last[k], []
            for part in range(-(-sizes[g] // step)):
                own = np.flatnonzero((low <= part) & (part <= high))
                if len(own):
                    out.append((g, replicate, part, at, _packed_ids(ids[own]), _packed(values[own])))
            yield pd.DataFrame(out, columns=["g", "replicate", "part", "at", "ids", "values"])

    def met(f):
        g, replicate, part = (int(f[c].iloc[0]) for c in ("g", "replicate", "part"))
        low, high = part * step, min((part + 1) * step, sizes[g])
        codes, kinds = np.zeros(high - low, np.int64), []
        for at in range(width):
            own = f[f["at"] == at]
            ids = np.concatenate([_unpacked_ids(x) for x in own["ids"]])
            values = np.concatenate([_unpacked(x, np.float64) for x in own["values"]])
            start, first, last = spans[g, replicate, at]
            before = int(start[np.flatnonzero((first <= part) & (part <= last))[0]])
            ranked = values[_in_order(f"{seed}-{replicate}-{at}", ids)][low - before : high - before]
            kind, code = np.unique(ranked, return_inverse=True)
            # Codes stay below the number of rows: what has been met so far is numbered anew.
            codes = np.unique(codes, return_inverse=True)[1] * len(kind) + code
            kinds.append(ranked)
        _, one, n = np.unique(codes, return_index=True, return_counts=True)
        return pd.DataFrame({"radius": told[g]["radius"], "replicate": replicate, "v": np.stack([x[one] for x in kinds], axis=1).tolist(), "n": n})

    shipped = each.mapInPandas(dealt, "g int, replicate int, part int, at int, ids binary, values binary")
    return shipped.groupBy("g", "replicate", "part").applyInPandas(met, "radius double, replicate int, v array<double>, n long")
