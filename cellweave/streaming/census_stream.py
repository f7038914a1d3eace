"""Stream-static censuses: seeds arrive, points stand still.

A seed's neighbourhood needs no other seed, so the join is stateless and runs in append mode; only window
counts keep state, which a watermark bounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators.census import sites
from cellweave.operators.range_join import AXES


def neighbourhood_index(points: DataFrame, radius: float, scalars: int = 0) -> DataFrame:
    """The static side: sites by cell."""
    cells = [F.floor(F.col(a) / radius).cast("long").alias(f"c{a}") for a in AXES]
    return sites(points, scalars).select(*(F.col(a).alias(f"p_{a}") for a in AXES), "object", "area", *cells)


def stream_members(seeds: DataFrame, index: DataFrame, radius: float) -> DataFrame:
    """Members of each arriving seed (its columns and object, area): a stream-static equi-join on cells."""
    steps = F.array(*(F.struct(*(F.lit(o).alias(f"c{a}") for a, o in zip(AXES, offset, strict=True))) for offset in itertools.product((-1, 0, 1), repeat=3)))
    left = seeds.withColumn("__o", F.explode(steps))
    left = left.select(*seeds.columns, *((F.floor(F.col(a) / radius).cast("long") + F.col(f"__o.c{a}")).alias(f"c{a}") for a in AXES))
    d2 = sum(((F.col(a) - F.col(f"p_{a}")) * (F.col(a) - F.col(f"p_{a}")) for a in AXES), F.lit(0.0))
    return left.join(index, [f"c{a}" for a in AXES]).where(d2 <= F.lit(radius * radius)).select(*seeds.columns, "object", "area")


def percentages(members: DataFrame, keys: Sequence[str], objects: Sequence[int]) -> DataFrame:
    """Wide percentages O1.<id> of seeds (keys) whose objects are known; for one batch of members."""
    total = F.sum("area")
    return members.groupBy(*keys).agg(*((100 * F.sum(F.when(F.col("object") == o, F.col("area")).otherwise(0)) / total).alias(f"O1.{o}") for o in objects))


def census_stream(seeds: DataFrame, points: DataFrame, radius: float, objects: Sequence[int], keys: Sequence[str], target: str, checkpoint: str) -> StreamingQuery:
    """Write the census of each micro-batch of seeds to a Parquet folder by batch, so a replayed batch replaces itself."""
    index = neighbourhood_index(points, radius)

    def write(batch: DataFrame, number: int) -> None:
        percentages(stream_members(batch, index, radius), keys, objects).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return seeds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def object_counts(events: DataFrame, time: str, object_column: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Objects seen per time window; rows later than the watermark are left out and state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), object_column).agg(F.count("*").alias("n"))
