"""Scenes as a stream: statistics of each arriving scene, envelopes kept up to date.

Zone statistics of a scene need that scene alone, so each micro-batch writes its
own partition and a batch that runs twice replaces what it wrote.  Envelopes are
percentiles of the dates' statistics and cannot be merged; they are made anew
from the small table of dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import zonal


def statistics_stream(px: DataFrame, keys: list[str], out: str, checkpoint: str, least: int = 50, width: int = 30) -> StreamingQuery:
    """Write the statistics of arriving pixels (keys with date, value) under out, by batch."""

    def one(batch: DataFrame, number: int) -> None:
        found = zonal.with_season(zonal.statistics(batch, keys, least), width)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return px.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def envelopes_now(spark: SparkSession, out: str) -> DataFrame:
    """Envelopes of all dates written so far."""
    return zonal.envelopes(spark.read.parquet(out))


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", length: str = "1 hour", *keys: str) -> DataFrame:
    """Rows in tumbling windows with a watermark, for monitoring a stream of observations."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"))
