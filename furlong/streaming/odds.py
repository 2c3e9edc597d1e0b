"""Odds ticks as a stream: snapshots and change per time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def odds_buckets(ticks: DataFrame, keys: Sequence[str], value: str = "odds_value", ts: str = "odds_timestamp",
                 watermark: str = "10 minutes", bucket: str = "10 minutes", slide: str | None = None,
                 tick_id: Sequence[str] | None = None) -> DataFrame:
    """Opening and closing price, number of ticks and change per key and time bucket.

    Repeated ticks are dropped within the watermark. Works on streams and, with
    the same result per closed bucket, on batch frames. ``slide`` makes the
    buckets overlap.
    """
    ids = list(tick_id or [*keys, ts])
    if ticks.isStreaming:
        ticks = ticks.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(ids)
    else:
        ticks = ticks.dropDuplicates(ids)
    window = F.window(ts, bucket, slide) if slide else F.window(ts, bucket)
    return (
        ticks.groupBy(window.alias("bucket"), *keys)
        .agg(F.min_by(value, ts).alias("open_value"), F.max_by(value, ts).alias("close_value"),
             F.count("*").alias("ticks"))
        .select(F.col("bucket.start").alias("bucket_start"), F.col("bucket.end").alias("bucket_end"), *keys,
                "open_value", "close_value", (F.col("close_value") - F.col("open_value")).alias("change"), "ticks")
    )


def open_buckets(spark: SparkSession, checkpoint: str, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets that a stopped stream of ``odds_buckets`` still holds: those that its watermark has not closed.

    They are read from the state in its checkpoint, after its last completed
    batch, one task per state partition. ``like`` is the stream's frame (for
    the types). The stream may be started again later; nothing is changed.
    """
    kept = spark.read.format("state-metadata").load(checkpoint).where("operatorName = 'stateStoreSave'").select("operatorId").first()
    if kept is None:
        return spark.createDataFrame([], like.schema)
    state = spark.read.format("statestore").option("operatorId", kept[0]).load(checkpoint)
    kinds = {f.name: f.dataType for f in like.schema}
    # the fields of the buffer repeat their names, so they are told apart by position
    buffer = T.StructType().add("open_value", kinds["open_value"]).add("open_at", T.TimestampType()) \
        .add("close_value", kinds["close_value"]).add("close_at", T.TimestampType()).add("ticks", T.LongType())
    held = state.select("key", F.col("value").cast(buffer).alias("value"))
    return held.select(
        F.col("key.window.start").alias("bucket_start"), F.col("key.window.end").alias("bucket_end"), *[F.col(f"key.{k}").alias(k) for k in keys],
        "value.open_value", "value.close_value", (F.col("value.close_value") - F.col("value.open_value")).alias("change"), "value.ticks")


def last_prices(closed: DataFrame, still_open: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last price of each key, from the buckets that were written and those still open."""
    return closed.unionByName(still_open).groupBy(*keys).agg(
        F.max_by("close_value", "bucket_start").alias("last_value"), F.max("bucket_start").alias("bucket_start"), F.sum("ticks").alias("ticks"))
