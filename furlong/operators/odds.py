"""Price movement and payout rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.operators.groups import keyed


def odds_movement(odds: DataFrame, keys: Sequence[str], value: str = "odds_value",
                  ts: str = "odds_timestamp") -> DataFrame:
    """Change against the previous snapshot and since the first one.

    Snapshots are windowed per key and hour; the last price of the previous
    hours is carried in from one row per key and hour, so a key with very many
    snapshots is spread over its hours. Rows without a key or a time have no
    change.
    """
    keys = list(keys)
    hourly = odds.withColumn("_hour", F.date_trunc("hour", ts))
    timed = keyed([*keys, ts])
    closes = hourly.where(timed).groupBy(*keys, "_hour").agg(
        F.max_by(value, ts).alias("_close"), F.min_by(value, ts).alias("_open"))
    by_hour = W.partitionBy(*keys).orderBy("_hour")
    carried = closes.withColumn("_carry", F.lag("_close").over(by_hour)) \
        .withColumn("_open", F.first("_open").over(by_hour)).drop("_close")
    inside = W.partitionBy(*keys, "_hour").orderBy(ts)
    out = hourly.withColumn("_prev", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside)) \
        .join(carried, [*keys, "_hour"], "left")
    previous = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return out.withColumn("change", F.when(timed, F.col(value) - previous)) \
        .withColumn("change_from_open", F.col(value) - F.col("_open")).drop("_prev", "_open", "_hour", "_n", "_carry")


def payout_rows(df: DataFrame, ids: Sequence[str], bets: Mapping[str, Sequence[tuple[Column, Column]]]) -> DataFrame:
    """Repeated payout fields as rows (bet_type, combination, payout); empty slots are dropped."""
    slots = F.array(*[
        F.struct(F.lit(kind).alias("bet_type"), combination.cast("string").alias("combination"),
                 payout.cast("double").alias("payout"))
        for kind, items in bets.items() for combination, payout in items])
    return df.select(*ids, F.inline(slots)).where(F.col("payout").isNotNull())


def sale_flags(flags: Column, names: Sequence[str]) -> dict[str, Column]:
    """One boolean per bet type from a string of 0/1 positions."""
    return {name: F.substring(flags, i + 1, 1) == "1" for i, name in enumerate(names)}


def sale_bits(bits: Column, names: Sequence[str]) -> dict[str, Column]:
    """One boolean per bet type from the bits of an integer, lowest first."""
    return {name: F.getbit(bits, F.lit(i)) == 1 for i, name in enumerate(names)}
