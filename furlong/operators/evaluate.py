"""Labels, time splits, the leakage guard and backtests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.groups import with_place
from furlong.operators.in_race import bucket_of

# Columns that are only known once a race has been run.
POST_RACE = (
    "win_odds", "win_popularity", "place_odds", "confirmed_weight", "confirmed_weight_diff", "horse_weight",
    "horse_weight_diff", "track_condition_final", "finish_time", "raw_score", "track_bias", "pace", "late_start",
    "position_fault", "disadvantage", "race_score", "winner_time_diff", "front_3f_time", "last_3f_time",
    "corner_position_1", "corner_position_2", "corner_position_3", "corner_position_4", "abnormal_code",
    "cancel_flag", "payout",
)


# Abnormal codes of runs that finished all the same.
FINISHED = (0, 5, 6)


def label(df: DataFrame, position: str = "finish_position", abnormal: str | None = "abnormal_code",
          name: str = "target_place") -> DataFrame:
    """Top-three target; runs that were cancelled, excluded, stopped or disqualified are left out."""
    if abnormal:
        df = df.where(F.coalesce(F.col(abnormal), F.lit(0)).isin(*FINISHED))
    return df.where(F.col(position) >= 1).withColumn(name, F.col(position).between(1, 3))


def time_split(df: DataFrame, day: str, cuts: Mapping[str, date], last: str = "test",
               name: str = "split") -> DataFrame:
    """Split by date: each cut is the first day that no longer belongs to its part.

    ``{"train": d1, "valid": d2}`` gives train before d1, valid before d2, test
    from d2 on. All runners of a race share its date, so no race straddles.
    """
    part = None
    for split, end in sorted(cuts.items(), key=lambda kv: kv[1]):
        cond = F.col(day) < F.lit(end)
        part = F.when(cond, split) if part is None else part.when(cond, split)
    return df.withColumn(name, F.when(F.col(day).isNotNull(), part.otherwise(last)))


def straddling(df: DataFrame, race: Sequence[str], split: str = "split") -> DataFrame:
    """Races that appear in more than one part (must be empty)."""
    return df.groupBy(*race).agg(F.min(split).alias("_a"), F.max(split).alias("_b")) \
        .where(F.col("_a") != F.col("_b")).select(*race)


def period_index(day: Column, period: str, start: date) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    first = F.trunc(F.lit(start), period)
    return F.floor(F.months_between(F.trunc(day, period), first) / months).cast("int")


def rolling_folds(df: DataFrame, day: str, period: str, start: date, folds: int,
                  window: int | None = None) -> DataFrame:
    """Rows of each fold: fold k validates on period k and trains on earlier ones.

    Fold numbers run from 1; ``window`` limits training to the last periods.
    Each row is repeated once per fold it takes part in.
    """
    p = F.col("_period")
    last = F.least(F.lit(folds), p + window) if window else F.lit(folds)
    first = F.greatest(p, F.lit(1))
    return (
        df.withColumn("_period", period_index(F.col(day), period, start))
        .where((p >= 0) & (first <= last))
        .withColumn("fold", F.explode(F.sequence(first, last)))
        .withColumn("role", F.when(p == F.col("fold"), "valid").otherwise("train"))
        .drop("_period")
    )


def leaking_columns(columns: Sequence[str], allow: Sequence[str] = ()) -> list[str]:
    return [c for c in columns if c in POST_RACE and c not in allow]


def assert_no_leak(df: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """Pass the frame through, or fail naming the post-race columns in it."""
    found = leaking_columns(df.columns, allow)
    if found:
        raise ValueError("post-race columns in the feature set: " + ", ".join(found))
    return df


def backtest(bets: DataFrame, payouts: DataFrame, on: Sequence[str], by: Sequence[str],
             stake: str = "stake", payout: str = "payout", unit: float = 100.0) -> DataFrame:
    """Stake, return, hit rate and return rate in percent, per group and in total (rollup).

    Payouts are quoted per ``unit`` staked and have one row per winning
    combination.
    """
    won = bets.join(payouts.select(*on, payout), list(on), "left")
    gain = F.coalesce(F.col(stake) * F.col(payout) / unit, F.lit(0.0))
    return (
        won.withColumn("_gain", gain).rollup(*by)
        .agg(F.count("*").alias("bets"), F.sum(stake).alias("staked"), F.sum("_gain").alias("returned"),
             F.avg(F.col(payout).isNotNull().cast("int")).alias("hit_rate"),
             F.grouping_id().alias("level"))
        .withColumn("return_rate", F.when(F.col("staked") > 0, F.col("returned") / F.col("staked") * 100.0))
        .withColumn("profitable", F.col("return_rate") >= 100.0)
    )


def calibration(df: DataFrame, score: str, outcome: Column, tie: Sequence[str], n: int = 10) -> DataFrame:
    """Mean score and hit rate per quantile of the score over all rows; a missing score counts as highest.

    Rows are placed by score, then ``tie``, in ranges of near-equal numbers of rows, however the scores are distributed.
    """
    rows = df.select(F.col(score).alias("_score"), outcome.cast("int").alias("_hit"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)])
    order = [F.col("_score").asc_nulls_last(), *[F.col(f"_t{i}").asc() for i in range(len(tie))]]
    placed = with_place(rows, order, "_place", "_size")
    return placed.groupBy(bucket_of(F.col("_place"), F.col("_size"), n).alias("decile")).agg(
        F.count("*").alias("rows"), F.avg("_score").alias("mean_score"), F.avg("_hit").alias("hit_rate"))
