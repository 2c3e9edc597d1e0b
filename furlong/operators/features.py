"""Composite features built from the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.history import RUN_NO, last_n, standardised, with_history
from furlong.operators.in_race import style_code


def weight_corrected(value: Column, weight: Column, slope: float, base: float = 55.0) -> Column:
    """Time (or last 3F) as if the horse had carried the base weight; slope per kilogram."""
    return value - slope * (weight - base)


def weight_slopes(results: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Fitted seconds per kilogram for each course condition."""
    return results.groupBy(*keys).agg(F.regr_slope(value, weight).alias("weight_slope"))


def ability_index(results: DataFrame, par_keys: Sequence[str], day: str, time: str, last3f: str, weight: str,
                  class_level: str, name: str = "ability", time_slope: float = 0.2,
                  last3f_slope: float = 0.05) -> DataFrame:
    """50 plus ten points per deviation of time and last 3F below par, plus two per class level.

    Times are corrected for carried weight and compared with earlier days of
    the same conditions only; a part without a par yet counts as average.
    """
    out = standardised(results, par_keys, day, {
        "_z_time": weight_corrected(F.col(time), F.col(weight), time_slope),
        "_z_last": weight_corrected(F.col(last3f), F.col(weight), last3f_slope)})
    zero = F.lit(0.0)
    score = 50.0 - 10.0 * F.coalesce("_z_time", zero) - 5.0 * F.coalesce("_z_last", zero) \
        + 2.0 * F.coalesce(F.col(class_level).cast("double"), zero)
    return out.withColumn(name, score).drop("_z_time", "_z_last")


def ability_history(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str], value: str = "ability",
                    n: int = 5) -> DataFrame:
    """Past mean, best, trend and gap of the last figure to the recent mean, in one window pass."""
    out = with_history(df, entity, day, tie, [value], {
        f"{value}_mean": lambda o: F.avg(value).over(last_n(o, n)),
        f"{value}_best": lambda o: F.max(value).over(last_n(o, n)),
        f"{value}_trend": lambda o: F.regr_slope(F.col(value), F.col(RUN_NO)).over(last_n(o, n)),
        f"{value}_last": lambda o: F.lag(value).over(o),
    }, n)
    return out.withColumn(f"{value}_gap", F.col(f"{value}_last") - F.col(f"{value}_mean"))


def running_style(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str], early: str, late: str,
                  n: int = 5) -> DataFrame:
    """Style code 1-6 from the relative early and late positions of the last n runs."""
    out = with_history(df, entity, day, tie, [early, late], {
        "_early": lambda o: F.avg(early).over(last_n(o, n)),
        "_late": lambda o: F.avg(late).over(last_n(o, n)),
        "_closing": lambda o: F.avg((F.col(late) < F.col(early)).cast("int")).over(last_n(o, n)),
    }, n)
    return out.withColumn("style", style_code(F.col("_early"), F.col("_late"), F.col("_closing"))) \
        .drop("_early", "_late", "_closing")
