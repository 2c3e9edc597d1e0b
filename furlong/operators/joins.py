"""Race card, run links, odds as of a cut-off, and key checks.

All joins are equi-joins on entity keys. Large sides are left to the adaptive
planner, which splits skewed partitions of a sort-merge join; only fixed
dimensions are broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fields as fx
from furlong.operators.aggregates import placings, rates

RUN_KEYS = tuple(f"prev_race_key_{i}" for i in range(1, 6))


def _extra(df: DataFrame, keys: Sequence[str], taken: Sequence[str]) -> DataFrame:
    """The keys plus the columns that are not there yet."""
    return df.select(*keys, *[c for c in df.columns if c not in taken and c not in keys])


def race_card(entries: DataFrame, races: DataFrame, meetings: DataFrame, extended: DataFrame | None = None,
              horses: DataFrame | None = None, odds: DataFrame | None = None) -> DataFrame:
    """One row per entry with its race, meeting and, where given, condition record, horse and odds.

    Sides have one row per key; columns already present are not taken again.
    """
    card = races.join(_extra(meetings.withColumnRenamed("venue_id", "_meeting"), ["_meeting"], races.columns),
                      fx.meeting_key(F.col("race_id")) == F.col("_meeting"), "left").drop("_meeting")
    card = entries.join(_extra(card, ["race_id"], entries.columns), "race_id", "left")
    for side, keys in ((extended, ["race_id", "horse_number"]), (odds, ["race_id", "horse_number"]),
                       (horses, ["horse_id"])):
        if side is not None:
            card = card.join(_extra(side, keys, card.columns), keys, "left")
    return card


def run_links(entries: DataFrame, ids: Sequence[str], run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The previous-run keys of each entry as rows (run_no 1 is the latest)."""
    parts = fx.run_key_parts(F.col("run_key"))
    return (
        entries.select(*ids, F.posexplode(F.array(*run_keys)).alias("_pos", "run_key"))
        .where(F.col("run_key").isNotNull())
        .withColumn("run_no", F.col("_pos") + 1).drop("_pos")
        .withColumn("run_horse_id", parts["horse_id"]).withColumn("run_date", parts["race_date"])
    )


def past_runs(entries: DataFrame, results: DataFrame, ids: Sequence[str], columns: Sequence[str],
              run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Linked earlier results of each entry; links without a result stay with NULLs."""
    runs = results.select(F.col("horse_id").alias("run_horse_id"), F.col("race_date").alias("run_date"), *columns)
    return run_links(entries, ids, run_keys).join(runs, ["run_horse_id", "run_date"], "left")


def person_record(entries: DataFrame, results: DataFrame, who: str, on: Sequence[str],
                  position: str = "finish_position") -> DataFrame:
    """Placing counters and rates of a jockey or trainer."""
    joined = entries.select(*on, who).join(results.select(*on, position), list(on))
    return rates(joined.groupBy(who).agg(*placings(F.col(position))))


def with_pedigree(entries: DataFrame, pedigree: DataFrame, columns: Sequence[str]) -> DataFrame:
    return entries.join(pedigree.select("horse_id", *columns), "horse_id", "left")


def known(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key exists in the reference table."""
    return df.join(reference.select(*keys), list(keys), "left_semi")


def orphans(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is missing from the reference table."""
    return df.join(reference.select(*keys), list(keys), "left_anti")


def odds_as_of(entries: DataFrame, odds: DataFrame, keys: Sequence[str], cutoffs: Mapping[str, Column],
               value: str = "odds_value", ts: str = "odds_timestamp") -> DataFrame:
    """Last price at or before each cut-off, one column per cut-off.

    ``entries`` has one row per key, so the join adds nothing to the number of
    price rows; every cut-off is a conditional ``max_by`` of the same
    aggregation, which combines before the shuffle. Entries without an earlier
    price keep NULL.
    """
    keys = list(keys)
    limits = entries.select(*keys, *[c.alias(f"_c_{n}") for n, c in cutoffs.items()])
    latest = F.greatest(*[F.col(f"_c_{n}") for n in cutoffs]) if len(cutoffs) > 1 \
        else F.col(f"_c_{next(iter(cutoffs))}")
    prices = (
        odds.select(*keys, value, ts).join(limits, keys).where(F.col(ts) <= latest)
        .groupBy(*keys).agg(*[
            F.max_by(F.when(F.col(ts) <= F.col(f"_c_{n}"), F.col(value)),
                     F.when(F.col(ts) <= F.col(f"_c_{n}"), F.col(ts))).alias(n)
            for n in cutoffs])
    )
    return entries.join(prices, keys, "left")


def race_cutoffs(race_date: Column, start: Column, hour: int = 10, minutes: int = 15) -> dict[str, Column]:
    """The evening before, a fixed hour of the day, and some minutes before the start."""
    midnight = race_date.cast("timestamp")
    return {
        "odds_yesterday": midnight - F.expr("INTERVAL '1' SECOND"),
        "odds_today": midnight + F.make_dt_interval(hours=F.lit(hour)),
        "odds_last": start - F.make_dt_interval(mins=F.lit(minutes)),
    }
