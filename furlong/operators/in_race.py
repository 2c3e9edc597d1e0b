"""Comparisons between the runners of one race.

A race is small by nature: its field is limited by rule to a few dozen runners,
so its rows fit one window partition at any table size. Groups without such a
limit (the runs of a day) are ranked through their distinct values instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.operators.groups import ALONE, keyed, set_apart


def _direction(value: str, descending: bool) -> Column:
    return F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()


def rank_in_race(df: DataFrame, race: Sequence[str], value: str, name: str, descending: bool = True,
                 dense: bool = False) -> DataFrame:
    """Rank within the race; equal values share a rank, a missing value or race has none."""
    order = W.partitionBy(*race, ALONE).orderBy(_direction(value, descending))
    ranked = F.dense_rank().over(order) if dense else F.rank().over(order)
    out = set_apart(df, race).withColumn(name, F.when(F.col(value).isNotNull() & keyed(race), ranked))
    return out.select(*[c for c in out.columns if c != ALONE or c in df.columns])


def minus_race_mean(df: DataFrame, race: Sequence[str], value: str, name: str) -> DataFrame:
    out = race_totals(df, race, {"_mean": F.avg(value)})
    return out.withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def race_totals(df: DataFrame, race: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add aggregates over the whole race to each of its runners; NULL without a race."""
    whole = W.partitionBy(*race, ALONE)
    out = set_apart(df, race).withColumns({n: F.when(keyed(race), c.over(whole)) for n, c in totals.items()})
    return out.select(*[c for c in out.columns if c != ALONE or c in df.columns])


def upset(df: DataFrame, race: Sequence[str], ability: str, popularity: str) -> DataFrame:
    """Popularity rank minus ability rank: positive when the runner is better than it is backed."""
    out = rank_in_race(set_apart(df, race), race, ability, "ability_rank")
    out = rank_in_race(out, race, popularity, "popularity_rank").drop(ALONE)
    return out.withColumn("upset", F.col("popularity_rank") - F.col("ability_rank"))


def bucket_of(position: Column, size: Column, buckets: int) -> Column:
    """Bucket of a 0-based position when ``size`` rows are dealt into near-equal buckets."""
    base, extra = F.floor(size / buckets), size % buckets
    wide = extra * (base + 1)
    return F.when(position < wide, F.floor(position / (base + 1)) + 1) \
        .otherwise(extra + F.floor((position - wide) / base) + 1).cast("int")


def buckets(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], n: int = 10,
            name: str = "bucket", descending: bool = True) -> DataFrame:
    """Quantile bucket (1 is the best) of a score within a race or day, and its percent rank.

    Running counts over the distinct values of a group place each value, and
    only rows of equal value are ordered by ``tie``. The rows are shuffled once,
    by group and value, and the places come to them. Rows without a group have
    neither bucket nor rank and stay out of all that.
    """
    group = list(group)
    # plain keys, as a join that matches NULLs would shuffle the rows anew
    missing, known = F.col(value).isNull(), F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.lit(0))
    rows = df.where(keyed(group)).withColumns({"_missing": missing, "_value": known})
    same = [*group, "_missing", "_value"]
    among = W.partitionBy(*same).orderBy(*[F.col(c).asc() for c in tie])
    rows = rows.withColumn("_among", F.row_number().over(among) - 1)
    counts = df.where(keyed(group)).select(*group, missing.alias("_missing"), known.alias("_value")).groupBy(*same).agg(F.count("*").alias("_count"))
    order = W.partitionBy(*group).orderBy("_missing", _direction("_value", descending))
    places = counts.withColumn("_first", F.coalesce(F.sum("_count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_size", F.sum("_count").over(W.partitionBy(*group))).drop("_count")
    out = rows.join(places, same)
    share = F.when(F.col("_size") > 1, F.col("_first") / (F.col("_size") - 1)).otherwise(F.lit(0.0))
    placed = out.select(*df.columns, bucket_of(F.col("_first") + F.col("_among"), F.col("_size"), n).alias(name), share.alias("percent_rank"))
    none = df.where(~keyed(group)).select(*df.columns, F.lit(None).cast("int").alias(name), F.lit(None).cast("double").alias("percent_rank"))
    return placed.unionByName(none)


def top_k(df: DataFrame, race: Sequence[str], value: str, tie: Sequence[str], k: int = 3) -> DataFrame:
    """The k best runners of each race.

    The row-number filter is applied before the shuffle as well, so even a huge
    group sends only k rows per input partition.
    """
    order = W.partitionBy(*race).orderBy(_direction(value, True), *[F.col(c).asc() for c in tie])
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def race_dispersion(df: DataFrame, race: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Spread of each value over the runners (how open the race is)."""
    return df.groupBy(*race).agg(*[F.stddev_samp(v).alias(f"{v}_spread") for v in values])


def pace_profile(df: DataFrame, race: Sequence[str], style: Column, figure: str, threshold: float,
                 styles: Sequence[str]) -> DataFrame:
    """Runners per style, front-runner candidates and the expected pace of a race.

    Candidates have an early figure of at least ``threshold``; the pace score
    is their mean figure.
    """
    front = F.col(figure) >= threshold
    return df.groupBy(*race).agg(
        *[F.count_if(style == s).alias(f"style_{s}") for s in styles],
        F.count_if(front).alias("front_runner_count"),
        F.avg(F.when(front, F.col(figure))).alias("expected_pace_score"))


def style_match(df: DataFrame, profile: DataFrame, race: Sequence[str], style: Column,
                front_styles: Sequence[str], crowded: int = 3) -> DataFrame:
    """Own style against the race: a crowded front suits closers and the reverse."""
    front, many = style.isin(*front_styles), F.col("front_runner_count") >= crowded
    return df.join(profile, list(race), "left").withColumn(
        "style_match", F.when(front & ~many, "lone_front").when(front, "contested_front")
        .when(many, "suited_closer").otherwise("unsuited_closer"))


def style_code(early: Column, late: Column, closing_rate: Column) -> Column:
    """Running style 1-6 from mean relative positions (0 front, 1 back) and closing rate.

    1 leads, 2 prominent, 3 midfield closer, 4 late closer, 5 stalker that
    gains ground, 6 no fixed style. Means are compared at nine decimals, so the
    order in which they were summed cannot tip a boundary.
    """
    early, late, closing_rate = F.round(early, 9), F.round(late, 9), F.round(closing_rate, 9)
    gain = F.round(early - late, 9)
    return (
        F.when(early.isNull(), None).when(early <= 0.1, 1)
        .when((early <= 0.4) & (gain >= 0.1), 5).when(early <= 0.4, 2)
        .when((early >= 0.7) & (closing_rate >= 0.5), 4).when(early >= 0.4, F.when(gain > 0, 3).otherwise(6))
        .otherwise(6)
    )
