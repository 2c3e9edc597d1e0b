"""Assembly of the feature table: one row per labelled entry, 41 columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.functions.derive import distance_band
from furlong.operators.evaluate import FINISHED, assert_no_leak, label
from furlong.operators.groups import ALONE, keyed, set_apart, stored
from furlong.operators.history import attach_state, last_n, state_before, totals_before, with_history
from furlong.operators.in_race import race_totals, rank_in_race
from furlong.operators.joins import odds_as_of
from furlong.operators.target_encoding import smoothed
from furlong.sources.schemas import table_schema

HEAVY = ("重", "速重", "遅重", "不良", "速不良", "遅不良")


#: Columns of the result that are outcomes by design; nothing else in the table may be one.
OUTCOMES = ("target_place", "finish_position")

#: What names a row of the stored base: its race, and its number there.
ROW = ("race_id", "_no")


def entry_base(races: DataFrame, entries: DataFrame, results: DataFrame, pedigree: DataFrame) -> DataFrame:
    """The narrow columns all features are computed from, one row per entry.

    A run that was cancelled, stopped or disqualified, or whose position is
    zero, carries no position. Entries without a race have no date, so they
    cannot be placed in time; ``entries_without_race`` lists them.
    """
    finished = F.coalesce(F.col("abnormal_code"), F.lit(0)).isin(*FINISHED) & (F.col("finish_position") >= 1)
    outcome = results.select("race_id", "horse_number", F.when(finished, F.col("finish_position")).alias("finish_position"),
                             "abnormal_code", "last_3f_time")
    parents = pedigree.select("horse_id", "sire_id", "dam_sire_id")
    course = races.select("race_id", "race_date", "venue_code", "race_number", "course_type", "distance",
                          "track_condition", "num_horses")
    runner = entries.select("race_id", "horse_number", "horse_id", "bracket_number", "jockey_code",
                            "trainer_code", "weight_carried", "idm", "ten_index")
    return (
        runner.join(parents, "horse_id", "left")
        .join(course, "race_id")  # from here on by race, so that the outcomes and the windows over a race share its shuffle
        .join(outcome, ["race_id", "horse_number"], "left")
        .withColumn("_band", distance_band(F.col("distance")))
    )


def entries_without_race(races: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that the feature table cannot hold, with the reason."""
    return entries.select("race_id", "horse_number", "horse_id").join(races.select("race_id"), "race_id", "left_anti") \
        .withColumn("reject_reason", F.lit("no race"))


def stacked_totals(base: DataFrame, sets: dict[str, str], day: str, sums: dict[str, Column],
                   wanted: dict[str, tuple[str, ...]], row: Sequence[str] = ROW) -> DataFrame:
    """Running totals over earlier days of several keys at once: one row per row of ``base``, columns ``<set><sum>``.

    All keys are stacked in one expand, summed per key and day before the shuffle and accumulated in one window, so a
    dominant key has at most one row a day there. Rows are dealt out by day, are expanded to their keys and meet the
    totals there, and the totals of a row's keys are put side by side in the same task where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is off. A row has no totals of a key that, or whose day, is missing.
    """
    def tag(name: str, key: str) -> Column:
        return F.when(keyed([key, day]), F.struct(F.lit(name).alias("_set"), F.col(key).cast("string").alias("_key")))

    tags = F.inline(F.filter(F.array(*[tag(n, k) for n, k in sets.items()]), lambda t: t.isNotNull()))
    key = ["_set", "_key"]
    daily = base.select(day, *[c.alias(n) for n, c in sums.items()], tags).groupBy(*key, day).agg(*[F.sum(n).alias(n) for n in sums])
    earlier = W.partitionBy(*key).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    running = daily.select(*key, day, *[F.sum(n).over(earlier).alias(f"_t{n}") for n in sums])
    rows = base.where(keyed([day])).select(*row, day, *dict.fromkeys(sets.values())).repartition(day)
    found = rows.select(*row, day, tags).join(running, [*key, day])
    return found.groupBy(day, *row).agg(*[F.max(F.when(F.col("_set") == name, F.col(f"_t{n}"))).alias(f"{name}{n}")
                                          for name, own in wanted.items() for n in own]).drop(day)


def _rate(hits: str, count: str) -> Column:
    return F.col(hits) / F.when(F.col(count) > 0, F.col(count))


def training_data(races: DataFrame, entries: DataFrame, results: DataFrame, pedigree: DataFrame,
                  odds: DataFrame, created_at: datetime, m: float = 10.0, front_threshold: float = 0.0,
                  heavy: Sequence[str] = HEAVY, odds_type: str = "win", morning_hour: int = 10) -> DataFrame:
    """All features of every run with a result, built from earlier days only.

    The joined base is written once, with the comparisons inside a race. Features are computed from the few columns they
    need, dealt out once by horse, jockey or day, and meet the base by race, whose wide rows are shuffled once. Abnormal
    runs count in the histories' dates but carry no position, and are not labelled. The runs of one horse or jockey are one
    task's; totals of trainers and sires, who are few and own many runs, are summed per day before any shuffle.
    """
    race = ["race_id"]
    base = entry_base(races, entries, results, pedigree)
    columns = base.columns
    base = set_apart(base, race)  # once, so that the windows share a shuffle
    for value, name, descending in (("weight_carried", "weight_rank", True), ("idm", "ability_rank", True)):
        base = rank_in_race(base, race, value, name, descending)
    front = F.col("ten_index") >= front_threshold
    base = race_totals(base, race, {
        "front_runner_count": F.count_if(front),
        "expected_pace_score": F.avg(F.when(front, F.col("ten_index")))})
    base = base.withColumn("_no", F.row_number().over(W.partitionBy(*race, ALONE).orderBy(F.col("idm").desc_nulls_last())))
    compared = ["weight_rank", "ability_rank", "front_runner_count", "expected_pace_score"]
    base = stored(base.select(*columns, *compared, "_no"), "entry-base")
    day, position = "race_date", F.col("finish_position")
    ran = position.isNotNull()
    won, placed = position == 1, position <= 3
    counts = {"_n": F.when(ran, 1).otherwise(0), "_w": F.when(won, 1).otherwise(0), "_p": F.when(placed, 1).otherwise(0)}
    nw = {n: counts[n] for n in ("_n", "_w")}

    kinds = {"turf": F.col("course_type") == "turf", "dirt": F.col("course_type") == "dirt",
             "heavy_track": F.col("track_condition").isin(*heavy)}
    number = F.unix_date(day).alias(day)
    by_horse = base.where(keyed(["horse_id"])).select(
        *ROW, "horse_id", number, "finish_position", "last_3f_time", "_band", "venue_code", *[c.alias(f"_{k}") for k, c in kinds.items()]).repartition("horse_id")
    past = with_history(by_horse, ["horse_id"], day, ["race_id"], ["finish_position", "last_3f_time"], {
        **{f"past_{n}_avg_position": lambda o, n=n: F.avg("finish_position").over(last_n(o, n)) for n in (3, 5, 10)},
        **{f"past_{n}_avg_last3f": lambda o, n=n: F.avg("last_3f_time").over(last_n(o, n)) for n in (3, 5)},
    }, 10, dealt=True)
    # Times have one decimal; rounding lets equal means rank as equal.
    past = past.withColumns({f"past_{n}_avg_last3f": F.round(f"past_{n}_avg_last3f", 6) for n in (3, 5)})
    past = totals_before(past, ["horse_id"], day, {f"{c}_{k}": F.when(F.col(f"_{k}"), counts[c]).otherwise(0) for k in kinds for c in nw})
    past = past.withColumns({f"{k}_win_rate": _rate(f"_w_{k}", f"_n_{k}") for k in kinds}).drop(*[f"{c}_{k}" for k in kinds for c in nw])
    for key, name in (("_band", "distance_category_win_rate"), ("venue_code", "venue_win_rate")):
        past = totals_before(past, ["horse_id", key], day, nw).withColumn(name, _rate("_w", "_n")).drop(*nw)
    past = past.drop("horse_id", day, "finish_position", "last_3f_time", "_band", "venue_code", *[f"_{k}" for k in kinds])

    ridden = base.where(keyed(["jockey_code", day])).select(*ROW, "jockey_code", "venue_code", number, "finish_position").repartition("jockey_code")
    ridden = totals_before(ridden, ["jockey_code", "venue_code"], day, nw).withColumn("jockey_venue_win_rate", _rate("_w", "_n")).drop(*nw)
    ridden = totals_before(ridden, ["jockey_code"], day, counts).withColumn("jockey_win_rate", _rate("_w", "_n")) \
        .select(*ROW, "jockey_venue_win_rate", "jockey_win_rate", F.col("_n").alias("jockey_n"), F.col("_p").alias("jockey_p"))

    overall = state_before(base, [], day, counts).select(day, _rate("_p", "_n").alias("_prior"))
    totals = stacked_totals(base, {"trainer": "trainer_code", "sire": "sire_id", "dam_sire": "dam_sire_id"}, day, counts,
                            {"trainer": ("_n", "_w", "_p"), "sire": ("_n", "_p"), "dam_sire": ("_n", "_p")})

    # Prices known the evening before and on the morning of the race.
    midnight = F.col(day).cast("timestamp")
    prices = odds_as_of(
        base.select("race_id", "horse_id", day), odds.where(F.col("odds_type") == odds_type),
        ["race_id", "horse_id"], {
            "odds_yesterday": midnight - F.expr("INTERVAL '1' SECOND"),
            "odds_today": midnight + F.make_dt_interval(hours=F.lit(morning_hour))}).drop(day)

    out = attach_state(base.repartition(*race), overall, [], day)
    out = rank_in_race(out.join(past, [*ROW], "left"), race, "past_5_avg_last3f", "last3f_rank", False)
    for features in (ridden, totals):
        out = out.join(features, [*ROW], "left")
    out = out.join(prices, ["race_id", "horse_id"], "left")
    prior = F.col("_prior")
    out = out.withColumns({
        "trainer_win_rate": _rate("trainer_w", "trainer_n"),
        **{f"{who}_te_place": smoothed(F.col(f"{who}_p"), F.col(f"{who}_n"), prior, m) for who in ("jockey", "trainer", "sire", "dam_sire")},
    })

    out = label(out).withColumns({
        "weight": F.col("weight_carried").cast("bigint"), "jockey_id": F.col("jockey_code"),
        "trainer_id": F.col("trainer_code"), "created_at": F.lit(created_at).cast("timestamp")})
    return assert_no_leak(out.select(*[F.col(f.name).cast(f.dataType) for f in table_schema("training_data")]), OUTCOMES)
