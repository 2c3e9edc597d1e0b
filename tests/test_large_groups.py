"""One form per operator, for any group size: against plain windows, with missing keys, and without jobs while a plan is built."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.operators import evaluate as ev, features as ft, groups, history as hi, in_race as ir, odds as od
from furlong.operators.groups import with_place
from furlong.plans import catalog

WHO, DAY, TIE = ["who"], "day", ["id"]


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of 4 entities and of none; entity 0 owns half of them, several on one day, with ties and gaps."""
    rows = []
    for i in range(240):
        who = 0 if i % 2 == 0 else i % 7 % 4
        day = date(2024, 1, 1) + timedelta(days=(i * 7) % 60 if who else (i // 5) * 2 % 50)
        value = None if i % 11 == 0 else float((i * 37) % 23)
        rows.append((None if i % 13 == 0 else who, day, i, value, None if i % 17 == 0 else "ABC"[i % 3]))
    return spark.createDataFrame(rows, "who int, day date, id int, value double, kind string").cache()


def same(left, right):
    cols = sorted(left.columns)
    assert cols == sorted(right.columns)

    def rows(df):
        return sorted(tuple(repr(round(v, 9) + 0.0 if isinstance(v, float) else v) for v in r) for r in df.select(cols).collect())

    assert rows(left) == rows(right)
    assert left.count() > 0


def plain_history(df, features):
    """The value at the first run of the day, in one window per entity; none without an entity."""
    order = W.partitionBy(*WHO).orderBy(DAY, *TIE)
    one_day = W.partitionBy(*WHO, DAY).orderBy(*TIE)
    out = df.withColumn(hi.RUN_NO, F.row_number().over(order)).withColumns({f"_h_{n}": f(order) for n, f in features.items()})
    return out.withColumns({n: F.when(F.col("who").isNotNull(), F.first(f"_h_{n}").over(one_day)) for n in features}) \
        .drop(hi.RUN_NO, *[f"_h_{n}" for n in features])


@pytest.mark.parametrize("how", ["avg", "max", "min", "sd", "count", "sum"])
def test_past_n(runs, how):
    function = {"avg": F.avg, "max": F.max, "min": F.min, "sd": F.stddev_samp, "count": F.count, "sum": F.sum}[how]
    expected = plain_history(runs, {f"past_{n}_{how}_value": (lambda o, n=n: function("value").over(hi.last_n(o, n))) for n in (3, 5, 10)})
    same(hi.past_n(runs, WHO, DAY, TIE, "value", how=(how,)), expected)


def test_previous_and_trend(runs):
    same(hi.previous(runs, WHO, DAY, TIE, ["value", "kind"], 2),
         plain_history(runs, {f"prev2_{c}": (lambda o, c=c: F.lag(c, 2).over(o)) for c in ("value", "kind")}))


def test_rows_without_an_entity_have_no_history(runs):
    for out in (hi.past_n(runs, WHO, DAY, TIE, "value"), hi.previous(runs, WHO, DAY, TIE, ["value"]), hi.form_trend(runs, WHO, DAY, TIE, "value"),
                hi.against_own_mean(runs, WHO, DAY, TIE, "value"), ft.running_style(runs, WHO, DAY, TIE, "value", "value"),
                ft.ability_history(runs, WHO, DAY, TIE, "value"), hi.with_state(runs, WHO, DAY, {"total": F.col("value")})):
        new = [c for c in out.columns if c not in runs.columns]
        assert out.count() == runs.count() and new
        assert out.where("who IS NULL").where(" OR ".join(f"{c} IS NOT NULL" for c in new)).count() == 0


def test_rows_without_a_race_are_not_compared(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), ("a", 3.0, 3), ("a", None, 4), ("a", 1.0, 5)], "race string, x double, id int")
    for out, name in ((ir.rank_in_race(df, ["race"], "x", "r"), "r"), (ir.minus_race_mean(df, ["race"], "x", "m"), "m"),
                      (ir.race_totals(df, ["race"], {"n": F.count("x")}), "n"), (ir.upset(df, ["race"], "x", "id"), "upset"),
                      (ir.buckets(df, ["race"], "x", ["id"], 2), "bucket"), (ir.buckets(df, ["race"], "x", ["id"], 2), "percent_rank")):
        found = {r["id"]: r[name] for r in out.collect()}
        assert found[1] is None and found[2] is None and found[3] is not None and len(found) == 5


@pytest.mark.parametrize("n, descending", [(7, True), (100, False), (2, True)])
def test_buckets_are_those_of_ntile(runs, n, descending):
    keyed = runs.where("kind IS NOT NULL")
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    expected = keyed.withColumn("bucket", F.ntile(n).over(W.partitionBy("kind").orderBy(order, "id"))) \
        .withColumn("percent_rank", F.percent_rank().over(W.partitionBy("kind").orderBy(order)))
    same(ir.buckets(keyed, ["kind"], "value", TIE, n, descending=descending), expected)


def test_calibration_is_that_of_ntile(runs):
    expected = runs.withColumn("decile", F.ntile(9).over(W.orderBy(F.col("value").asc_nulls_last(), "id"))) \
        .groupBy("decile").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_score"),
                               F.avg((F.col("kind") == "A").cast("int")).alias("hit_rate"))
    same(ev.calibration(runs, "value", F.col("kind") == "A", TIE, 9), expected)


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def range_sizes(monkeypatch):
    """Rows of each range of the last table that was written."""
    kept = []
    plain = groups.stored
    monkeypatch.setattr(groups, "stored", lambda df, kind: kept.append(plain(df, kind)) or kept[-1])
    return lambda: [r["count"] for r in kept[-1].groupBy("_range").count().collect()]


def largest_share(df, by):
    """Share of all rows that the fullest partition of ``df`` holds."""
    sizes = [r["count"] for r in df.groupBy(by).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("score", ["if(id = 5, 1e9, id / 4000)", "if(id % 3 = 0, 0.5, id / 4000)", "if(id % 2 = 0, null, id / 4000)"],
                         ids=["one far off", "a third share one", "half missing"])
def test_places_are_found_in_even_ranges(spark, monkeypatch, uncoalesced, score):
    written = range_sizes(monkeypatch)
    rows = spark.range(4000).withColumn("score", F.expr(score))
    order = [F.col("score").asc_nulls_last(), F.col("id").asc()]
    placed = with_place(rows, order, "place", "size")
    expected = {r["id"]: k for k, r in enumerate(rows.orderBy(*order).collect())}
    assert {r["id"]: r["place"] for r in placed.collect()} == expected
    assert {r["size"] for r in placed.select("size").distinct().collect()} == {4000}
    assert len(written()) >= 4 and max(written()) < 1500


def test_equal_rows_are_dealt_over_ranges(spark, monkeypatch, uncoalesced):
    written = range_sizes(monkeypatch)
    rows = spark.range(4000).select(F.lit(1.0).alias("score"))
    placed = with_place(rows, [F.col("score").asc()], "place", "size")
    assert sorted(r["place"] for r in placed.collect()) == list(range(4000))
    assert len(written()) >= 4


def test_rows_without_a_race_are_dealt_over_tasks(spark, uncoalesced):
    """Half of all rows have no race: none of them meet in a window's task."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, (F.col("id") / 20).cast("int")).alias("race"), F.col("id").alias("x"))
    for out in (ir.rank_in_race(rows, ["race"], "x", "r"), ir.minus_race_mean(rows, ["race"], "x", "r"), ir.upset(rows, ["race"], "x", "x"),
                ir.race_totals(rows, ["race"], {"n": F.count("x")})):
        assert largest_share(out.withColumn("part", F.spark_partition_id()), "part") < 0.25
        assert out.columns[:2] == rows.columns and out.count() == 4000
    out = ir.buckets(rows, ["race"], "x", ["x"])
    assert largest_share(out.withColumn("part", F.spark_partition_id()), "part") < 0.25


def test_odds_movement(spark):
    ticks = spark.range(300).select(
        F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("odds_value"),
        F.when(F.col("id") % 29 > 0, F.timestamp_seconds(F.col("id") * 1117)).alias("odds_timestamp"))
    order = W.partitionBy("k").orderBy("odds_timestamp")
    known = ticks.where("k IS NOT NULL AND odds_timestamp IS NOT NULL")
    expected = known.withColumn("change", F.col("odds_value") - F.lag("odds_value").over(order)) \
        .withColumn("change_from_open", F.col("odds_value") - F.first("odds_value").over(order))
    none = F.lit(None).cast("double")
    rest = ticks.where("k IS NULL OR odds_timestamp IS NULL").withColumns({"change": none, "change_from_open": none})
    same(od.odds_movement(ticks, ["k"]), expected.unionByName(rest))


def test_par_keeps_the_digits_of_large_values(spark):
    base = spark.range(400).select((F.col("id") % 2).alias("g"), F.expr("date_add(DATE '2024-01-01', cast(id div 40 as int))").alias("day"),
                                   F.col("id"), (F.col("id") % 7).cast("double").alias("x"))
    small = {r["id"]: r["z"] for r in hi.standardised(base, ["g"], "day", {"z": F.col("x")}).collect()}
    large = {r["id"]: r["z"] for r in hi.standardised(base, ["g"], "day", {"z": F.col("x") + 1e9}).collect()}
    assert all(small[i] == pytest.approx(large[i], abs=1e-5) if small[i] is not None else large[i] is None for i in small)


def test_a_key_less_total_needs_a_date(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0)], "at timestamp, x double")
    with pytest.raises(TypeError):
        hi.state_before(df, [], "at", {"s": F.col("x")})


@pytest.mark.parametrize("name", ["past_n_avg", "ability_history", "rank_in_race", "upset", "score_buckets", "calibration", "odds_movement",
                                  "te_named", "running_style", "std_time"])
def test_building_a_plan_runs_no_job(spark, name):
    """Beyond reading the schemas of the tables, which takes one small job each."""
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        jobs = tracker.getJobIdsForGroup(group)
        assert all(tracker.getStageInfo(s).numTasks == 1 for j in jobs for s in tracker.getJobInfo(j).stageIds) and len(jobs) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
