"""Features of races that lack a venue or a distance."""

from datetime import date, datetime

from furlong.plans.training_data import training_data


def test_a_race_without_venue_or_distance_keeps_the_rates_of_its_runners(spark):
    races = [("r1", date(2024, 1, 1), "05", 1600), ("r2", date(2024, 1, 8), None, 1600), ("r3", date(2024, 1, 15), "05", None),
             ("r4", date(2024, 1, 22), None, None), ("r5", date(2024, 1, 29), "05", 1600)]
    tables = {
        "races": spark.createDataFrame(
            [(r, d, v, 1, "turf", m, "良", 2) for r, d, v, m in races],
            "race_id string, race_date date, venue_code string, race_number int, course_type string, distance int, track_condition string, num_horses int"),
        "entries": spark.createDataFrame(
            [(r[0], n, f"h{n}", n, j, "t1", 55.0, 50.0, 0.0) for r in races for n, j in ((1, "j1"), (2, None))],
            "race_id string, horse_number int, horse_id string, bracket_number int, jockey_code string, trainer_code string, "
            "weight_carried double, idm double, ten_index double"),
        "results": spark.createDataFrame(
            [(r[0], n, p, 0, 35.0) for i, r in enumerate(races) for n, p in ((1, 1 + i % 2), (2, 2 - i % 2))],
            "race_id string, horse_number int, finish_position int, abnormal_code int, last_3f_time double"),
        "pedigree": spark.createDataFrame([("h1", "s1", "d1"), ("h2", None, None)], "horse_id string, sire_id string, dam_sire_id string"),
        "odds": spark.createDataFrame([], "race_id string, horse_id string, odds_type string, odds_value double, odds_timestamp timestamp")}
    rows = training_data(**tables, created_at=datetime(2026, 1, 4), m=10.0).collect()
    assert len(rows) == 10
    got = {r["race_id"]: r for r in rows if r["horse_id"] == "h1"}
    # wins 1, 0, 1, 0, 1 in turn
    assert [got[f"r{i}"]["jockey_win_rate"] for i in range(1, 6)] == [None, 1.0, 0.5, 2 / 3, 0.5]
    assert [got[f"r{i}"]["turf_win_rate"] for i in range(1, 6)] == [None, 1.0, 0.5, 2 / 3, 0.5]
    assert [got[f"r{i}"]["venue_win_rate"] for i in range(1, 6)] == [None, None, 1.0, None, 1.0]
    assert [got[f"r{i}"]["jockey_venue_win_rate"] for i in range(1, 6)] == [None, None, 1.0, None, 1.0]
    assert [got[f"r{i}"]["distance_category_win_rate"] for i in range(1, 6)] == [None, 1.0, None, None, 0.5]
    assert all(r["jockey_win_rate"] is None and r["jockey_venue_win_rate"] is None for r in rows if r["horse_id"] == "h2")


def test_the_wide_columns_of_the_base_are_shuffled_once(spark):
    from furlong.plans.catalog import QUERIES

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["training_data"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    below = [next(x for x in plan[i + 1:] if "Project" in x or "Window" in x or "Aggregate" in x or "FileScan" in x)
             for i, x in enumerate(plan) if "Exchange hashpartitioning" in x]
    assert sum("bracket_number" in x for x in below) == 1


def test_runs_meet_their_horse_and_jockey_in_one_shuffle_each(spark):
    from furlong.plans.catalog import QUERIES

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["training_data"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = [x.split("hashpartitioning(")[1].split("#")[0] for x in plan if "Exchange hashpartitioning" in x]
    assert sum(k == "horse_id" for k in keys) == 1 and sum(k == "jockey_code" for k in keys) == 1
    assert "_row" not in keys and sum(k.startswith("_set") for k in keys) == 2


def test_values_beside_rows_are_those_of_the_joins(spark):
    from pyspark.sql import functions as F

    from furlong.operators import history as hi

    rows = [(i, *("ab"[i % 2] if i % 7 else None, "xyz"[i % 3] if i % 5 else None), i // 4 % 6 if i % 11 else None, i % 4, float(i % 9) if i % 8 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, who string, kind string, n int, tie int, value double") \
        .withColumn("day", F.date_add(F.lit(date(2024, 1, 1)), F.col("n"))).withColumn("tie", F.col("id"))
    sums, runs = {"total": F.col("value"), "runs": F.lit(1)}, hi.last_n
    features = {f"past_{n}": lambda o, n=n: F.avg("value").over(runs(o, n)) for n in (2, 4)} | {"trend": lambda o: F.regr_slope(F.col("value"), F.col(hi.RUN_NO)).over(runs(o, 3))}
    got, expected = ({r["id"]: r for r in hi.with_history(df, ["who"], "day", ["tie"], ["value"], features, 4, dealt=d).collect()} for d in (True, False))
    assert len(got) == 80 and all(got[i][c] == expected[i][c] or abs(got[i][c] - expected[i][c]) < 1e-9 for i in got for c in features)
    assert any(r["past_2"] is not None for r in got.values())
    for keys in (["who"], ["who", "kind"]):
        got = {r["id"]: (r["total"], r["runs"]) for r in hi.totals_before(df.withColumn("day", F.unix_date("day")), keys, "day", sums).collect()}
        expected = {r["id"]: (r["total"], r["runs"]) for r in hi.with_state(df.where("day IS NOT NULL"), keys, "day", sums).collect()}
        assert len(got) == 80 and all(x == expected.get(i, (None, None)) for i, x in got.items())
