from pyspark.sql import functions as F

from furlong.operators import aggregates as ag

#: The published names, in the order of the record.
NAMES = ["jra", "exchange", "other", "surface", "surface_dist", "track_dist", "rotation", "direction", "jockey", "good", "slightly_heavy", "heavy",
         "slow_pace", "medium_pace", "high_pace", "season", "bracket", "jockey_dist", "jockey_track_dist", "jockey_trainer", "jockey_owner",
         "jockey_blinker", "trainer_owner"]
COLUMNS = ("horse_id string, jockey_code string, trainer_code string, owner_code string, blinker string, course_type string, distance int, "
           "venue_code string, layoff string, direction string, season string, bracket_number int, going string, pace string, organiser string, position int")
RUN = ("h1", "j1", "t1", "o1", "b", "turf", 1600, "05", "4-8w", "left", "winter", 3, "良", "S", "jra")


def test_names_are_the_published_ones():
    from furlong.sources.layouts import LAYOUTS

    fields = [f.name for f in LAYOUTS["KKA"].fields if f.name.endswith("_win")]
    assert [f.removesuffix("_win") for f in fields] == NAMES


def test_groups_of_several_entities(spark):
    assert list(ag.condition_groups()) == NAMES
    runs = [(*RUN, 1), (*RUN, 2), (*RUN[:12], "重", "H", "other", 5), ("h2", *RUN[1:], 1), ("h3", None, None, None, None, *RUN[5:], 3)]
    records = ag.named_records(spark.createDataFrame(runs, COLUMNS), ag.condition_groups(), "position")
    got = {(r.condition, r.entity, r.condition_value): (r.win, r.place, r.show, r.out) for r in records.collect()}
    assert got["jra", "h1", "all"] == (1, 1, 0, 0) and got["other", "h1", "all"] == (0, 0, 0, 1)
    assert got["surface_dist", "h1", "turf/1600"] == (1, 1, 0, 1) and got["track_dist", "h2", "05/turf/1600"] == (1, 0, 0, 0)
    assert got["heavy", "h1", "all"] == (0, 0, 0, 1) and ("slightly_heavy", "h1", "all") not in got
    assert got["jockey_dist", "j1", "1600"] == (2, 1, 0, 1) and got["trainer_owner", "t1", "o1"] == (2, 1, 0, 1)
    assert got["surface", "h3", "turf"] == (0, 0, 1, 0)
    assert not [k for k in got if k[1] is None or k[2] is None]


def test_record_of_an_entry_is_one_join(spark):
    df = spark.createDataFrame([(*RUN, 1), (*RUN, 4), ("h9", "j1", *RUN[2:], None)], COLUMNS).withColumn("id", F.monotonically_increasing_id())
    groups = ag.condition_groups()
    wide = ag.entry_records(df, ag.named_records(df, groups, "position"), ["id"], groups)
    assert len(wide.columns) == 1 + 4 * len(NAMES)
    rows = {r["id"]: r for r in wide.collect()}
    new = rows[max(rows)]
    assert (new.surface_win, new.jockey_dist_win, new.jockey_dist_out, new.jra_out) == (0, 1, 1, 0)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_a_hot_entity_is_combined_before_the_shuffle(spark):
    runs = spark.range(1000).select(*[F.lit(v).alias(c.split(" ")[0]) for c, v in zip(COLUMNS.split(", "), RUN)], (F.col("id") % 5).cast("int").alias("position"))
    plan = ag.named_records(runs, ag.condition_groups(), "position")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "partial_count" in plan


def test_no_finish_has_no_variance(spark):
    df = spark.createDataFrame([("h", 0, 1.0), ("h", 1, 2.0), ("h", 3, 3.0)], "horse string, position int, figure double")
    row = ag.profile(df, ["horse"], "position", "figure").first()
    assert row.position_variance == 2.0 and row.best_figure == 3.0


def test_records_dealt_out_by_entity_are_the_same(spark):
    runs = [(*RUN, 1), (*RUN, 2), (*RUN[:12], "重", "H", "other", 5), ("h2", *RUN[1:], 1), ("h3", None, None, None, None, *RUN[5:], 3),
            (None, *RUN[1:], 2), ("h4", "j2", "t1", None, *RUN[4:], None), (None, None, None, "o1", *RUN[4:], 1), ("t1", "h1", "j1", *RUN[3:], 3)]
    df = spark.createDataFrame(runs, COLUMNS).withColumn("id", F.monotonically_increasing_id())
    groups = ag.condition_groups()
    plain, dealt = (ag.named_records(df, groups, "position", by_entity=b) for b in (False, True))
    assert sorted(map(tuple, dealt.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    for ids in (["id"], ["horse_id", "distance"]):
        wide = [ag.entry_records(df, r, ids, groups) for r in (plain, dealt)]
        assert wide[0].columns == wide[1].columns
        assert sorted(map(tuple, wide[0].collect()), key=repr) == sorted(map(tuple, wide[1].collect()), key=repr)


def test_entries_are_expanded_after_the_shuffle_by_entity(spark):
    from furlong.plans.catalog import QUERIES

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["entry_conditions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = [x.split("(")[1] for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum(x.startswith("entity") for x in keys) == 2 and not [x for x in keys if x.startswith(("kind", "condition"))]


def test_records_beside_their_rows_are_the_same(spark):
    runs = [(*RUN, 1), (*RUN, 2), (*RUN[:12], "重", "H", "other", 5), ("h2", *RUN[1:], 1), ("h3", None, None, None, None, *RUN[5:], 3),
            (None, *RUN[1:], 2), ("h4", "j2", "t1", None, *RUN[4:], None), (None, None, None, "o1", *RUN[4:], 1), ("t1", "h1", "j1", *RUN[3:], 3),
            ("h1/t", None, "t1", "o1", *RUN[4:], 2), (*RUN[:12], None, None, None, 4), ("h1", "j1", "t1", "o1", None, "tu/rf", 1600, None, *RUN[8:], 1)]
    df = spark.createDataFrame(runs, COLUMNS).withColumn("id", F.monotonically_increasing_id()).withColumn("no", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    groups = ag.condition_groups()
    plain = ag.named_records(df, groups, "position")
    for ids in (["id"], ["horse_id", "no"], ["no", "horse_id"], ["jockey_code", "id"], ["no"]):
        wide = [ag.entry_records(df, r, ids, groups) for r in (plain, ag.named_records(df, groups, "position", beside=ids))]
        assert wide[0].schema.simpleString() == wide[1].schema.simpleString()
        assert sorted(map(tuple, wide[0].collect()), key=repr) == sorted(map(tuple, wide[1].collect()), key=repr)


def exchanged(spark, name):
    from furlong.plans.catalog import QUERIES

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return [x.split("hashpartitioning(")[1].split("#")[0] for x in plan if "Exchange hashpartitioning" in x], plan


def test_records_of_entries_are_counted_beside_them(spark):
    keys, plan = exchanged(spark, "entry_conditions")
    assert set(keys) <= {"entity", "_place", "l_orderkey", "o_orderkey"} and not [x for x in plan if "inline" in x]


def test_groups_are_expanded_after_one_shuffle_by_entity(spark):
    keys, _ = exchanged(spark, "condition_groups")
    assert keys.count("entity") == 1 and "kind" not in keys
