"""Queries: joins, records, rates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions import fields as fx
from furlong.operators import aggregates as ag, history as hi, in_race as ir, joins as jn, odds as od
from furlong.plans import standin
from furlong.plans.registry import load, query
from furlong.session import CO_PARTITION
from furlong.sources.layouts import COUNTERS

ENTRIES_SQL = """
e AS (SELECT l_orderkey, l_partkey, min(l_suppkey) AS suppkey, max(l_quantity) AS quantity,
  max(l_extendedprice) AS price, max(l_discount) AS discount, any_value(o_custkey) AS o_custkey,
  any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderpriority) AS o_orderpriority,
  any_value(o_orderdate)::DATE AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY price DESC) AS position FROM e)"""


@query("race_card", """
WITH m AS (SELECT DISTINCT lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') || strftime(o_orderdate, '%y')
    || (o_orderkey % 9 + 1) || (o_orderkey % 10) AS meeting,
    (c_nationkey % 10 + 1) * 10 + o_orderkey % 10 AS going FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT o_orderkey, lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') || strftime(o_orderdate, '%y')
    || (o_orderkey % 9 + 1) || (o_orderkey % 10) AS meeting, o_orderstatus
    FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT l_orderkey, l_linenumber, l_partkey, r.meeting, r.o_orderstatus AS status, m.going,
  p.p_brand AS sire_name, round(s.s_acctbal, 2) AS odds_value, k.jra_win, k.jra_out
FROM lineitem JOIN r ON l_orderkey = r.o_orderkey LEFT JOIN m ON r.meeting = m.meeting
LEFT JOIN (SELECT l_orderkey AS ko, l_suppkey AS ks, count(*) FILTER (l_linenumber = 1) AS jra_win, count(*) FILTER (l_linenumber > 3) AS jra_out
  FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1, 2) k ON ko = l_orderkey AND ks = l_suppkey
LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey""")
def race_card(spark, sf):
    # race_id carries the meeting key in its first six characters, then the order number.
    k = F.col("o_orderkey")
    races = standin.orders_with_nation(spark, sf).select(
        F.concat(F.substring(standin.race_key(F.col("c_nationkey"), F.col("day"), k), 1, 6),
                 k.cast("string")).alias("race_id"), k.alias("order"), F.col("o_orderstatus").alias("status"),
        (F.col("c_nationkey") % 10 + 1).alias("venue"))
    meetings = races.select(fx.meeting_key(F.col("race_id")).alias("venue_id"),
                            (F.col("venue") * 10 + F.col("order") % 10).alias("going")).distinct()
    entries = load(spark, sf, "lineitem").join(races.select("race_id", "order"), F.col("l_orderkey") == F.col("order")) \
        .select("race_id", F.col("l_suppkey").alias("horse_number"), F.col("l_partkey").alias("horse_id"),
                "l_orderkey", "l_linenumber")
    horses = load(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), F.col("p_brand").alias("sire_name"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("horse_number"),
                                                   F.round("s_acctbal", 2).alias("odds_value"))
    odds = entries.select("race_id", "horse_number").distinct().join(suppliers, "horse_number")
    # condition records of four in five entries
    line = F.col("l_linenumber")
    extended = entries.where(F.col("horse_number") % 5 > 0).groupBy("race_id", "horse_number").agg(
        F.count_if(line == 1).alias("jra_win"), F.count_if(line > 3).alias("jra_out"))
    card = jn.race_card(entries, races.drop("order", "venue"), meetings, extended, horses, odds)
    return card.select("l_orderkey", "l_linenumber", F.col("horse_id").alias("l_partkey"),
                       fx.meeting_key(F.col("race_id")).alias("meeting"), "status", "going", "sire_name", "odds_value", "jra_win", "jra_out")


RUN_DAYS_SQL = """
d AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS runs, max(o_totalprice) AS best,
        max_by(o_orderstatus, o_orderkey) AS condition FROM orders GROUP BY 1, 2)"""


@query("past_runs", f"""
WITH {RUN_DAYS_SQL}, k AS (SELECT o_custkey, day, unnest(range(1, 6)) AS run_no, n FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS n FROM d)),
x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS n FROM d)
SELECT k.o_custkey, k.day, k.run_no::INTEGER AS run_no, x.day AS run_date, x.best
FROM k JOIN x ON x.o_custkey = k.o_custkey AND x.n = k.n - k.run_no""")
def past_runs(spark, sf):
    days = standin.runs(spark, sf).groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("best"))
    keyed = days.withColumn("horse_id", standin.digits("o_custkey", 8)).withColumn("race_date", F.col("day"))
    keyed = keyed.withColumn("key", fx.run_key(F.col("horse_id"), F.col("day")))
    linked = hi.with_history(keyed, ["o_custkey"], "day", ["key"], ["key"], {
        f"prev_race_key_{i}": (lambda o, i=i: F.lag("key", i).over(o)) for i in range(1, 6)}, 5)
    return jn.past_runs(linked, keyed, ["o_custkey", "day"], ["best"]) \
        .select("o_custkey", "day", "run_no", "run_date", "best")


@query("person_record", f"""
WITH {ENTRIES_SQL}, c AS (SELECT suppkey, count(*) FILTER (position = 1) AS win, count(*) FILTER (position = 2) AS place,
  count(*) FILTER (position = 3) AS "show", count(*) FILTER (position > 3) AS out, count(*) AS starts FROM p GROUP BY 1)
SELECT *, round(win::DOUBLE / starts, 6) AS win_rate, round((win + place)::DOUBLE / starts, 6) AS quinella_rate,
  round((win + place + "show")::DOUBLE / starts, 6) AS place_rate FROM c""")
def person_record(spark, sf):
    placed = standin.placed_entries(spark, sf)
    entries = placed.select("l_orderkey", "l_partkey", "suppkey")
    record = jn.person_record(entries, placed, "suppkey", ["l_orderkey", "l_partkey"], "position")
    return rounded(record, "win_rate", "quinella_rate", "place_rate")


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("odds_as_of", """
WITH u AS (SELECT user_id, event_type, date_trunc('day', min(ts)) + INTERVAL 10 DAY AS c1,
  date_trunc('day', min(ts)) + INTERVAL 20 DAY AS c2 FROM events GROUP BY 1, 2)
SELECT u.user_id, u.event_type, max_by(value, ts) FILTER (ts <= c1) AS odds_yesterday,
  max_by(value, ts) FILTER (ts <= c2) AS odds_today
FROM u LEFT JOIN events e ON u.user_id = e.user_id AND u.event_type = e.event_type GROUP BY 1, 2""")
def odds_as_of(spark, sf):
    events = load(spark, sf, "events")
    first = events.groupBy("user_id", "event_type").agg(F.date_trunc("day", F.min("ts")).alias("start"))
    cutoffs = {"odds_yesterday": F.col("start") + F.expr("INTERVAL '10' DAY"),
               "odds_today": F.col("start") + F.expr("INTERVAL '20' DAY")}
    return jn.odds_as_of(first, events, ["user_id", "event_type"], cutoffs, "value", "ts").drop("start")


@query("odds_movement", """
SELECT event_id, user_id, event_type, round(value - lag(value) OVER w, 6) AS change,
  round(value - first_value(value) OVER w, 6) AS change_from_open
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)""")
def odds_movement(spark, sf):
    moved = od.odds_movement(load(spark, sf, "events"), ["user_id", "event_type"], "value", "ts")
    return rounded(moved, "change", "change_from_open").drop("ts", "value", "props")


@query("with_pedigree", """
SELECT l_orderkey, l_partkey AS horse_id, l_linenumber, p_brand AS sire, p_type AS dam_sire
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def with_pedigree(spark, sf):
    pedigree = load(spark, sf, "part").select(
        F.col("p_partkey").alias("horse_id"), F.col("p_brand").alias("sire"), F.col("p_type").alias("dam_sire"))
    entries = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("horse_id"), "l_linenumber")
    return jn.with_pedigree(entries, pedigree, ["sire", "dam_sire"])


@query("known_and_orphans", """
SELECT 'known' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'orphan', c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def known_and_orphans(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey")
    done = load(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return jn.known(customers, done, ["c_custkey"]).select(F.lit("known").alias("kind"), "c_custkey").unionByName(
        jn.orphans(customers, done, ["c_custkey"]).select(F.lit("orphan").alias("kind"), "c_custkey"))


# -- aggregations ---------------------------------------------------------------

CONDITIONS_SQL = f"""
WITH {ENTRIES_SQL},
l AS (SELECT suppkey, 'status' AS condition, o_orderstatus AS condition_value, position FROM p
  UNION ALL SELECT suppkey, 'priority', o_orderpriority, position FROM p
  UNION ALL SELECT suppkey, 'year', year(day)::VARCHAR, position FROM p),
r AS (SELECT suppkey, condition, condition_value, count(*) FILTER (position = 1) AS win,
  count(*) FILTER (position = 2) AS place, count(*) FILTER (position = 3) AS "show",
  count(*) FILTER (position > 3) AS out FROM l GROUP BY 1, 2, 3)"""


def _conditions(spark, sf):
    return ag.condition_record(
        standin.placed_entries(spark, sf), ["suppkey"],
        {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("day")}, "position")


@query("condition_record", f"{CONDITIONS_SQL} SELECT * FROM r")
def condition_record(spark, sf):
    return _conditions(spark, sf)


# Name, entity, value and rows of each group, spelled out for SQL.
GROUPS_SQL = (
    ("jra", "horse", "'all'", "organiser = 'jra'"), ("exchange", "horse", "'all'", "organiser = 'exchange'"),
    ("other", "horse", "'all'", "organiser = 'other'"), ("surface", "horse", "surface", "true"),
    ("surface_dist", "horse", "surface || '/' || dist", "true"), ("track_dist", "horse", "venue || '/' || surface || '/' || dist", "true"),
    ("rotation", "horse", "layoff", "true"), ("direction", "horse", "direction", "true"), ("jockey", "horse", "jockey", "true"),
    ("good", "horse", "'all'", "going = '良'"), ("slightly_heavy", "horse", "'all'", "going = '稍重'"),
    ("heavy", "horse", "'all'", "going IN ('重', '不良')"), ("slow_pace", "horse", "'all'", "pace = 'S'"),
    ("medium_pace", "horse", "'all'", "pace = 'M'"), ("high_pace", "horse", "'all'", "pace = 'H'"),
    ("season", "horse", "season", "true"), ("bracket", "horse", "bracket", "true"), ("jockey_dist", "jockey", "dist", "true"),
    ("jockey_track_dist", "jockey", "venue || '/' || dist", "true"), ("jockey_trainer", "jockey", "trainer", "true"),
    ("jockey_owner", "jockey", "owner", "true"), ("jockey_blinker", "jockey", "blinker", "blinker IS NOT NULL"),
    ("trainer_owner", "trainer", "owner", "true"),
)

NAMED_SQL = f"""
WITH {ENTRIES_SQL},
c AS (SELECT l_orderkey, position, l_partkey::VARCHAR AS horse, suppkey::VARCHAR AS jockey, (suppkey % 20)::VARCHAR AS trainer, o_custkey::VARCHAR AS owner,
  CASE WHEN l_partkey % 7 > 0 THEN (l_partkey % 3)::VARCHAR END AS blinker, ['turf', 'dirt'][l_orderkey % 2 + 1] AS surface,
  (1000 + l_orderkey % 20 * 100)::VARCHAR AS dist, (l_orderkey % 10 + 1)::VARCHAR AS venue, ['1w', '2-3w', '4-8w'][(l_orderkey + l_partkey) % 3 + 1] AS layoff,
  ['right', 'left', 'straight'][l_orderkey % 3 + 1] AS direction, month(day)::VARCHAR AS season, (l_partkey % 8 + 1)::VARCHAR AS bracket,
  ['良', '稍重', '重', '不良', '他'][l_orderkey % 5 + 1] AS going, ['S', 'M', 'H', '-'][l_orderkey % 4 + 1] AS pace,
  ['jra', 'jra', 'exchange', 'other'][l_partkey % 4 + 1] AS organiser FROM p),
t AS ({" UNION ALL ".join(f"SELECT '{n}' AS condition, {e} AS entity, {v} AS condition_value, position FROM c WHERE {w}" for n, e, v, w in GROUPS_SQL)}),
g AS (SELECT condition, entity, condition_value, count(*) FILTER (position = 1) AS win, count(*) FILTER (position = 2) AS place,
  count(*) FILTER (position = 3) AS "show", count(*) FILTER (position > 3) AS out FROM t GROUP BY 1, 2, 3)"""


@query("condition_groups", f"{NAMED_SQL} SELECT * FROM g")
def condition_groups(spark, sf):
    records = ag.named_records(standin.condition_entries(spark, sf), ag.condition_groups(), "position", by_entity=True)
    return records.select("condition", "entity", "condition_value", *COUNTERS)


@query("entry_conditions", f"""{NAMED_SQL},
w AS ({" UNION ALL ".join(f"SELECT l_orderkey, horse, '{n}' AS condition, {e} AS entity, {v} AS condition_value FROM c" for n, e, v, _ in GROUPS_SQL)})
SELECT l_orderkey, horse::BIGINT AS horse_id, {", ".join(f"coalesce(sum(g.{x}) FILTER (condition = '{n}'), 0)::BIGINT AS {n}_{x}" for n, *_ in GROUPS_SQL for x in ("win", "place", '"show"', "out")).replace('_"show"', "_show")}
FROM w LEFT JOIN g USING (condition, entity, condition_value) GROUP BY 1, 2""",
       **{CO_PARTITION: "false"})
def entry_conditions(spark, sf):
    entries = standin.condition_entries(spark, sf)
    groups, ids = ag.condition_groups(), ["l_orderkey", "horse_id"]
    return ag.entry_records(entries, ag.named_records(entries, groups, "position", beside=ids), ids, groups)


@query("rates", f"""{CONDITIONS_SQL}
SELECT *, win + place + "show" + out AS starts, round(win::DOUBLE / (win + place + "show" + out), 6) AS win_rate,
  round((win + place)::DOUBLE / (win + place + "show" + out), 6) AS quinella_rate,
  round((win + place + "show")::DOUBLE / (win + place + "show" + out), 6) AS place_rate FROM r""")
def rates(spark, sf):
    return rounded(ag.rates(_conditions(spark, sf)), "win_rate", "quinella_rate", "place_rate")


WIDE_SQL = ", ".join(
    f"coalesce(sum(\"{c}\") FILTER (condition = '{g}'), 0)::BIGINT AS {g}_{c}"
    for g in ("status", "priority", "year") for c in ("win", "place", "show", "out"))


@query("condition_wide", f"{CONDITIONS_SQL} SELECT suppkey, {WIDE_SQL} FROM r GROUP BY 1")
def condition_wide(spark, sf):
    return ag.widen_records(_conditions(spark, sf), ["suppkey"], ["status", "priority", "year"])


@query("counters_unpivot", f"""{CONDITIONS_SQL}
SELECT suppkey, condition AS counter_group, sum(win)::BIGINT AS win, sum(place)::BIGINT AS place,
  sum("show")::BIGINT AS "show", sum(out)::BIGINT AS out FROM r GROUP BY 1, 2""")
def counters_unpivot(spark, sf):
    wide = ag.widen_records(_conditions(spark, sf), ["suppkey"], ["status", "priority", "year"])
    return ag.unpivot_counters(wide, ["suppkey"], ["status", "priority", "year"])


@query("sire_record", f"""
WITH {ENTRIES_SQL}
SELECT p_brand AS sire, round(avg((position <= 3)::INT) FILTER (o_orderstatus = 'O'), 6) AS turf_place_rate,
  round(avg((position <= 3)::INT) FILTER (o_orderstatus = 'F'), 6) AS dirt_place_rate,
  round(avg(1000 + l_orderkey % 20 * 100) FILTER (position <= 3), 6) AS avg_place_distance
FROM p JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def sire_record(spark, sf):
    status = F.col("o_orderstatus")
    results = standin.placed_entries(spark, sf).select(
        F.col("l_partkey").alias("horse_id"), "position", (1000 + F.col("l_orderkey") % 20 * 100).alias("distance"),
        F.when(status == "O", "turf").when(status == "F", "dirt").alias("surface"))
    pedigree = load(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), F.col("p_brand").alias("sire"))
    record = ag.sire_record(results, pedigree, "sire", "surface", "position", "distance")
    return rounded(record, "turf_place_rate", "dirt_place_rate", "avg_place_distance")


@query("par_times", """
SELECT p_brand, p_size, l_returnflag, count(*) AS runs, round(avg(l_extendedprice), 8) AS par_mean,
  round(stddev_samp(l_extendedprice), 4) AS par_sd
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def par_times(spark, sf):
    joined = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = ag.par_times(joined, ["p_brand", "p_size", "l_returnflag"], "l_extendedprice")
    return out.withColumn("par_mean", F.round("par_mean", 8)).withColumn("par_sd", F.round("par_sd", 4))


@query("weight_slopes", """
SELECT p_brand, l_returnflag, CASE WHEN count(*) > 1 AND min(l_quantity) < max(l_quantity)
  THEN round(regr_slope(l_extendedprice, l_quantity), 4) END AS weight_slope
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def weight_slopes(spark, sf):
    from furlong.operators.features import weight_slopes as slopes
    joined = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(slopes(joined, ["p_brand", "l_returnflag"], "l_extendedprice", "l_quantity"), "weight_slope", places=4)


@query("race_dispersion", """
SELECT l_orderkey, round(stddev_samp(l_quantity), 6) AS l_quantity_spread,
  round(stddev_samp(l_discount), 6) AS l_discount_spread FROM lineitem GROUP BY 1""")
def race_dispersion(spark, sf):
    out = ir.race_dispersion(load(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_discount"])
    return rounded(out, "l_quantity_spread", "l_discount_spread")


PACE_SQL = """
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS "style_A", count(*) FILTER (l_returnflag = 'N') AS "style_N",
  count(*) FILTER (l_returnflag = 'R') AS "style_R", count(*) FILTER (l_quantity >= 30) AS front_runner_count,
  round(avg(l_quantity) FILTER (l_quantity >= 30), 6) AS expected_pace_score FROM lineitem GROUP BY 1"""


def _pace(spark, sf):
    profile = ir.pace_profile(load(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag"), "l_quantity",
                              30.0, ["A", "N", "R"])
    return rounded(profile, "expected_pace_score")


@query("pace_profile", PACE_SQL)
def pace_profile(spark, sf):
    return _pace(spark, sf)


@query("style_match", f"""
WITH pace AS ({PACE_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN l_returnflag = 'A' AND front_runner_count < 3 THEN 'lone_front' WHEN l_returnflag = 'A' THEN 'contested_front'
  WHEN front_runner_count >= 3 THEN 'suited_closer' ELSE 'unsuited_closer' END AS style_match
FROM lineitem JOIN pace USING (l_orderkey)""")
def style_match(spark, sf):
    out = ir.style_match(load(spark, sf, "lineitem"), _pace(spark, sf), ["l_orderkey"], F.col("l_returnflag"), ["A"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "style_match")


@query("style_rates", """
SELECT l_suppkey, round(avg((l_linenumber = 1)::INT), 6) AS escape_rate,
  round(avg((l_linenumber <= 4)::INT), 6) AS lead_rate, round(avg((l_quantity <= 5)::INT), 6) AS within5_rate
FROM lineitem GROUP BY 1""")
def style_rates(spark, sf):
    out = ag.style_rates(load(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity")
    return rounded(out, "escape_rate", "lead_rate", "within5_rate")


RATE_SQL = """count(*) AS starts, round(avg((position = 1)::INT), 6) AS win_rate,
  round(avg((position <= 3)::INT), 6) AS place_rate"""


@query("group_rates", f"WITH {ENTRIES_SQL} SELECT suppkey, o_orderpriority, {RATE_SQL} FROM p GROUP BY 1, 2")
def group_rates(spark, sf):
    out = ag.group_rates(standin.placed_entries(spark, sf), ["suppkey", "o_orderpriority"], "position")
    return rounded(out, "win_rate", "place_rate")


@query("group_rate_levels", f"""
WITH {ENTRIES_SQL}
SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus) AS level, {RATE_SQL} FROM p
GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderpriority, o_orderstatus))""")
def group_rate_levels(spark, sf):
    out = ag.group_rates(standin.placed_entries(spark, sf), ["o_orderpriority", "o_orderstatus"], "position",
                         [[], ["o_orderpriority"], ["o_orderpriority", "o_orderstatus"]])
    return rounded(out, "win_rate", "place_rate")


@query("layoff_rates", f"""
WITH {RUN_DAYS_SQL}, g AS (SELECT *, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS rest FROM d)
SELECT o_custkey % 50 AS stable, CASE WHEN rest IS NULL THEN 'first' WHEN rest <= 13 THEN '1w' WHEN rest <= 27 THEN '2-3w'
  WHEN rest <= 62 THEN '4-8w' WHEN rest <= 180 THEN '9-25w' ELSE '26w+' END AS band, count(*) AS starts,
  round(avg((runs = 1)::INT), 6) AS win_rate, round(avg((runs <= 3)::INT), 6) AS place_rate FROM g GROUP BY 1, 2""")
def layoff_rates(spark, sf):
    days = hi.rest_features(hi.entity_days(standin.runs(spark, sf), ["o_custkey"], "day"), ["o_custkey"], "day")
    keyed = days.withColumn("stable", F.col("o_custkey") % 50).withColumn("band", ag.layoff_band(F.col("rest_days")))
    return rounded(ag.group_rates(keyed, ["stable", "band"], "runs"), "win_rate", "place_rate")


@query("entity_profile", f"""
WITH {ENTRIES_SQL} SELECT l_partkey, round(var_samp(position % 4) FILTER (position % 4 > 0), 6) AS position_variance,
  round(avg((position % 4 BETWEEN 1 AND 5)::INT), 6) AS board_rate, max(price) AS best_figure FROM p GROUP BY 1""")
def entity_profile(spark, sf):
    runs = standin.placed_entries(spark, sf).withColumn("position", F.col("position") % 4)  # every fourth did not finish
    out = ag.profile(runs, ["l_partkey"], "position", "price")
    return rounded(out, "position_variance", "board_rate")


@query("earnings", "SELECT o_custkey, count(*) AS starts, round(sum(o_totalprice), 2) AS prize_total FROM orders GROUP BY 1")
def earnings(spark, sf):
    return rounded(ag.earnings(standin.runs(spark, sf), ["o_custkey"], "o_totalprice"), "prize_total", places=2)


# -- arrays and flags --------------------------------------------------------------

@query("payout_rows", """
SELECT o_orderkey, 'win' AS bet_type, (o_custkey % 18 + 1)::VARCHAR AS combination, o_totalprice AS payout FROM orders
UNION ALL SELECT o_orderkey, 'place', ((o_custkey + 1) % 18 + 1)::VARCHAR, round(o_totalprice * 2, 2) FROM orders
  WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'place', ((o_custkey + 2) % 18 + 1)::VARCHAR, 100.0::DOUBLE FROM orders""")
def payout_rows(spark, sf):
    c, x = F.col("o_custkey"), F.col("o_totalprice")
    return od.payout_rows(load(spark, sf, "orders"), ["o_orderkey"], {
        "win": [(c % 18 + 1, x)],
        "place": [((c + 1) % 18 + 1, F.when(F.col("o_orderstatus") != "P", F.round(x * 2, 2))),
                  ((c + 2) % 18 + 1, F.lit(100.0))]})


@query("sale_flags", """
SELECT o_orderkey, (o_orderkey & 1) > 0 AS win, (o_orderkey & 2) > 0 AS place, (o_orderkey & 4) > 0 AS bracket,
  substr((o_orderkey % 1000)::VARCHAR, 1, 1) = '1' AS text_win FROM orders""")
def sale_flags(spark, sf):
    bits = od.sale_bits(F.col("o_orderkey"), ["win", "place", "bracket"])
    text = od.sale_flags((F.col("o_orderkey") % 1000).cast("string"), ["text_win"])
    return load(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in (bits | text).items()])
