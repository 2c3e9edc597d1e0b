"""Queries: history windows, in-race comparisons, target encodings, composite features."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import features as ft, history as hi, in_race as ir, target_encoding as te
from furlong.plans import standin
from furlong.plans.queries_joins import ENTRIES_SQL, RUN_DAYS_SQL, rounded
from furlong.plans.registry import load, query
from furlong.plans.training_data import training_data as assemble
from furlong.session import CO_PARTITION
from datetime import datetime

WHO, DAY, TIE = ["o_custkey"], "day", ["o_orderkey"]

# Each run with the number of the first run of its day: the runs numbered below
# that one are exactly the runs of earlier days.
RUNS_SQL = """
r AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice AS x, o_orderpriority, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT *, min(n) OVER (PARTITION BY o_custkey, day) AS first FROM r)"""


def past_sql(n: int, aggregate: str) -> str:
    return f"(SELECT {aggregate} FROM r b WHERE b.o_custkey = f.o_custkey AND b.n < f.first AND b.n >= f.first - {n})"


@query("past_n_avg", f"""
WITH {RUNS_SQL} SELECT o_custkey, o_orderkey, {", ".join(
    f"round({past_sql(n, 'avg(b.x)')}, 6) AS past_{n}_avg_o_totalprice" for n in (3, 5, 10))} FROM f""")
def past_n_avg(spark, sf):
    out = hi.past_n(standin.runs(spark, sf), WHO, DAY, TIE, "o_totalprice")
    names = [f"past_{n}_avg_o_totalprice" for n in (3, 5, 10)]
    return rounded(out, *names).select("o_custkey", "o_orderkey", *names)


@query("past_n_stats", f"""
WITH {RUNS_SQL} SELECT o_custkey, o_orderkey, {past_sql(5, 'max(b.x)')} AS past_5_max_o_totalprice,
  {past_sql(5, 'min(b.x)')} AS past_5_min_o_totalprice, round({past_sql(5, 'stddev_samp(b.x)')}, 5) AS past_5_sd_o_totalprice,
  {past_sql(5, 'count(b.x)')} AS past_5_count_o_totalprice FROM f""")
def past_n_stats(spark, sf):
    out = hi.past_n(standin.runs(spark, sf), WHO, DAY, TIE, "o_totalprice", [5], ["max", "min", "sd", "count"])
    return rounded(out, "past_5_sd_o_totalprice", places=5).select(
        "o_custkey", "o_orderkey", *[f"past_5_{h}_o_totalprice" for h in ("max", "min", "sd", "count")])


@query("prev_run", f"""
WITH {RUNS_SQL} SELECT f.o_custkey, f.o_orderkey, b.x AS prev1_o_totalprice, b.o_orderpriority AS prev1_o_orderpriority
FROM f LEFT JOIN r b ON b.o_custkey = f.o_custkey AND b.n = f.first - 1""")
def prev_run(spark, sf):
    out = hi.previous(standin.runs(spark, sf), WHO, DAY, TIE, ["o_totalprice", "o_orderpriority"])
    return out.select("o_custkey", "o_orderkey", "prev1_o_totalprice", "prev1_o_orderpriority")


@query("form_trend", f"""
WITH {RUNS_SQL} SELECT o_custkey, o_orderkey, round({past_sql(3,
    'CASE WHEN count(*) >= 2 THEN regr_slope(b.x, b.n) END')}, 5) AS trend_3_o_totalprice FROM f""")
def form_trend(spark, sf):
    out = hi.form_trend(standin.runs(spark, sf), WHO, DAY, TIE, "o_totalprice")
    return rounded(out, "trend_3_o_totalprice", places=5).select("o_custkey", "o_orderkey", "trend_3_o_totalprice")


@query("run_changes", f"""
WITH {RUNS_SQL} SELECT f.o_custkey, f.o_orderkey, round(f.x - b.x, 2) AS o_totalprice_change,
  f.o_orderpriority <> b.o_orderpriority AS o_orderpriority_switch, f.o_orderstatus <> b.o_orderstatus AS o_orderstatus_switch
FROM f LEFT JOIN r b ON b.o_custkey = f.o_custkey AND b.n = f.first - 1""")
def run_changes(spark, sf):
    out = hi.changes(standin.runs(spark, sf), WHO, DAY, TIE, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    return rounded(out, "o_totalprice_change", places=2).select(
        "o_custkey", "o_orderkey", "o_totalprice_change", "o_orderpriority_switch", "o_orderstatus_switch")


@query("against_own_mean", f"""
WITH {RUNS_SQL} SELECT o_custkey, o_orderkey, round(x - {past_sql(10, 'avg(b.x)')}, 6) AS o_totalprice_vs_own FROM f""")
def against_own_mean(spark, sf):
    out = hi.against_own_mean(standin.runs(spark, sf), WHO, DAY, TIE, "o_totalprice")
    return rounded(out, "o_totalprice_vs_own").select("o_custkey", "o_orderkey", "o_totalprice_vs_own")


@query("rest_days", f"""
WITH {RUN_DAYS_SQL}, g AS (SELECT *, day - lag(day) OVER w AS rest,
    coalesce(sum(runs) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    AS career_starts FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
i AS (SELECT *, sum((rest IS NULL OR rest >= 90)::INT) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g)
SELECT o_custkey, day, runs, rest AS rest_days, floor(rest / 7)::BIGINT AS rest_weeks, rest <= 7 AS back_to_back,
  career_starts, row_number() OVER (PARTITION BY o_custkey, island ORDER BY day) AS runs_since_layoff FROM i""")
def rest_days(spark, sf):
    return hi.rest_features(hi.entity_days(standin.runs(spark, sf), WHO, DAY), WHO, DAY)


@query("condition_streak", f"""
WITH {RUN_DAYS_SQL}, c AS (SELECT *, (condition IS DISTINCT FROM lag(condition) OVER w)::INT AS fresh FROM d
  WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM c)
SELECT o_custkey, day, runs, condition, row_number() OVER (PARTITION BY o_custkey, island ORDER BY day) AS streak FROM i""")
def condition_streak(spark, sf):
    days = hi.entity_days(standin.runs(spark, sf), WHO, DAY, TIE, "o_orderstatus")
    return hi.condition_streak(days, WHO, DAY)


# -- inside the race ---------------------------------------------------------------

@query("rank_in_race", """
SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS weight_rank,
  dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount) AS last3f_rank FROM lineitem""")
def rank_in_race(spark, sf):
    items = ir.set_apart(load(spark, sf, "lineitem"), ["l_orderkey"])  # both ranks share a shuffle
    out = ir.rank_in_race(items, ["l_orderkey"], "l_quantity", "weight_rank")
    out = ir.rank_in_race(out, ["l_orderkey"], "l_discount", "last3f_rank", descending=False, dense=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "weight_rank", "last3f_rank")


@query("minus_race_mean", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS vs_race
FROM lineitem""")
def minus_race_mean(spark, sf):
    out = ir.minus_race_mean(load(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "vs_race")
    return rounded(out, "vs_race").select("l_orderkey", "l_linenumber", "l_partkey", "vs_race")


@query("upset", """
SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS ability_rank,
  rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS popularity_rank,
  rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)
  - rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS upset FROM lineitem""")
def upset(spark, sf):
    out = ir.upset(load(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "ability_rank", "popularity_rank", "upset")


@query("score_buckets", """
SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS bucket,
  round(percent_rank() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC), 6) AS percent_rank FROM orders""")
def score_buckets(spark, sf):
    out = ir.buckets(standin.runs(spark, sf), [DAY], "o_totalprice", TIE, 4)
    return rounded(out, "percent_rank").select("o_orderkey", "bucket", "percent_rank")


@query("top_k", """
SELECT l_orderkey, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3""")
def top_k(spark, sf):
    out = ir.top_k(load(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_linenumber"])
    return out.select("l_orderkey", "l_partkey", "place")


STD_SQL = f"""
WITH {ENTRIES_SQL}, g AS (SELECT o_orderpriority, day, count(price) AS n, sum(price) AS s, sum(price * price) AS q
  FROM e GROUP BY 1, 2),
c AS (SELECT o_orderpriority, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM g WINDOW w AS
  (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("std_time", f"""{STD_SQL}
SELECT l_orderkey, l_partkey, CASE WHEN n > 1 AND q - s * s / n > 0
  THEN round((price - s / n) / sqrt((q - s * s / n) / (n - 1)), 5) END AS std_price
FROM e JOIN c USING (o_orderpriority, day)""")
def std_time(spark, sf):
    out = hi.standardised(standin.race_entries(spark, sf), ["o_orderpriority"], DAY, {"std_price": F.col("price")})
    return rounded(out, "std_price", places=5).select("l_orderkey", "l_partkey", "std_price")


# -- target encoding -----------------------------------------------------------------

def te_sql(keys: str, targets: str, m: int = 10, source: str = "orders", day: str = "o_orderdate::DATE") -> str:
    """CTEs t (rows with targets), g (global state before each day), k (key state before each day)."""
    names = [part.split(" AS ")[1].strip() for part in targets.split(",")]
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    over = ", ".join(f"sum({n}) OVER w AS {n}" for n in names)
    frame = "ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
t AS (SELECT *, {day} AS day, {targets} FROM {source}),
g AS (SELECT day, sum(n) OVER w AS n, {over} FROM (SELECT day, count(*) AS n, {sums} FROM t GROUP BY 1)
  WINDOW w AS ({frame})),
k AS (SELECT {keys}, day, sum(n) OVER w AS n, {over} FROM (SELECT {keys}, day, count(*) AS n, {sums} FROM t GROUP BY ALL)
  WINDOW w AS (PARTITION BY {keys} {frame}))"""


def encoded(target: str, m: int = 10, prior: str | None = None) -> str:
    return f"(coalesce(k.{target}, 0) + {m} * {prior or f'(g.{target} / g.n)'}) / (coalesce(k.n, 0) + {m})"


@query("te_key", f"""
WITH {te_sql("o_orderpriority", "(o_orderstatus = 'F')::DOUBLE AS y")}
SELECT o_orderkey, round({encoded("y")}, 6) AS te_y FROM t JOIN g USING (day) JOIN k USING (day, o_orderpriority)""")
def te_key(spark, sf):
    y = (F.col("o_orderstatus") == "F").cast("double")
    out = te.target_encode(standin.runs(spark, sf), ["o_orderpriority"], DAY, {"te_y": y})
    return rounded(out, "te_y").select("o_orderkey", "te_y")


@query("te_targets", f"""
WITH {te_sql("o_custkey", "(o_orderstatus = 'F')::DOUBLE AS y, (o_orderstatus <> 'P')::DOUBLE AS z, o_totalprice AS x")}
SELECT o_orderkey, round({encoded("y", 20)}, 6) AS te_win, round({encoded("z", 20)}, 6) AS te_place,
  round({encoded("x", 20)}, 5) AS te_mean
FROM t JOIN g USING (day) JOIN k USING (day, o_custkey)""")
def te_targets(spark, sf):
    status = F.col("o_orderstatus")
    out = te.target_encode(standin.runs(spark, sf), WHO, DAY, {
        "te_win": (status == "F").cast("int"), "te_place": (status != "P").cast("int"),
        "te_mean": F.col("o_totalprice")}, m=20)
    return rounded(rounded(out, "te_win", "te_place"), "te_mean", places=5) \
        .select("o_orderkey", "te_win", "te_place", "te_mean")


@query("te_backoff", f"""
WITH {te_sql("o_orderpriority, o_custkey", "(o_orderstatus = 'F')::DOUBLE AS y")},
p AS (SELECT o_orderpriority, day, sum(n) OVER w AS n, sum(y) OVER w AS y
  FROM (SELECT o_orderpriority, day, count(*) AS n, sum(y) AS y FROM t GROUP BY ALL) WINDOW w AS
  (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, round({encoded("y", 10, "((coalesce(p.y, 0) + 10 * (g.y / g.n)) / (coalesce(p.n, 0) + 10))")}, 6) AS te_y
FROM t JOIN g USING (day) JOIN k USING (day, o_orderpriority, o_custkey) JOIN p USING (day, o_orderpriority)""")
def te_backoff(spark, sf):
    y = (F.col("o_orderstatus") == "F").cast("int")
    out = te.target_encode(standin.runs(spark, sf), ["o_orderpriority", "o_custkey"], DAY, {"te_y": y},
                           parents=[["o_orderpriority"]])
    return rounded(out, "te_y").select("o_orderkey", "te_y")


@query("te_folds", f"""
WITH {te_sql("o_orderpriority", "(o_orderstatus = 'F')::DOUBLE AS y", day="date_trunc('month', o_orderdate)::DATE")}
SELECT o_orderkey, round({encoded("y")}, 6) AS te_y FROM t JOIN g USING (day) JOIN k USING (day, o_orderpriority)""")
def te_folds(spark, sf):
    y = (F.col("o_orderstatus") == "F").cast("int")
    out = te.target_encode(standin.runs(spark, sf), ["o_orderpriority"], DAY, {"te_y": y}, period="month")
    return rounded(out, "te_y").select("o_orderkey", "te_y")


def uniform_sql(salt: str) -> str:
    return f"(('0x' || substr(md5(o_orderkey || 'te_y' || '{salt}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"


@query("te_noise", f"""
WITH {te_sql("o_orderpriority", "(o_orderstatus = 'F')::DOUBLE AS y")}
SELECT o_orderkey, round({encoded("y")} + 0.01 * sqrt(-2 * ln({uniform_sql("a")}))
  * cos(2 * pi() * {uniform_sql("b")}), 6) AS te_y
FROM t JOIN g USING (day) JOIN k USING (day, o_orderpriority)""")
def te_noise(spark, sf):
    y = (F.col("o_orderstatus") == "F").cast("int")
    out = te.target_encode(standin.runs(spark, sf), ["o_orderpriority"], DAY, {"te_y": y}, noise=0.01,
                           row_key=F.col("o_orderkey"))
    return rounded(out, "te_y").select("o_orderkey", "te_y")


NAMED = (("suppkey", "jockey"), ("trainer", "trainer"), ("sire", "sire"), ("dam_sire", "dam_sire"))


@query("te_named", f"""
WITH {ENTRIES_SQL}, x AS (SELECT p.*, suppkey % 20 AS trainer, p_brand AS sire, p_type AS dam_sire, (position <= 3)::DOUBLE AS y
  FROM p JOIN part ON l_partkey = p_partkey),
g AS (SELECT day, sum(y) OVER w / sum(n) OVER w AS prior FROM (SELECT day, count(*) AS n, sum(y) AS y FROM x GROUP BY 1)
  WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{", ".join(f'''k_{k} AS (SELECT {k}, day, sum(n) OVER w AS n, sum(y) OVER w AS y
  FROM (SELECT {k}, day, count(*) AS n, sum(y) AS y FROM x GROUP BY 1, 2) WINDOW w AS
  (PARTITION BY {k} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))''' for k, _ in NAMED)}
SELECT l_orderkey, l_partkey, {", ".join(
    f"round((coalesce(k_{k}.y, 0) + 10 * prior) / (coalesce(k_{k}.n, 0) + 10), 6) AS {n}_te_place" for k, n in NAMED)}
FROM x JOIN g USING (day) JOIN k_suppkey USING (suppkey, day) JOIN k_trainer USING (trainer, day)
JOIN k_sire USING (sire, day) JOIN k_dam_sire USING (dam_sire, day)""")
def te_named(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sire"),
                                          F.col("p_type").alias("dam_sire"))
    rows = standin.placed_entries(spark, sf).select("l_orderkey", "l_partkey", "suppkey", "day", "position") \
        .withColumn("trainer", F.col("suppkey") % 20).join(part, "l_partkey")
    sets = {f"{name}_te_place": [key] for key, name in NAMED}
    out = te.encode_sets(rows, sets, DAY, F.col("position").between(1, 3).cast("int"))
    return rounded(out, *sets).select("l_orderkey", "l_partkey", *sets)


@query("prior_rate", f"""
WITH {te_sql("o_custkey, o_orderpriority", "(o_orderstatus = 'F')::BIGINT AS y, (o_totalprice >= 200000)::BIGINT AS c, (o_orderstatus = 'F' AND o_totalprice >= 200000)::BIGINT AS yc")}
SELECT o_orderkey, round(k.y / nullif(k.n, 0)::DOUBLE, 6) AS rate, round(k.yc / nullif(k.c, 0)::DOUBLE, 6) AS rich_rate
FROM t JOIN k USING (day, o_custkey, o_orderpriority)""")
def prior_rate(spark, sf):
    done, keys = F.col("o_orderstatus") == "F", ["o_custkey", "o_orderpriority"]
    out = te.prior_rate(standin.runs(spark, sf), keys, DAY, done, "rate")
    out = te.prior_rate(out, keys, DAY, done, "rich_rate", F.col("o_totalprice") >= 200000)
    return rounded(out, "rate", "rich_rate").select("o_orderkey", "rate", "rich_rate")


# -- composite features ------------------------------------------------------------------

ABILITY_SQL = f"""
WITH {ENTRIES_SQL},
v AS (SELECT *, price / 1000 - 0.2 * (quantity - 55) AS a, discount * 100 - 0.05 * (quantity - 55) AS b FROM e),
g AS (SELECT o_orderpriority, day, count(*) AS n, sum(a) AS sa, sum(a * a) AS qa, sum(b) AS sb, sum(b * b) AS qb
  FROM v GROUP BY 1, 2),
c AS (SELECT o_orderpriority, day, sum(n) OVER w AS n, sum(sa) OVER w AS sa, sum(qa) OVER w AS qa, sum(sb) OVER w AS sb,
  sum(qb) OVER w AS qb FROM g WINDOW w AS
  (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT v.*, 50 - 10 * coalesce(CASE WHEN n > 1 AND qa - sa * sa / n > 0
    THEN (a - sa / n) / sqrt((qa - sa * sa / n) / (n - 1)) END, 0)
  - 5 * coalesce(CASE WHEN n > 1 AND qb - sb * sb / n > 0
    THEN (b - sb / n) / sqrt((qb - sb * sb / n) / (n - 1)) END, 0)
  + 2 * ascii(o_orderstatus)::DOUBLE AS ability FROM v JOIN c USING (o_orderpriority, day))"""


def _ability(spark, sf):
    rows = standin.race_entries(spark, sf).withColumn("time", F.col("price") / 1000) \
        .withColumn("last3f", F.col("discount") * 100).withColumn("level", F.ascii("o_orderstatus"))
    return ft.ability_index(rows, ["o_orderpriority"], DAY, "time", "last3f", "quantity", "level")


@query("ability_index", f"{ABILITY_SQL} SELECT l_orderkey, l_partkey, round(ability, 5) AS ability FROM z")
def ability_index(spark, sf):
    return rounded(_ability(spark, sf), "ability", places=5).select("l_orderkey", "l_partkey", "ability")


@query("ability_history", f"""{ABILITY_SQL},
r AS (SELECT l_orderkey, l_partkey, day, ability, row_number() OVER (PARTITION BY l_partkey ORDER BY day, l_orderkey) AS n FROM z),
f AS (SELECT *, min(n) OVER (PARTITION BY l_partkey, day) AS first FROM r),
h AS (SELECT f.l_orderkey, f.l_partkey, avg(b.ability) AS m, max(b.ability) AS best,
  CASE WHEN count(b.n) >= 2 THEN regr_slope(b.ability, b.n) END AS trend, max_by(b.ability, b.n) AS last
  FROM f LEFT JOIN r b ON b.l_partkey = f.l_partkey AND b.n < f.first AND b.n >= f.first - 5 GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, round(m, 4) AS ability_mean, round(best, 4) AS ability_best, round(trend, 4) AS ability_trend,
  round(last, 4) AS ability_last, round(last - m, 4) AS ability_gap FROM h""")
def ability_history(spark, sf):
    out = ft.ability_history(_ability(spark, sf), ["l_partkey"], DAY, ["l_orderkey"])
    names = [f"ability_{n}" for n in ("mean", "best", "trend", "last", "gap")]
    return rounded(out, *names, places=4).select("l_orderkey", "l_partkey", *names)


@query("running_style", f"""
WITH {ENTRIES_SQL},
r AS (SELECT l_orderkey, l_partkey, day, quantity / 50 AS a, discount * 10 AS z,
  row_number() OVER (PARTITION BY l_partkey ORDER BY day, l_orderkey) AS n FROM e),
f AS (SELECT *, min(n) OVER (PARTITION BY l_partkey, day) AS first FROM r),
h AS (SELECT f.l_orderkey, f.l_partkey, round(avg(b.a), 9) AS early, round(avg(b.z), 9) AS late,
  round(avg((b.z < b.a)::INT), 9) AS closing
  FROM f LEFT JOIN r b ON b.l_partkey = f.l_partkey AND b.n < f.first AND b.n >= f.first - 5 GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, CASE WHEN early IS NULL THEN NULL WHEN early <= 0.1 THEN 1
  WHEN early <= 0.4 AND round(early - late, 9) >= 0.1 THEN 5 WHEN early <= 0.4 THEN 2
  WHEN early >= 0.7 AND closing >= 0.5 THEN 4 WHEN early >= 0.4 THEN CASE WHEN round(early - late, 9) > 0 THEN 3 ELSE 6 END
  ELSE 6 END AS style FROM h""")
def running_style(spark, sf):
    rows = standin.race_entries(spark, sf).withColumn("early", F.col("quantity") / 50) \
        .withColumn("late", F.col("discount") * 10)
    return ft.running_style(rows, ["l_partkey"], DAY, ["l_orderkey"], "early", "late") \
        .select("l_orderkey", "l_partkey", "style")


# -- the feature table ---------------------------------------------------------------------

def _rate_sql(cond: str) -> str:
    return (f"sum((finish_position = 1 AND {cond})::INT) OVER h / "
            f"nullif(sum((finish_position IS NOT NULL AND {cond})::INT) OVER h, 0)::DOUBLE")


def _state_sql(name: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, race_date, sum(n) OVER w AS n, sum(win) OVER w AS win, sum(plc) OVER w AS plc FROM
  (SELECT {keys}, race_date, count(finish_position) AS n, count(*) FILTER (finish_position = 1) AS win,
   count(*) FILTER (finish_position <= 3) AS plc FROM b GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _te(state: str, name: str) -> str:
    return f"round((coalesce({state}.plc, 0) + 10 * g.prior) / (coalesce({state}.n, 0) + 10), 6) AS {name}"


TRAINING_SQL = f"""
WITH e AS (SELECT l_orderkey, l_partkey, min(l_suppkey) AS s, max(l_quantity) AS q, max(l_extendedprice) AS x,
  max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
sz AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS num_horses FROM lineitem GROUP BY 1),
b AS (SELECT lpad(e.l_orderkey::VARCHAR, 8, '0') AS race_id, lpad(l_partkey::VARCHAR, 8, '0') AS horse_id,
  l_partkey AS horse_number, o_orderdate::DATE AS race_date, CASE WHEN o_orderkey % 11 > 0 THEN lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') END AS venue_code,
  o_orderkey % 12 + 1 AS race_number,
  CASE o_orderstatus WHEN 'O' THEN 'turf' WHEN 'F' THEN 'dirt' ELSE 'obstacle' END AS course_type,
  CASE WHEN o_orderkey % 13 > 0 THEN 1000 + o_orderkey % 20 * 100 END AS distance, CASE WHEN o_orderpriority = '1-URGENT' THEN '重' ELSE '良' END AS track_condition,
  num_horses, l_partkey % 8 + 1 AS bracket_number, lpad(s::VARCHAR, 5, '0') AS jockey_id,
  lpad((s % 20)::VARCHAR, 5, '0') AS trainer_id, 50 + q % 10 AS weight, x / 1000 AS idm, d * 100 - 5 AS ten,
  CASE WHEN (l_partkey + o_orderkey) % 37 <> 0 THEN nullif((l_partkey + o_orderkey) % 13, 0) END AS finish_position,
  33 + d * 10 AS last3f, p_brand AS sire, p_type AS dam_sire,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN 1000 + o_orderkey % 20 * 100 <= 1400 THEN 1 WHEN 1000 + o_orderkey % 20 * 100 <= 1800 THEN 2
    WHEN 1000 + o_orderkey % 20 * 100 <= 2100 THEN 3 ELSE 4 END AS band
  FROM e JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN sz ON sz.l_orderkey = e.l_orderkey LEFT JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY race_date, race_id) AS rn FROM b),
f AS (SELECT *, min(rn) OVER (PARTITION BY horse_id, race_date) AS first FROM r),
past AS (SELECT f.race_id, f.horse_id,
  avg(h.finish_position) FILTER (h.rn >= f.first - 3) AS p3, avg(h.finish_position) FILTER (h.rn >= f.first - 5) AS p5,
  avg(h.finish_position) AS p10, avg(h.last3f) FILTER (h.rn >= f.first - 3) AS l3,
  avg(h.last3f) FILTER (h.rn >= f.first - 5) AS l5
  FROM f LEFT JOIN r h ON h.horse_id = f.horse_id AND h.rn < f.first AND h.rn >= f.first - 10 GROUP BY 1, 2),
cond AS (SELECT race_id, horse_id, {_rate_sql("course_type = 'turf'")} AS turf, {_rate_sql("course_type = 'dirt'")} AS dirt,
  {_rate_sql("track_condition = '重'")} AS heavy FROM b WINDOW h AS (PARTITION BY horse_id ORDER BY race_date
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
g AS (SELECT race_date, sum(plc) OVER w / sum(n) OVER w AS prior FROM (SELECT race_date,
  count(finish_position) AS n, count(*) FILTER (finish_position <= 3) AS plc FROM b GROUP BY 1) WINDOW w AS (ORDER BY race_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{_state_sql("s_band", "horse_id, band")}, {_state_sql("s_venue", "horse_id, venue_code")},
{_state_sql("s_jockey", "jockey_id")}, {_state_sql("s_jv", "jockey_id, venue_code")},
{_state_sql("s_trainer", "trainer_id")}, {_state_sql("s_sire", "sire")}, {_state_sql("s_dam", "dam_sire")},
tick AS (SELECT lpad(l_orderkey::VARCHAR, 8, '0') AS race_id, lpad(l_partkey::VARCHAR, 8, '0') AS horse_id,
  o_orderdate::DATE AS day, max(l_quantity) AS v, (l_linenumber * 6 - 24) AS hours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, o_orderdate, l_linenumber),
px AS (SELECT race_id, horse_id, max_by(v, hours) FILTER (hours < 0) AS odds_yesterday,
  max_by(v, hours) FILTER (hours <= 10) AS odds_today FROM tick GROUP BY 1, 2),
a AS (SELECT b.*, p3, p5, p10, l3, l5, turf, dirt, heavy, odds_yesterday, odds_today,
  rank() OVER (PARTITION BY race_id ORDER BY weight DESC) AS weight_rank,
  rank() OVER (PARTITION BY race_id ORDER BY idm DESC) AS ability_rank,
  CASE WHEN l5 IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY round(l5, 6) NULLS LAST) END AS last3f_rank,
  count(*) FILTER (ten >= 0) OVER (PARTITION BY race_id) AS front_runner_count,
  avg(ten) FILTER (ten >= 0) OVER (PARTITION BY race_id) AS expected_pace_score
  FROM b JOIN past USING (race_id, horse_id) JOIN cond USING (race_id, horse_id)
  LEFT JOIN px USING (race_id, horse_id))
SELECT race_id, horse_id, race_date, finish_position <= 3 AS target_place, finish_position, venue_code, race_number,
  course_type, distance, track_condition, num_horses, bracket_number, horse_number, weight::BIGINT AS weight,
  round(p3, 6) AS past_3_avg_position, round(p5, 6) AS past_5_avg_position, round(p10, 6) AS past_10_avg_position,
  round(l3, 6) AS past_3_avg_last3f, round(l5, 6) AS past_5_avg_last3f, round(turf, 6) AS turf_win_rate,
  round(dirt, 6) AS dirt_win_rate, round(s_band.win / nullif(s_band.n, 0)::DOUBLE, 6) AS distance_category_win_rate,
  round(s_venue.win / nullif(s_venue.n, 0)::DOUBLE, 6) AS venue_win_rate, round(heavy, 6) AS heavy_track_win_rate, jockey_id,
  round(s_jockey.win / nullif(s_jockey.n, 0)::DOUBLE, 6) AS jockey_win_rate,
  round(s_jv.win / nullif(s_jv.n, 0)::DOUBLE, 6) AS jockey_venue_win_rate, trainer_id,
  round(s_trainer.win / nullif(s_trainer.n, 0)::DOUBLE, 6) AS trainer_win_rate, {_te("s_jockey", "jockey_te_place")},
  {_te("s_trainer", "trainer_te_place")}, {_te("s_sire", "sire_te_place")}, {_te("s_dam", "dam_sire_te_place")},
  weight_rank, ability_rank, last3f_rank, front_runner_count, round(expected_pace_score, 6) AS expected_pace_score,
  odds_yesterday, odds_today, TIMESTAMP '2026-01-04 12:00:00' AS created_at
FROM a JOIN g USING (race_date) LEFT JOIN s_band USING (horse_id, band, race_date)
LEFT JOIN s_venue USING (horse_id, venue_code, race_date) JOIN s_jockey USING (jockey_id, race_date)
LEFT JOIN s_jv USING (jockey_id, venue_code, race_date) JOIN s_trainer USING (trainer_id, race_date)
LEFT JOIN s_sire USING (sire, race_date) LEFT JOIN s_dam USING (dam_sire, race_date) WHERE finish_position IS NOT NULL"""


# A hair above the half, so that both engines round an exact half alike; the rank rounds as the operator does.
TRAINING_SQL = TRAINING_SQL.replace(", 6)", " + 1e-9, 6)").replace("round(l5 + 1e-9, 6) NULLS", "round(l5, 6) NULLS")


@query("training_data", TRAINING_SQL, **{CO_PARTITION: "false"})
def training_data(spark, sf):
    tables = standin.training_tables(spark, sf)
    out = assemble(**tables, created_at=datetime(2026, 1, 4, 12, 0, 0))
    rates = [f.name for f in out.schema if f.dataType.simpleString() == "double" and not f.name.startswith("odds_")]
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in rates}).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
