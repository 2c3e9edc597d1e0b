"""Queries: quality checks, labels, splits, backtests, streaming."""

from __future__ import annotations

from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import functions as F

from furlong.operators import evaluate as ev, quality as qc
from furlong.plans import standin
from furlong.plans.queries_joins import ENTRIES_SQL, rounded
from furlong.plans.registry import load, query
from furlong.session import shared_dir
from furlong.sources import files as fs
from furlong.sources.tables import read_table
from furlong.streaming.ingest import lines_stream
from furlong.streaming.odds import last_prices, odds_buckets, open_buckets

AS_OF = date(2001, 7, 1)

CHECKS = (
    qc.TableCheck("raw", "orders", ("o_custkey", "o_orderdate"), ("o_orderkey", "o_custkey", "status"),
                  ("day",), ("o_totalprice", "unbounded"), 10000, "orders",
                  {"o_totalprice": (1000.0, 450000.0)}),
    qc.TableCheck("raw", "lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey",), ("ship_day",),
                  ("l_quantity", "l_discount"), 100000, "line items",
                  {"l_quantity": (1, 50), "l_discount": (0.0, 0.09)}),
    qc.TableCheck("raw", "customer", ("c_custkey",), ("c_custkey", "c_name"), (), ("c_acctbal",), 1000, "customers",
                  {"c_acctbal": (0.0, 1e9)}),
    qc.TableCheck("raw", "missing", ("id",), ("id",), min_rows=1),
)


def _tables(spark, sf):
    orders = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")) \
        .withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    items = load(spark, sf, "lineitem").withColumn("ship_day", F.col("l_shipdate").cast("date"))
    return {"raw.orders": orders, "raw.lineitem": items, "raw.customer": load(spark, sf, "customer"), "raw.missing": None}


def _results(spark, sf):
    return qc.run_checks(spark, _tables(spark, sf), CHECKS, AS_OF)


def _range_sql(table: str, column: str, name: str, old: str, late: str, severity: str, low_key: str, high_key: str) -> str:
    return f"""SELECT '{name}', 'raw.{table}', count(*) FILTER ({old}) + count(*) FILTER ({late}) = 0, '{severity}',
  '{column}', count(*) FILTER ({old})::VARCHAR, count(*) FILTER ({late})::VARCHAR FROM {table}"""


CHECKS_SQL = f"""
o AS (SELECT *, o_orderdate::DATE AS day, nullif(o_orderstatus, 'P') AS status FROM orders),
res(check_name, table_name, passed, severity, subject, low, high) AS (
SELECT 'table_exists', 'raw.' || t, t <> 'missing', 'ERROR', NULL, NULL, NULL
  FROM (VALUES ('orders'), ('lineitem'), ('customer'), ('missing')) v(t)
UNION ALL SELECT 'row_count_check', 'raw.orders', count(*) >= 10000, 'WARNING', NULL, count(*)::VARCHAR, '10000' FROM orders
UNION ALL SELECT 'row_count_check', 'raw.lineitem', count(*) >= 100000, 'WARNING', NULL, count(*)::VARCHAR, '100000' FROM lineitem
UNION ALL SELECT 'row_count_check', 'raw.customer', count(*) >= 1000, 'WARNING', NULL, count(*)::VARCHAR, '1000' FROM customer
UNION ALL SELECT 'null_check', 'raw.orders', true, 'ERROR', 'o_orderkey', '0', count(*)::VARCHAR FROM o
UNION ALL SELECT 'null_check', 'raw.orders', true, 'ERROR', 'o_custkey', '0', count(*)::VARCHAR FROM o
UNION ALL SELECT 'null_check', 'raw.orders', count(status) = count(*), 'ERROR', 'status', (count(*) - count(status))::VARCHAR,
  count(*)::VARCHAR FROM o
UNION ALL SELECT 'null_check', 'raw.lineitem', true, 'ERROR', 'l_orderkey', '0', count(*)::VARCHAR FROM lineitem
UNION ALL SELECT 'null_check', 'raw.customer', true, 'ERROR', 'c_custkey', '0', count(*)::VARCHAR FROM customer
UNION ALL SELECT 'null_check', 'raw.customer', true, 'ERROR', 'c_name', '0', count(*)::VARCHAR FROM customer
UNION ALL SELECT 'duplicate_check', 'raw.orders', count(*) = count(DISTINCT (o_custkey, o_orderdate)), 'ERROR', NULL,
  (count(*) - count(DISTINCT (o_custkey, o_orderdate)))::VARCHAR, count(*)::VARCHAR FROM orders
UNION ALL SELECT 'duplicate_check', 'raw.lineitem', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), 'ERROR', NULL,
  (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::VARCHAR, count(*)::VARCHAR FROM lineitem
UNION ALL SELECT 'duplicate_check', 'raw.customer', count(*) = count(DISTINCT c_custkey), 'ERROR', NULL,
  (count(*) - count(DISTINCT c_custkey))::VARCHAR, count(*)::VARCHAR FROM customer
UNION ALL {_range_sql("o", "day", "date_range_check", "day < DATE '2016-01-01'", "day > DATE '2001-07-08'", "WARNING", "", "").replace("'raw.o'", "'raw.orders'")}
UNION ALL {_range_sql("lineitem", "ship_day", "date_range_check", "l_shipdate::DATE < DATE '2016-01-01'", "l_shipdate::DATE > DATE '2001-07-08'", "WARNING", "", "")}
UNION ALL {_range_sql("orders", "o_totalprice", "numeric_range_check", "o_totalprice < 1000", "o_totalprice > 450000", "INFO", "", "")}
UNION ALL {_range_sql("lineitem", "l_quantity", "numeric_range_check", "l_quantity < 1", "l_quantity > 50", "INFO", "", "")}
UNION ALL {_range_sql("lineitem", "l_discount", "numeric_range_check", "l_discount < 0", "l_discount > 0.09::DOUBLE", "INFO", "", "")}
UNION ALL {_range_sql("customer", "c_acctbal", "numeric_range_check", "c_acctbal < 0", "c_acctbal > 1e9", "INFO", "", "")})"""


@query("quality_checks", f"WITH {CHECKS_SQL} SELECT check_name, table_name, passed, severity, subject, low, high FROM res")
def quality_checks(spark, sf):
    d = F.col("details")
    low = F.coalesce(d["row_count"], d["null_count"], d["duplicate_count"], d["too_old_count"], d["below_min_count"])
    high = F.coalesce(d["total_count"], d["too_future_count"], d["above_max_count"], d["expected_min"])
    return _results(spark, sf).select("check_name", "table_name", "passed", "severity", d["column"].alias("subject"),
                                      low.alias("low"), high.alias("high"))


def _count(condition: str = "true") -> str:
    return f"printf('%,d', count(*) FILTER ({condition}))"


def _nulls_text(table: str, column: str, source: str, nulls: str) -> str:
    share = f"printf('%.2f', 100.0 * count(*) FILTER ({nulls}) / count(*)::DOUBLE)"
    return f"""SELECT 'null_check', 'raw.{table}', 'カラム ''{column}'': NULL件数 ' || {_count(nulls)} || ' / ' || {_count()} || ' (' || {share} || '%)' FROM {source}"""


def _issues_text(low: str, low_text: str, high: str, high_text: str) -> str:
    return f"""CASE WHEN count(*) FILTER (({low}) OR ({high})) = 0 THEN '正常' ELSE concat_ws(', ',
  CASE WHEN count(*) FILTER ({low}) > 0 THEN '{low_text}: ' || count(*) FILTER ({low}) || '件' END,
  CASE WHEN count(*) FILTER ({high}) > 0 THEN '{high_text}: ' || count(*) FILTER ({high}) || '件' END) END"""


def _dates_text(table: str, column: str, source: str) -> str:
    day = f"{source}::DATE"
    issues = _issues_text(f"{day} < DATE '2016-01-01'", "古すぎる日付", f"{day} > DATE '2001-07-08'", "未来すぎる日付")
    return f"""SELECT 'date_range_check', 'raw.{table}', 'カラム ''{column}'': 範囲 ' || min({day}) || ' ~ ' || max({day}) || ' ' || {issues} FROM {table}"""


def _numbers_text(table: str, column: str, least: str, most: str) -> str:
    issues = _issues_text(f"{column} < {least}::DOUBLE", "最小値未満", f"{column} > {most}::DOUBLE", "最大値超過")
    return f"""SELECT 'numeric_range_check', 'raw.{table}', 'カラム ''{column}'': 範囲 ' || min({column}) || ' ~ ' || max({column})
  || ' (期待値: {least} ~ {most}) ' || {issues} FROM {table}"""


MESSAGES_SQL = " UNION ALL ".join([
    "SELECT 'table_exists' AS check_name, 'raw.missing' AS table_name, 'テーブル raw.missing が存在しません' AS message",
    *[f"SELECT 'table_exists', 'raw.{t}', 'テーブル raw.{t} が存在します'" for t in ("orders", "lineitem", "customer")],
    *[f"SELECT 'row_count_check', 'raw.{t}', 'レコード数: ' || {_count()} || ' (最低期待値: {n})' FROM {t}"
      for t, n in (("orders", "10,000"), ("lineitem", "100,000"), ("customer", "1,000"))],
    _nulls_text("orders", "o_orderkey", "orders", "o_orderkey IS NULL"), _nulls_text("orders", "o_custkey", "orders", "o_custkey IS NULL"),
    _nulls_text("orders", "status", "orders", "coalesce(o_orderstatus, 'P') = 'P'"), _nulls_text("lineitem", "l_orderkey", "lineitem", "l_orderkey IS NULL"),
    _nulls_text("customer", "c_custkey", "customer", "c_custkey IS NULL"), _nulls_text("customer", "c_name", "customer", "c_name IS NULL"),
    *[f"SELECT 'duplicate_check', 'raw.{t}', '主キー ({k}): 重複件数 ' || printf('%,d', count(*) - count(DISTINCT ({k}))) || ' / ' || {_count()} FROM {t}"
      for t, k in (("orders", "o_custkey, o_orderdate"), ("lineitem", "l_orderkey, l_linenumber"), ("customer", "c_custkey"))],
    _dates_text("orders", "day", "o_orderdate"), _dates_text("lineitem", "ship_day", "l_shipdate"),
    _numbers_text("orders", "o_totalprice", "1000.0", "450000.0"), _numbers_text("lineitem", "l_quantity", "1", "50"),
    _numbers_text("lineitem", "l_discount", "0.0", "0.09"), _numbers_text("customer", "c_acctbal", "0.0", "1000000000.0"),
])


@query("quality_messages", MESSAGES_SQL)
def quality_messages(spark, sf):
    return _results(spark, sf).select("check_name", "table_name", "message")


@query("quality_summary", f"""
WITH {CHECKS_SQL} SELECT count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks,
  count(*) FILTER (NOT passed) AS failed_checks, count(*) FILTER (NOT passed AND severity = 'ERROR') AS error_count,
  count(*) FILTER (NOT passed AND severity = 'WARNING') AS warning_count,
  count(*) FILTER (NOT passed AND severity = 'INFO') AS info_count,
  CASE WHEN count(*) FILTER (NOT passed AND severity = 'ERROR') > 0 THEN 'FAILED'
    WHEN count(*) FILTER (NOT passed AND severity = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM res""")
def quality_summary(spark, sf):
    return qc.summarise(_results(spark, sf))


@query("quality_by_table", f"""
WITH {CHECKS_SQL} SELECT table_name, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed
FROM res GROUP BY 1""")
def quality_by_table(spark, sf):
    return qc.by_table(_results(spark, sf))


@query("quality_failed", f"""
WITH {CHECKS_SQL} SELECT check_name, table_name, severity, subject, severity = 'ERROR' AS alert FROM res WHERE NOT passed""")
def quality_failed(spark, sf):
    failed = qc.failed_checks(_results(spark, sf))
    return failed.select("check_name", "table_name", "severity", F.col("details")["column"].alias("subject"),
                         (F.col("severity") == qc.ERROR).alias("alert"))


@query("quality_concat_keys", """
SELECT count(*) - count(DISTINCT l_orderkey::VARCHAR || l_linenumber::VARCHAR) AS concat_duplicates,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS tuple_duplicates FROM lineitem""")
def quality_concat_keys(spark, sf):
    check = [qc.TableCheck("raw", "lineitem", ("l_orderkey", "l_linenumber"))]
    tables = {"raw.lineitem": load(spark, sf, "lineitem")}

    def duplicates(mode):
        return qc.run_checks(spark, tables, check, AS_OF, mode).where(F.col("check_name") == "duplicate_check") \
            .select(F.col("details")["duplicate_count"].cast("bigint").alias(f"{mode}_duplicates"))

    return duplicates("concat").withColumn("tuple_duplicates", duplicates("tuple").scalar())


@query("quality_report", f"""
WITH {CHECKS_SQL} SELECT '20260104_120000' AS report_id, 'demo' AS project_id, count(*) AS results,
  count(*) FILTER (NOT passed) AS failed_checks FROM res""")
def quality_report(spark, sf):
    report = qc.report(_results(spark, sf), "demo", datetime(2026, 1, 4, 12, 0, 0))
    return report.select("report_id", "project_id", F.size("results").cast("bigint").alias("results"),
                         F.col("summary.failed_checks").alias("failed_checks"))


# -- labels, splits, backtests ----------------------------------------------------------

@query("label", f"""
WITH {ENTRIES_SQL} SELECT l_orderkey, l_partkey, position, position <= 3 AS target_place FROM p
WHERE l_partkey % 7 IN (0, 5, 6)""")
def label(spark, sf):
    rows = standin.placed_entries(spark, sf).withColumn("abnormal_code", F.col("l_partkey") % 7)
    return ev.label(rows, "position").select("l_orderkey", "l_partkey", "position", "target_place")


@query("time_split", """
SELECT CASE WHEN o_orderdate < DATE '1999-07-01' THEN 'train' WHEN o_orderdate < DATE '2000-07-01' THEN 'valid'
  ELSE 'test' END AS split, count(*) AS n, count(DISTINCT o_custkey) AS horses FROM orders GROUP BY 1""")
def time_split(spark, sf):
    parts = ev.time_split(standin.runs(spark, sf), "day", {"train": date(1999, 7, 1), "valid": date(2000, 7, 1)})
    return parts.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("horses"))


@query("straddling_entities", """
SELECT o_custkey FROM orders GROUP BY 1
HAVING min(o_orderdate) < DATE '1999-07-01' AND max(o_orderdate) >= DATE '1999-07-01'""")
def straddling_entities(spark, sf):
    parts = ev.time_split(standin.runs(spark, sf), "day", {"train": date(1999, 7, 1)})
    return ev.straddling(parts, ["o_custkey"])


@query("rolling_folds", """
WITH p AS (SELECT o_orderkey, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS period FROM orders)
SELECT f.fold::INTEGER AS fold, CASE WHEN period = fold THEN 'valid' ELSE 'train' END AS role, count(*) AS n,
  min(o_orderkey) AS lowest, max(o_orderkey) AS highest
FROM p, (SELECT unnest(range(1, 21)) AS fold) f WHERE period <= fold GROUP BY 1, 2""")
def rolling_folds(spark, sf):
    folds = ev.rolling_folds(standin.runs(spark, sf), "day", "quarter", date(1995, 1, 1), 20)
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lowest"),
                                             F.max("o_orderkey").alias("highest"))


@query("backtest", """
WITH w AS (SELECT l_orderkey, l_partkey, max(l_quantity) * 20 AS payout FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, l_returnflag AS bet_type, 100.0::DOUBLE * l_linenumber AS stake, payout
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN w USING (l_orderkey, l_partkey))
SELECT month, bet_type, grouping(month, bet_type) AS level, count(*) AS bets, sum(stake) AS staked,
  round(coalesce(sum(stake * payout / 100), 0), 2) AS returned, round(avg((payout IS NOT NULL)::INT), 6) AS hit_rate,
  round(coalesce(sum(stake * payout / 100), 0) / sum(stake) * 100, 6) AS return_rate,
  coalesce(sum(stake * payout / 100), 0) / sum(stake) * 100 >= 100 AS profitable
FROM b GROUP BY ROLLUP (month, bet_type)""")
def backtest(spark, sf):
    items = load(spark, sf, "lineitem")
    bets = items.join(standin.runs(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", F.date_format("day", "yyyy-MM").alias("month"),
        F.col("l_returnflag").alias("bet_type"), (100.0 * F.col("l_linenumber")).alias("stake"))
    payouts = items.where(F.col("l_returnflag") == "R").groupBy("l_orderkey", "l_partkey") \
        .agg((F.max("l_quantity") * 20).alias("payout"))
    out = ev.backtest(bets, payouts, ["l_orderkey", "l_partkey"], ["month", "bet_type"])
    return rounded(rounded(out, "hit_rate", "return_rate"), "returned", places=2)


@query("calibration", """
WITH d AS (SELECT *, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS decile FROM orders)
SELECT decile, count(*) AS rows, round(avg(o_totalprice), 4) AS mean_score,
  round(avg((o_orderstatus = 'F')::INT), 6) AS hit_rate FROM d GROUP BY 1""")
def calibration(spark, sf):
    out = ev.calibration(standin.runs(spark, sf), "o_totalprice", F.col("o_orderstatus") == "F", ["o_orderkey"])
    return rounded(rounded(out, "hit_rate"), "mean_score", places=4)


# -- streaming ---------------------------------------------------------------------------

@query("stream_odds", """
WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket_start, user_id, event_type,
  min_by(value, ts) AS open_value, max_by(value, ts) AS close_value, count(*) AS ticks FROM events GROUP BY 1, 2, 3)
SELECT bucket_start, bucket_start + INTERVAL 1 HOUR AS bucket_end, user_id, event_type, open_value, close_value,
  round(close_value - open_value, 6) AS change, ticks FROM b
WHERE bucket_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_odds(spark, sf):
    """Buckets closed by the watermark after the whole stream has been read."""
    closed, _ = _streamed_odds(spark, sf)
    return _bucket_columns(closed)


def _bucket_columns(out: DataFrame) -> DataFrame:
    return rounded(out, "change").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "bucket_end")})


def _streamed_odds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Closed buckets of a stream that read all events, and those still open when it ended."""
    base, keys = f"{shared_dir(spark)}/stream-odds-{uuid4().hex}", ["user_id", "event_type"]
    ticks = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet") \
        .parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    buckets = odds_buckets(ticks, keys, "value", "ts", bucket="1 hour", tick_id=["event_id"])
    run = buckets.writeStream.format("parquet").option("path", f"{base}/out") \
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(buckets.schema).parquet(f"{base}/out"), open_buckets(spark, f"{base}/checkpoint", buckets, keys)


@query("stream_open_odds", """
WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket_start, user_id, event_type,
  min_by(value, ts) AS open_value, max_by(value, ts) AS close_value, count(*) AS ticks FROM events GROUP BY 1, 2, 3)
SELECT bucket_start, bucket_start + INTERVAL 1 HOUR AS bucket_end, user_id, event_type, open_value, close_value,
  round(close_value - open_value, 6) AS change, ticks FROM b
WHERE bucket_start + INTERVAL 1 HOUR > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_open_odds(spark, sf):
    """Buckets that the watermark had not closed when the stream ended."""
    return _bucket_columns(_streamed_odds(spark, sf)[1])


@query("stream_last_prices", """
SELECT user_id, event_type, max_by(value, ts) AS last_value, max(time_bucket(INTERVAL '1 hour', ts)) AS bucket_start, count(*) AS ticks
FROM events GROUP BY 1, 2""")
def stream_last_prices(spark, sf):
    """The last price of every key of a stream that ended, wherever its bucket stands."""
    out = last_prices(*_streamed_odds(spark, sf), ["user_id", "event_type"])
    return out.withColumns({"bucket_start": F.col("bucket_start").cast("timestamp_ntz"), "ticks": F.col("ticks").cast("bigint")})


@query("odds_sliding", """
WITH s AS (SELECT *, unnest([0, 1]) AS k FROM events)
SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL 30 MINUTE AS bucket_start, event_type,
  min_by(value, ts) AS open_value, max_by(value, ts) AS close_value, count(*) AS ticks FROM s GROUP BY 1, 2""")
def odds_sliding(spark, sf):
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = odds_buckets(events, ["event_type"], "value", "ts", bucket="1 hour", slide="30 minutes", tick_id=["event_id"])
    return out.select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "event_type", "open_value",
                      "close_value", "ticks")


@query("stream_upsert", """
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS horse_id, trim(p_name) AS horse_name, p_partkey % 11 + 1 AS coat_color_code,
  p_brand AS sire_name, CASE WHEN p_partkey % 4 = 0 THEN 'owner' || p_size ELSE 'later' || p_size END AS owner_name,
  TIMESTAMP '2026-01-04 12:00:00' AS updated_at
FROM part""")
def stream_upsert(spark, sf):
    """Horse records streamed from text: a later file wins, and a second run of the stream adds nothing."""
    base = f"{shared_dir(spark)}/stream-upsert-{uuid4().hex}"
    line = F.col("line")
    early = standin.horse_lines(spark, sf).select(F.lit("UKC240105.csv").alias("path"), line)
    # The later file corrects the owner of three horses in four.
    late = early.where(F.substring(line, 1, 8).cast("bigint") % 4 != 0).select(
        F.lit("UKC240112.csv").alias("path"), F.replace(line, F.lit("owner"), F.lit("later")).alias("line"))
    late.unionByName(early).write.parquet(f"{base}/in")

    def lines():
        rows = spark.readStream.schema("path string, line string").parquet(f"{base}/in")
        return rows.select("path", fs.data_type(F.col("path")).alias("data_type"),
                           fs.file_date(F.col("path")).alias("file_date"), F.xxhash64("line").alias("line_no"), "line")

    for attempt in ("first", "again"):
        lines_stream(lines(), f"{base}/tables", f"{base}/checkpoint-{attempt}",
                     clock=lambda: datetime(2026, 1, 4, 12, 0, 0)).awaitTermination()
    return read_table(spark, f"{base}/tables", "horse_master").select(
        "horse_id", "horse_name", "coat_color_code", "sire_name", "owner_name",
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
