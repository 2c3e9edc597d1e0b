import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from furlong.operators import quality as qc
from furlong.sources.tables import save_report

AS_OF = date(2026, 1, 1)


def results(spark, df, **check):
    check = qc.TableCheck("raw", "t", **check)
    rows = qc.run_checks(spark, {"raw.t": df}, [check], AS_OF).collect()
    return {(r.check_name, r.details.get("column")): r for r in rows}


@pytest.mark.parametrize("rows, passed", [(5000, True), (500, False)])
def test_row_count(spark, rows, passed):
    row = results(spark, spark.range(rows), min_rows=1000)["row_count_check", None]
    assert (row.passed, row.severity) == (passed, "WARNING")
    assert row.message == f"レコード数: {rows:,} (最低期待値: 1,000)"


def test_nulls(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") >= 50, F.col("id")))
    got = results(spark, df, not_null=("id", "x"))
    assert got["null_check", "id"].passed
    bad = got["null_check", "x"]
    assert not bad.passed and bad.severity == "ERROR" and float(bad.details["null_percentage"]) == 5.0
    assert bad.message == "カラム 'x': NULL件数 50 / 1,000 (5.00%)"
    assert not [k for k in results(spark, df) if k[0] == "null_check"]


def test_empty_table(spark):
    row = results(spark, spark.range(0), not_null=("id",))["null_check", "id"]
    assert row.passed and float(row.details["null_percentage"]) == 0.0


def test_duplicates(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 950)
    assert results(spark, df, key=("id",))["duplicate_check", None].passed
    bad = results(spark, df, key=("k",))["duplicate_check", None]
    assert not bad.passed and bad.details["duplicate_count"] == "50"


def test_key_modes(spark):
    df = spark.createDataFrame([(1, 11), (11, 1), (None, 1)], "a int, b int")
    check = [qc.TableCheck("raw", "t", key=("a", "b"))]

    def extra(mode):
        rows = qc.run_checks(spark, {"raw.t": df}, check, AS_OF, mode).where("check_name = 'duplicate_check'")
        return rows.first().details["duplicate_count"]

    assert (extra("tuple"), extra("concat")) == ("0", "2")


def test_dates(spark):
    days = [date(2010, 1, 1)] * 5 + [date(2026, 1, 9)] * 3 + [date(2026, 1, 8), date(2016, 1, 1), None]
    got = results(spark, spark.createDataFrame([(d,) for d in days], "d date"), dates=("d",))["date_range_check", "d"]
    assert not got.passed and got.severity == "WARNING"
    assert (got.details["too_old_count"], got.details["too_future_count"]) == ("5", "3")
    assert got.message == "カラム 'd': 範囲 2010-01-01 ~ 2026-01-09 古すぎる日付: 5件, 未来すぎる日付: 3件"


def test_numbers(spark):
    values = [0] * 5 + [15] * 3 + [1, 12, None]
    df = spark.createDataFrame([(v, v) for v in values], "race_number int, other int")
    got = results(spark, df, numbers=("race_number", "other"))
    row = got["numeric_range_check", "race_number"]
    assert not row.passed and row.severity == "INFO"
    assert (row.details["below_min_count"], row.details["above_max_count"]) == ("5", "3")
    assert row.message == "カラム 'race_number': 範囲 0 ~ 15 (期待値: 1 ~ 12) 最小値未満: 5件, 最大値超過: 3件"
    assert ("numeric_range_check", "other") not in got
    zero = results(spark, spark.createDataFrame([(0.0,)], "distance double"), numbers=("distance",))
    assert zero["numeric_range_check", "distance"].details["avg_val"] == "0.0"


def canned(spark, *rows):
    return spark.createDataFrame([("c", f"raw.t{i}", ok, sev, "m", {}) for i, (ok, sev) in enumerate(rows)],
                                 qc.RESULT_SCHEMA)


@pytest.mark.parametrize("rows, counts, status, alerting", [
    ([(True, "INFO"), (False, "ERROR"), (False, "WARNING")], (3, 1, 2, 1, 1, 0), "FAILED", 1),
    ([(False, "WARNING"), (False, "INFO")], (2, 0, 2, 0, 1, 1), "WARNING", 0),
    ([(False, "INFO")], (1, 0, 1, 0, 0, 1), "PASSED", 0), ([(True, "ERROR")], (1, 1, 0, 0, 0, 0), "PASSED", 0)])
def test_summary(spark, rows, counts, status, alerting):
    df = canned(spark, *rows)
    assert tuple(qc.summarise(df).first()) == (*counts, status)
    assert qc.alerts(df).count() == alerting


def test_missing_table_skips_the_other_checks(spark):
    rows = qc.run_checks(spark, {}, qc.TABLE_CHECKS, AS_OF).collect()
    assert [(r.check_name, r.passed, r.severity) for r in rows] == [("table_exists", False, "ERROR")] * 5


def test_fused_equals_single_checks(spark):
    df = spark.range(100).withColumn("d", F.lit(AS_OF)).withColumn("distance", F.col("id"))
    full = results(spark, df, key=("id",), not_null=("id",), dates=("d",), numbers=("distance",))
    for options in ({"key": ("id",)}, {"not_null": ("id",)}, {"dates": ("d",)}, {"numbers": ("distance",)}):
        for name, row in results(spark, df, **options).items():
            assert full[name] == row


def test_selector():
    assert [c.table for c in qc.select_checks("raw.race_info")] == ["race_info"]
    assert len(qc.select_checks(None)) == 5
    for bad in ("race_info", "raw.race_info.extra", "raw.unknown"):
        with pytest.raises(ValueError):
            qc.select_checks(bad)


def test_rules(spark):
    assert {r.name: r.severity for r in qc.rule_registry(spark).collect()}["numeric_range_check"] == "INFO"


def test_report_file(spark, tmp_path):
    df = canned(spark, (True, "INFO"), (False, "ERROR"))
    save_report(qc.report(df, "demo", datetime(2026, 1, 4, 12, 30, 5)), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.json")).read_text()
    doc = json.loads(text)
    assert doc["report_id"] == "20260104_123005" and doc["status"] == "FAILED"
    assert doc["summary"]["error_count"] == 1 and len(doc["results"]) == 2
