from datetime import date

import pytest
from pyspark.sql import functions as F

from furlong.functions import codes, derive, fields as fx


def value(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("12", 12), (" 12 ", 12), ("+5", 5), ("-7", -7), ("　3　", 3), ("5\r", 5), ("", None), ("   ", None),
    ("12.5", None), ("1 2", None), ("abc", None), ("1_0", None), ("１２", None), ("99999999999999999999", None)])
def test_to_int(spark, text, want):
    assert value(spark, text, fx.to_int) == want


@pytest.mark.parametrize("text, want", [
    ("12.5", 12.5), (" -0.2", -0.2), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("　8.0", 8.0), ("", None),
    ("1d", None), ("1f", None), ("nan", None), ("inf", None), ("Infinity", None), ("0x1p3", None), ("-", None)])
def test_to_float(spark, text, want):
    assert value(spark, text, fx.to_float) == want


@pytest.mark.parametrize("text, want", [
    ("20260104", date(2026, 1, 4)), (" 20260104 ", date(2026, 1, 4)), ("20240230", None), ("2024115", None),
    ("", None), ("00000101", None), ("2024-1-1", None)])
def test_to_ymd(spark, text, want):
    assert value(spark, text, fx.to_ymd) == want


def test_zero_tenths_are_missing(spark):
    assert value(spark, "550", fx.to_tenths) == 55.0
    assert value(spark, "000", fx.to_tenths) is None


def test_wide_text(spark):
    assert value(spark, "　馬　名 ", fx.wide) == "馬名"
    assert value(spark, " \xa0 x\x1c", fx.strip) == "x"


def test_signed_change(spark):
    assert value(spark, "+10", fx.signed_change) == 10
    assert value(spark, " -4", fx.signed_change) == -4
    assert value(spark, "- 4", fx.signed_change) is None


@pytest.mark.parametrize("year, want", [(0, 2000), (50, 2050), (51, 1951), (99, 1999)])
def test_full_year(spark, year, want):
    assert spark.range(1).select(fx.full_year(F.lit(year))).first()[0] == want


@pytest.mark.parametrize("key, want", [("06261101", ("06", 2026, 1, 1, 1)), ("05240305", ("05", 2024, 0, 3, 5))])
def test_race_key(spark, key, want):
    parts = fx.race_key_parts(F.col("t"))
    row = spark.createDataFrame([(key,)], "t string").select(*parts.values(), fx.bad_race_key(F.col("t"))).first()
    assert tuple(row) == (*want, False)


@pytest.mark.parametrize("key", ["0626110", "06261a01", "06X61101", "", None])
def test_bad_race_key(spark, key):
    assert spark.createDataFrame([(key,)], "t string").select(fx.bad_race_key(F.col("t"))).first()[0]


def test_run_key_round_trip(spark):
    row = spark.createDataFrame([("23107385", date(2025, 12, 7))], "h string, d date") \
        .select(fx.run_key(F.col("h"), F.col("d")).alias("k"))
    parts = fx.run_key_parts(F.col("k"))
    assert tuple(row.select("k", *parts.values()).first()) == ("2310738520251207", "23107385", date(2025, 12, 7))


@pytest.mark.parametrize("grade, condition, want", [
    ("1", "OP", "G1"), ("5", "OP", "Listed"), ("4", "OP", "Open"), ("", "A3", "A3"), ("6", "04", "04")])
def test_race_class(spark, grade, condition, want):
    assert spark.range(1).select(fx.race_class(F.lit(grade), F.lit(condition))).first()[0] == want


@pytest.mark.parametrize("size, want", [
    (512, "512.00 B"), (1024, "1.00 KB"), (1024**2, "1.00 MB"), (1024**3, "1.00 GB"), (1024**4, "1.00 TB"),
    (1536, "1.50 KB"), (5 * 1024**4, "5.00 TB")])
def test_byte_label(spark, size, want):
    assert spark.range(1).select(derive.byte_label(F.lit(size).cast("bigint"))).first()[0] == want


def test_code_tables(spark):
    rows = codes.code_rows()
    assert len({(t, c) for t, c, _ in rows}) == len(rows)
    assert len({t for t, _, _ in rows}) == 24
    table = codes.class_table()
    assert len(table) == 48 and table["38"] == "ダート未勝利C" and table["57"] == "障害1勝クラスA"
    df = spark.createDataFrame([("05", 1), ("99", 9), (None, None)], "venue string, mark int")
    got = codes.decode_codes(df, {"venue": "venue", "mark": "mark"}).collect()
    assert {(r.venue_label, r.mark_label) for r in got} == {("東京", "◎"), (None, "☆"), (None, None)}


def test_class_parts_follow_the_class_table(spark):
    df = spark.createDataFrame([(int(c), label) for c, label in codes.class_table().items()], "code long, label string")
    parts = derive.class_parts(F.col("code"))
    prefix = {"turf": "芝", "dirt": "ダート", "jump": "障害"}
    step = {"open": "OP", "3win": "3勝クラス", "2win": "2勝クラス", "1win": "1勝クラス", "maiden": "未勝利"}
    for row in df.select("label", *[c.alias(n) for n, c in parts.items()]).collect():
        assert row.label == prefix[row.surface] + step.get(row.grade, row.grade) + (row.sub_grade or "")
