"""Queries: whole records of every type, all code tables, loading from bytes, and report contents.

The lines of the whole-record queries are drawn from digests, with blanks,
points and signs among the digits, so every slice of every layout sees good,
blank and broken values. SQL cuts the same line by positions of its own, written
out below from the published formats and not taken from the layouts under test.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from furlong.functions import codes, derive
from furlong.operators import joins as jn, quality as qc
from furlong.plans import standin
from furlong.plans.queries_ingest import PROGRAMME_KEY
from furlong.plans.queries_quality import AS_OF, CHECKS, CHECKS_SQL, _results, _tables
from furlong.plans.registry import load, query
from furlong.session import shared_dir
from furlong.sources import files as fs, fixed_width as fw
from furlong.sources.layouts import LAYOUTS
from furlong.sources.schemas import required_columns, table_schema
from furlong.sources.tables import read_table
from furlong.streaming.ingest import ingest_files

DRAWN = ("abcdef", "  .-+ ")
SQL_TYPES = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.TimestampType: "TIMESTAMP"}

# -- whole records -----------------------------------------------------------------------


def drawn(key: str, text_type: str, length: int) -> str:
    """SQL for pseudo-random text of at least ``length`` characters; both engines read it."""
    digests = " || ".join(f"md5(CAST({key} AS {text_type}) || '{i}')" for i in range(-(-length // 32)))
    return f"translate({digests}, '{DRAWN[0]}', '{DRAWN[1]}')"


def drawn_text(key: str, length: int) -> Column:
    """The same text on Spark, a letter of the digests at a time: ``translate`` makes a string of every character."""
    digests = F.concat(*[F.md5(F.concat(F.col(key).cast("string"), F.lit(str(i)))) for i in range(-(-length // 32))])
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), zip(*DRAWN), digests)


def composed(body: str, length: int, fixed: dict[tuple[int, int], str]) -> str:
    """SQL for a line: ``body`` with some slices replaced."""
    parts, at = [], 0
    for (start, end), value in sorted(fixed.items()):
        if start > at:
            parts.append(f"substr({body}, {at + 1}, {start - at})")
        parts.append(value)
        at = end
    return " || ".join([*parts, f"substr({body}, {at + 1}, {length - at})"])


def read_sql(kind: str, start: int, end: int) -> str:
    text = f"substr(line, {start + 1}, {end - start})"
    plain, whole = f"trim({text})", "'[+-]?[0-9]+'"
    number = f"CASE WHEN regexp_full_match({plain}, {whole}) THEN {plain}::BIGINT END"
    signed = f"trim(replace({plain}, '+', ''))"
    return {
        "int": number, "str": plain, "opt": f"nullif({plain}, '')", "wide": f"nullif({plain}, '')", "raw": text,
        "dbl": f"CASE WHEN regexp_full_match({plain}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN {plain}::DOUBLE END",
        "date": f"CASE WHEN regexp_full_match({plain}, '[0-9]{{8}}') AND {plain}[1:4] <> '0000' THEN try_strptime({plain}, '%Y%m%d')::DATE END",
        "tenths": f"nullif({number}, 0) / 10.0::DOUBLE",
        "change": f"CASE WHEN regexp_full_match({signed}, {whole}) THEN {signed}::BIGINT END",
    }[kind]


def labels_sql(column: str, mapping: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


DIRECTION_SQL = "CASE _direction WHEN '1' THEN 'right' WHEN '2' THEN 'left' ELSE 'straight' END"
GRADE_SQL = "CASE _grade WHEN '1' THEN 'G1' WHEN '2' THEN 'G2' WHEN '3' THEN 'G3' WHEN '5' THEN 'Listed' END"
DERIVED_SQL = {
    "race_info": {
        "venue_code": "substr(race_id, 1, 2)", "venue_name": labels_sql("substr(race_id, 1, 2)", codes.VENUE, "''"),
        "race_number": "substr(race_id, 7, 2)::BIGINT", "course_type": labels_sql("_surface", codes.SURFACE),
        "direction": DIRECTION_SQL,
        "race_class": f"coalesce({GRADE_SQL}, CASE WHEN _condition = 'OP' THEN 'Open' ELSE _condition END)",
        "num_horses": "nullif(regexp_extract(trim(substr(line, 81)), '([0-9]{1,2})[ ]?([0-9]{1,2})(?:[^0-9]*)$', 1), '')::BIGINT"},
    "race_results": {"course_type": labels_sql("_surface", codes.SURFACE), "direction": DIRECTION_SQL,
                     "track_condition": labels_sql("_going", codes.GOING), "grade": GRADE_SQL},
    "horse_master": {"sex": labels_sql("_sex", codes.SEX)},
    "venue_info": {
        "venue_id": "venue_code || _year || kai::VARCHAR || day", "year": "CASE WHEN _year::BIGINT <= 50 THEN 2000 ELSE 1900 END + _year::BIGINT",
        "venue_name": f"coalesce(_name, {labels_sql('venue_code', codes.VENUE)}, '')"},
}

# Key in SQL of either engine, source table, and the slices that must be readable.
RECORDS = {
    "BAA": ("orders", "o_orderkey", 120, {(0, 8): "lpad(CAST(k AS {t}), 8, '0')", (8, 16): "ymd", (24, 25): "CAST(k % 4 AS {t})",
                                          (25, 26): "CAST(k % 4 AS {t})", (29, 31): "CASE WHEN k % 3 = 0 THEN 'OP' ELSE 'A3' END",
                                          (35, 36): "CAST(k % 7 AS {t})"}),
    "KYF": ("orders", "o_orderkey", 400, {(0, 8): "lpad(CAST(k AS {t}), 8, '0')", (8, 10): "lpad(CAST(k % 18 + 1 AS {t}), 2, '0')",
                                          (10, 18): "CASE WHEN k % 9 = 0 THEN '        ' ELSE lpad(CAST(k % 500 AS {t}), 8, '0') END"}),
    "SEC": ("orders", "o_orderkey", 280, {(0, 8): "lpad(CAST(k AS {t}), 8, '0')", (8, 10): "lpad(CAST(k % 18 + 1 AS {t}), 2, '0')",
                                          (18, 26): "ymd", (48, 49): "CAST(k % 4 AS {t})", (49, 50): "CAST(k % 4 AS {t})",
                                          (51, 53): "CAST(k % 4 + 1 AS {t}) || CAST(k % 3 AS {t})", (61, 62): "CAST(k % 7 AS {t})"}),
    "UKC": ("orders", "o_orderkey", 180, {(0, 8): "lpad(CAST(k AS {t}), 8, '0')", (26, 27): "CAST(k % 5 AS {t})", (85, 93): "ymd"}),
    "KKA": ("orders", "o_orderkey", 310, {(0, 8): "'06' || CAST(k % 90 + 10 AS {t}) || lpad(CAST(k % 10000 AS {t}), 4, '0')",
                                          (8, 10): "lpad(CAST(k % 18 + 1 AS {t}), 2, '0')"}),
    "KAA": ("orders", "o_orderkey", 46, {(0, 6): "lpad(CAST(k % 12 + 1 AS {t}), 2, '0') || CAST(k % 90 + 10 AS {t}) || CAST(k % 9 + 1 AS {t}) || 'a'",
                                         (6, 14): "ymd"}),
}


def record_line(kind: str, text_type: str) -> str:
    _, _, length, fixed = RECORDS[kind]
    return composed("body", length, {at: sql.format(t=text_type) for at, sql in fixed.items()})


# The published positions again, for SQL alone, by how a field is read. ``?`` asks for a character behind the
# field, ``>=n`` for a line of n characters.
POSITIONS = {
    "BAA": """
str race_id 0 8, age_condition 27 29, _condition 29 31, sex_condition 31 34, _grade 35 36, race_name 36 86
date race_date 8 16
int distance 20 24
raw _surface 24 25, _direction 25 26""",
    "KYF": """
str race_id 0 8, horse_id 10 18
int horse_number 8 10, running_style 73 74, distance_aptitude 76 77, base_popularity 83 85, base_place_popularity 89 91
opt horse_name 18 36
dbl idm 36 41, jockey_index 41 46, info_index 46 51, total_index 67 72, base_odds 78 83, base_place_odds 86 91
int? specific_mark_circle 93 94, specific_mark_circle2 94 95, specific_mark_triangle 95 96, specific_mark_triangle2 96 97, specific_mark_x 97 98
int? total_mark_circle 98 99, total_mark_circle2 99 100, total_mark_triangle 100 101, total_mark_triangle2 101 102, total_mark_x 102 103
int? popularity_index 103 106, training_arrow_code 116 117, stable_eval_code 117 118, surge_index 123 126, hoof_code 126 128
dbl? training_index 106 111, stable_index 111 116, jockey_expected_win_rate 118 123
int? heavy_aptitude_code 128 129, class_code 129 131, apprentice_class 162 163, bracket_number 251 252
opt? blinker 131 132, jockey_name 153 159, trainer_name 163 169, trainer_affiliation 169 171
tenths? weight_carried 159 162
opt? prev_race_key_1 171 187, prev_race_key_2 187 203, prev_race_key_3 203 219, prev_race_key_4 219 235, prev_race_key_5 235 251
int? overall_mark 286 287, idm_mark 287 288, info_mark 288 289, jockey_mark 289 290, stable_mark 290 291, training_mark 291 292, surge_mark 292 293
opt? turf_aptitude 293 294, dirt_aptitude 294 295, jockey_code 295 300, trainer_code 300 305
int? prize_money 305 310, earned_prize 310 315, condition_class 315 316
dbl? ten_index 326 331, pace_index 331 336, agari_index 336 341, position_index 342 346
opt? pace_forecast 346 347, development_code 363 364, owner_name 379 399
int? mid_position 348 350, mid_gap 350 352, mid_inside_outside 352 353, last_3f_position 353 355, last_3f_gap 355 357, last_3f_inside_outside 357 358
int? goal_position 358 360, goal_gap 360 362, goal_inside_outside 362 363, confirmed_weight 373 376, confirmed_weight_diff 376 379, sex_code 363 364""",
    "SEC": """
str race_id 0 8, horse_id 10 18, _grade 61 62
int horse_number 8 10, distance 44 48, num_horses 87 89, finish_position 93 95, abnormal_code 95 96, win_popularity 121 123
date race_date 18 26
opt horse_name 26 44, race_type 53 55, race_condition 55 57, race_name 62 87, jockey_name 103 109, trainer_name 109 115
raw _surface 48 49, _direction 49 50, _going 51 53
tenths finish_time 96 100, weight_carried 100 103
dbl win_odds 115 121, idm 123 126, raw_score 126 129, track_bias 129 132, pace 132 135, late_start 135 138, position_fault 138 141
dbl disadvantage 141 144, front_disadvantage 144 147, mid_disadvantage 147 150, back_disadvantage 150 153, race_score 153 156
int course_position 156 157, improvement_code 157 158, class_code 158 160, body_code 160 161, condition_code 161 162
opt? race_pace 162 163, horse_pace 163 164, winner_name 184 190, remarks 199 211
dbl? ten_index 164 169, agari_index 169 174, pace_index 174 179, race_pace_index 179 184
tenths? winner_time_diff 190 193, front_3f_time 193 196, last_3f_time 196 199
dbl>=260 odds_10am_win 219 225, odds_10am_place 225 231
int>=270 horse_weight 261 264, weather_code 267 268
change>=270 horse_weight_diff 264 267
opt>=270 course_code 268 269, race_running_style 269 270""",
    "UKC": """
str horse_id 0 8
opt horse_name 8 26, sire_name 31 49, dam_name 49 67, broodmare_sire_name 67 85
int sex_code 26 27, coat_color_code 27 29, horse_symbol_code 29 31, sire_birth_year 93 97, dam_birth_year 97 101, broodmare_sire_birth_year 101 105
raw _sex 26 27
date birth_date 85 93
opt? owner_name 105 125, breeder_name 127 147, birthplace 147 151, sire_line_code 160 164, broodmare_sire_line_code 164 168
int? owner_club_code 125 127, deletion_flag 151 152
date? data_date 152 160""",
    "KKA": """
str race_id 0 8
int horse_number 8 10
counters jra 10 22, exchange 22 34, other 34 46, surface 46 58, surface_dist 58 70, track_dist 70 82, rotation 82 94, direction 94 106
counters jockey 106 118, good 118 130, slightly_heavy 130 142, heavy 142 154, slow_pace 154 166, medium_pace 166 178, high_pace 178 190
counters season 190 202, bracket 202 214, jockey_dist 214 226, jockey_track_dist 226 238, jockey_trainer 238 250, jockey_owner 250 262
counters jockey_blinker 262 274, trainer_owner 274 286
int sire_turf_place_rate 286 289, sire_dirt_place_rate 289 292, sire_avg_place_distance 292 296
int broodmare_sire_turf_place_rate 296 299, broodmare_sire_dirt_place_rate 299 302, broodmare_sire_avg_place_distance 302 306""",
    "KAA": """
str venue_code 0 2, _year 2 4, day 5 6
int kai 4 5, region_code 14 15, weather_code 18 19, turf_condition_code 19 21, turf_condition_inner 21 22, turf_condition_middle 22 23
date race_date 6 14
opt _name 16 18, day_of_week 15 16
int turf_condition_outer 23 24, turf_bias 24 27, straight_bias_innermost 27 29, straight_bias_inner 29 31, straight_bias_middle 31 33
int straight_bias_outer 33 35, straight_bias_outermost 35 37, dirt_condition_code 37 39, dirt_condition_inner 39 40, dirt_condition_middle 40 41
int dirt_condition_outer 41 42, dirt_bias 42 45, data_category 45 46""",
}


def fields_sql(positions: str) -> dict[str, str]:
    """SQL of every field of a record."""
    out = {}
    for row in positions.strip().splitlines():
        how, _, fields = row.partition(" ")
        kind, _, floor = how.rstrip("?").partition(">=")
        for field in fields.split(", "):
            name, start, end = field.split()
            if kind == "counters":
                # a cut group has no counter at all
                for i, counter in enumerate(("win", "place", "show", "out")):
                    out[f"{name}_{counter}"] = f"CASE WHEN length(line) >= {end} THEN {read_sql('int', int(start) + 3 * i, int(start) + 3 * i + 3)} END"
                continue
            least = floor or (int(end) + 1 if how.endswith("?") else "")
            value = read_sql(kind, int(start), int(end))
            out[name] = f"CASE WHEN length(line) >= {least} THEN {value} END" if least else value
    return out


def record_sql(kind: str) -> str:
    table, key, length, _ = RECORDS[kind]
    layout = LAYOUTS[kind]
    schema = table_schema(layout.table)
    fields = fields_sql(POSITIONS[kind])
    fields.pop("line", None)
    columns = {n: n for n in fields} | DERIVED_SQL.get(layout.table, {})
    if layout.table == "horse_extended":
        columns["race_date"] = "file_date"
    out = ", ".join(f'{columns[f.name]} AS "{f.name}"' if f.name in columns else f'CAST(NULL AS {SQL_TYPES[type(f.dataType)]}) AS "{f.name}"'
                    for f in schema)
    keep = " AND ".join(f'"{c}" IS NOT NULL' for c in required_columns(schema))
    read = ", ".join(f'{v} AS "{n}"' for n, v in fields.items())
    return f"""
WITH b AS (SELECT {key} AS k, o_orderdate::DATE AS file_date, strftime(o_orderdate, '%Y%m%d') AS ymd, {drawn(key, 'VARCHAR', length)} AS body FROM {table}),
l AS (SELECT k, file_date, {record_line(kind, 'VARCHAR')} AS line FROM b),
r AS (SELECT k, file_date, line, {read} FROM l),
o AS (SELECT k AS source_key, {out} FROM r)
SELECT * FROM o WHERE {keep}"""


def record_rows(spark, sf, kind: str) -> DataFrame:
    table, key, length, _ = RECORDS[kind]
    rows = load(spark, sf, table).select(F.col(key).alias("k"), F.col("o_orderdate").cast("date").alias("file_date"),
                                         F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"))
    # the keys are dealt out and not the lines, so that every core draws and the long lines stay where they are
    lines = standin.spread(rows).withColumn("body", drawn_text("k", length)) \
        .select(F.col("k").alias("source_key"), "file_date", standin.as_lines(F.expr(record_line(kind, "STRING")))).where("line <> ''")
    layout = LAYOUTS[kind]
    ok, _ = fw.split_required(fw.parse_lines(lines, kind))
    names = table_schema(layout.table).names
    return ok.select("source_key", *[F.col(c).cast("timestamp_ntz").alias(c) if c in ("created_at", "updated_at") else F.col(c) for c in names])


for _kind, _name in (("BAA", "programme"), ("KYF", "entries"), ("SEC", "results"), ("UKC", "horses"), ("KKA", "records"), ("KAA", "meetings")):
    query(f"whole_{_name}", record_sql(_kind))(lambda spark, sf, kind=_kind: record_rows(spark, sf, kind))


@query("odds_rows", """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3),
b(odds_type, n, f) AS (VALUES ('win', 18, 7), ('place', 18, 3), ('quinella', 153, 11)),
slots AS (SELECT odds_type, f, unnest(range(n)) AS i FROM b),
pairs AS (SELECT row_number() OVER (ORDER BY a, c) - 1 AS i, a, c
          FROM (SELECT unnest(range(1, 19)) AS a) CROSS JOIN (SELECT unnest(range(1, 19)) AS c) WHERE a < c)
SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS race_id, 18::BIGINT AS num_horses, s.odds_type, coalesce(p.a, s.i + 1) AS first_number,
  p.c AS second_number, ((o_orderkey * f + s.i * 13) % 900 + 10) / 10.0::DOUBLE AS odds_value
FROM orders CROSS JOIN slots s LEFT JOIN pairs p ON s.odds_type = 'quinella' AND p.i = s.i WHERE (o_orderkey + s.i) % 10 <> 0""".replace(
    "WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3),\n", "WITH "))
def odds_rows(spark, sf):
    from furlong.sources.odds import explode_odds

    return explode_odds(standin.odds_lines(spark, sf))


# -- code tables -----------------------------------------------------------------------------

TABLE_NAMES = sorted({table for table, _, _ in codes.code_rows()})
PROBE_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9)::VARCHAR WHEN o_orderkey % 3 = 1 THEN lpad((o_orderkey // 3 % 100)::VARCHAR, 2, '0') ELSE lpad((o_orderkey // 3 % 800)::VARCHAR, 3, '0') END"


@query("code_tables", f"""
WITH d(code_table, code, label) AS (VALUES {", ".join(f"('{t}', '{c}', '{label}')" for t, c, label in codes.code_rows())}),
k AS (SELECT o_orderkey, {PROBE_SQL} AS code FROM orders)
SELECT o_orderkey, code, {", ".join(f"(SELECT max(label) FROM d WHERE code_table = '{t}' AND d.code = k.code) AS {t}_label" for t in TABLE_NAMES)}
FROM k""")
def code_tables(spark, sf):
    k = F.col("o_orderkey")
    third = F.floor(k / 3)
    code = F.when(k % 3 == 0, (k % 9).cast("string")).when(k % 3 == 1, standin.digits(third % 100, 2)).otherwise(standin.digits(third % 800, 3))
    rows = load(spark, sf, "orders").select("o_orderkey", code.alias("code")).withColumns({t: F.col("code") for t in TABLE_NAMES})
    return codes.decode_codes(rows, {t: t for t in TABLE_NAMES}).drop(*TABLE_NAMES)


@query("draw_x_venue", """
SELECT o_orderkey, CASE WHEN o_orderkey % 18 + 1 <= 6 THEN 'inner' WHEN o_orderkey % 18 + 1 <= 12 THEN 'middle' ELSE 'outer' END
  || '_' || lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') AS draw_x_venue FROM orders JOIN customer ON o_custkey = c_custkey""")
def draw_x_venue(spark, sf):
    rows = standin.orders_with_nation(spark, sf)
    side = derive.relative_draw(F.col("o_orderkey") % 18 + 1, F.lit(18))["draw_side"]
    venue = standin.digits(F.col("c_nationkey") % 10 + 1, 2)
    return rows.select("o_orderkey", F.concat_ws("_", side, venue).alias("draw_x_venue"))


# -- rejects, unions, checks -----------------------------------------------------------------------

@query("first_errors", f"""
WITH l AS (SELECT o_orderkey, o_orderkey % 17 = 0 AS damaged, o_orderkey % 19 = 0 AS short FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'BAA' || lpad((o_orderkey % 100)::VARCHAR, 6, '0') || '.csv' AS path, o_orderkey AS line_no,
  CASE WHEN short THEN 'line too short' ELSE 'bad race key' END AS reject_reason
FROM l WHERE damaged OR short ORDER BY path, line_no LIMIT 5""")
def first_errors(spark, sf):
    n = F.col("source_key")
    lines = standin.programme_lines(spark, sf).withColumn("path", F.concat(F.lit("BAA"), standin.digits(n % 100, 6), F.lit(".csv"))) \
        .withColumn("line_no", n)
    return fw.first_errors(fw.split_required(fw.parse_lines(lines, "BAA"))[1]).select("path", "line_no", "reject_reason")


@query("union_types", f"""
SELECT o_orderkey % 2 = 0 AS even, {PROGRAMME_KEY} AS race_id, o_orderdate::DATE AS race_date
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0""")
def union_types(spark, sf):
    types = [t for t, layout in LAYOUTS.items() if layout.table == "race_info"]
    lines = standin.programme_lines(spark, sf)
    parts = [fw.split_required(fw.parse_lines(lines.where(F.col("source_key") % 2 == half), types[half % len(types)]))[0] for half in (0, 1)]
    return fw.union_types(parts).select((F.col("source_key") % 2 == 0).alias("even"), "race_id", "race_date")


@query("quality_selected", f"""
WITH {CHECKS_SQL} SELECT check_name, passed, severity FROM res WHERE table_name = 'raw.lineitem'""")
def quality_selected(spark, sf):
    checks = qc.select_checks("raw.lineitem", CHECKS)
    return qc.run_checks(spark, _tables(spark, sf), checks, AS_OF).select("check_name", "passed", "severity")


@query("quality_rules", f"""
WITH {CHECKS_SQL}, r(name, description, severity) AS (VALUES {", ".join(f"('{r.name}', '{r.description}', '{r.severity}')" for r in qc.RULES)})
SELECT r.name, r.description, r.severity, count(check_name) AS checks, count(*) FILTER (passed) AS passed
FROM r LEFT JOIN res ON check_name = name GROUP BY ALL""")
def quality_rules(spark, sf):
    results = _results(spark, sf).select(F.col("check_name").alias("name"), "passed")
    return qc.rule_registry(spark).join(results, "name", "left").groupBy("name", "description", "severity").agg(
        F.count("passed").alias("checks"), F.count_if("passed").alias("passed"))


@query("quality_numbers", """
SELECT 'raw.orders' AS table_name, 'o_totalprice' AS subject, min(o_totalprice) AS low, max(o_totalprice) AS high,
  round(avg(o_totalprice), 4) AS mean FROM orders
UNION ALL SELECT 'raw.lineitem', 'l_quantity', min(l_quantity), max(l_quantity), round(avg(l_quantity), 4) FROM lineitem
UNION ALL SELECT 'raw.lineitem', 'l_discount', min(l_discount), max(l_discount), round(avg(l_discount), 4) FROM lineitem
UNION ALL SELECT 'raw.customer', 'c_acctbal', min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4) FROM customer""")
def quality_numbers(spark, sf):
    d = F.col("details")
    return _results(spark, sf).where("check_name = 'numeric_range_check'").select(
        "table_name", d["column"].alias("subject"), d["min_val"].cast("double").alias("low"), d["max_val"].cast("double").alias("high"),
        F.round(d["avg_val"].cast("double"), 4).alias("mean"))


@query("report_results", f"""
WITH {CHECKS_SQL} SELECT '20260104_120000' AS report_id, table_name, check_name, passed, severity, subject,
  (SELECT count(*) FILTER (passed) FROM res) AS passed_checks,
  CASE WHEN (SELECT count(*) FROM res WHERE NOT passed AND severity = 'ERROR') > 0 THEN 'FAILED'
    WHEN (SELECT count(*) FROM res WHERE NOT passed AND severity = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM res""")
def report_results(spark, sf):
    report = qc.report(_results(spark, sf), "demo", datetime(2026, 1, 4, 12, 0, 0))
    rows = report.select("report_id", "status", F.col("summary.passed_checks").alias("passed_checks"), F.inline("results"))
    return rows.select("report_id", "table_name", "check_name", "passed", "severity", "passed_checks", "status",
                       F.get_json_object("details", "$.column").alias("subject"))


@query("odds_before_start", """
WITH u AS (SELECT user_id, event_type, min(ts)::DATE AS day, min(ts) + INTERVAL 30 HOUR AS start FROM events GROUP BY 1, 2)
SELECT u.user_id, u.event_type, max_by(value, ts) FILTER (ts <= day::TIMESTAMP - INTERVAL 1 SECOND) AS odds_yesterday,
  max_by(value, ts) FILTER (ts <= day::TIMESTAMP + INTERVAL 10 HOUR) AS odds_today,
  max_by(value, ts) FILTER (ts <= start - INTERVAL 15 MINUTE) AS odds_last
FROM u LEFT JOIN events e ON u.user_id = e.user_id AND u.event_type = e.event_type GROUP BY 1, 2""")
def odds_before_start(spark, sf):
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first")) \
        .select("user_id", "event_type", F.col("first").cast("date").alias("day"),
                (F.col("first") + F.make_dt_interval(hours=F.lit(30))).alias("start"))
    cuts = jn.race_cutoffs(F.col("day"), F.col("start"))
    return jn.odds_as_of(first, events, ["user_id", "event_type"], cuts, "value", "ts").drop("day", "start")


# -- from bytes to tables ----------------------------------------------------------------------------

#: Records of a file; the number of files grows with the table.
PER_FILE = 250


def _landing(spark, sf) -> str:
    """Horse records written as files: one in three in the other charset, some with a wrong name, no line feed at the end."""
    line = F.col("line")
    lines = standin.horse_lines(spark, sf).withColumn("key", F.substring(line, 1, 8).cast("bigint"))
    n = F.floor(F.col("key") / PER_FILE)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 8000).cast("int")), "yyMMdd")
    name = F.when(F.col("key") % 30 == 29, F.concat(F.lit("horses"), n.cast("string"), F.lit(".csv"))) \
        .otherwise(F.concat(F.lit("UKC"), day, F.lit(".csv")))
    # a record without a horse id is kept: only NULL is refused
    cut = F.when(F.col("key") % 50 == 7, F.substring(line, 1, 20)).otherwise(line)
    coded = F.when(n % 3 == 0, F.encode(cut, "windows-31j")).otherwise(F.encode(cut, "UTF-8"))
    folder = f"{shared_dir(spark)}/landing-{uuid4().hex}"
    # bytes go through the text writer as they are; a file is one task's
    lines.select(F.floor(n / 8000).alias("part"), name.alias("name"), "key", coded.cast("string").alias("value")) \
        .repartition("part", "name").sortWithinPartitions("part", "name", "key") \
        .select("part", "name", "value").write.partitionBy("part", "name").option("lineSep", "\n").text(folder)
    _rename(spark, folder)
    return folder


def _rename(spark, folder: str) -> None:
    """Give the written files the names of their folders; a stand-in for the delivery of files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part=*/name=*/part-*"))
    for status in found or []:
        own = status.getPath()
        store.rename(own, jvm.org.apache.hadoop.fs.Path(own.getParent(), own.getParent().getName().removeprefix("name=")))


def _loaded(spark, sf) -> str:
    root = f"{shared_dir(spark)}/load-{uuid4().hex}"
    ingest_files(spark, _landing(spark, sf), root, datetime(2026, 1, 4, 12, 0, 0))
    return root


BYTES_SQL = f"""
f AS (SELECT *, p_partkey % 30 = 29 AS misnamed, p_partkey % 50 = 7 AS cut,
  CASE WHEN p_partkey % 30 = 29 THEN 'horses' || p_partkey // {PER_FILE} || '.csv'
    ELSE 'UKC' || strftime(DATE '2024-01-01' + (p_partkey // {PER_FILE} % 8000)::INTEGER, '%y%m%d') || '.csv' END AS path FROM part)"""


@query("load_bytes", f"""
WITH {BYTES_SQL} SELECT lpad(p_partkey::VARCHAR, 8, '0') AS horse_id, trim(p_name) AS horse_name, p_brand AS sire_name,
  'owner' || p_size AS owner_name, '浦河' AS birthplace, TIMESTAMP '2026-01-04 12:00:00' AS created_at
FROM f WHERE NOT misnamed AND NOT cut""")
def load_bytes(spark, sf):
    return read_table(spark, _loaded(spark, sf), "horse_master").select(
        "horse_id", "horse_name", "sire_name", "owner_name", "birthplace", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("load_bytes_log", f"""
WITH {BYTES_SQL} SELECT path, CASE WHEN NOT misnamed AND count(*) > count(*) FILTER (cut) THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN NOT misnamed THEN count(*) FILTER (NOT cut) ELSE 0 END AS records,
  CASE WHEN NOT misnamed THEN count(*) FILTER (cut) ELSE 0 END AS rejected,
  CASE WHEN misnamed THEN 'Invalid filename format' WHEN count(*) = count(*) FILTER (cut) THEN 'No data parsed' END AS error
FROM f GROUP BY path, misnamed, p_partkey // {PER_FILE} // 8000""")
def load_bytes_log(spark, sf):
    log = spark.read.parquet(f"{_loaded(spark, sf)}/_log")
    return log.select(fs.base_name(F.col("path")).alias("path"), "status", "records", "rejected", "error")
