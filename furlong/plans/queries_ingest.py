"""Queries: scans, record parsing, scalar fields, files, links, upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from furlong.functions import codes, derive, fields as fx
from furlong.plans import standin
from furlong.plans.registry import load, query
from furlong.sources import files as fs, pages as pg, tables as tb
from furlong.sources.fixed_width import decode_bytes, load_log, parse_lines, split_required
from furlong.sources.layouts import read_fields, read_layout
from furlong.sources.odds import explode_odds

TS = datetime(2026, 1, 4, 12, 0, 0)


@query("fixed_width_lineitem", """
SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line_number, l_quantity AS quantity,
       l_extendedprice AS price, l_returnflag AS flag FROM lineitem""")
def fixed_width_lineitem(spark, sf):
    line = F.concat(standin.digits("l_orderkey", 8), standin.digits("l_linenumber", 2),
                    standin.digits(F.round(F.col("l_quantity") * 10), 5),
                    F.lpad(F.format_string("%.2f", "l_extendedprice"), 12, " "), F.col("l_returnflag"))
    layout = read_layout("""
        order_key 0 8 int
        line_number 8 10 int
        quantity 10 15 tenths
        price 15 27 dbl
        flag 27 28 opt""")
    lines = load(spark, sf, "lineitem").select(standin.as_lines(line)).where(fx.strip(F.col("line")) != "")
    return read_fields(lines, layout)


PROGRAMME_KEY = """
  lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') || strftime(o_orderdate, '%y')
  || (o_orderkey % 9 + 1)::VARCHAR || (o_orderkey % 10)::VARCHAR
  || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0')"""


@query("ingest_programme", f"""
SELECT o_orderkey AS source_key, {PROGRAMME_KEY} AS race_id, o_orderdate::DATE AS race_date,
  lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') AS venue_code,
  ['札幌','函館','福島','新潟','東京','中山','中京','京都','阪神','小倉'][c_nationkey % 10 + 1] AS venue_name,
  o_orderkey % 12 + 1 AS race_number, o_orderpriority AS race_name,
  CASE o_orderkey % 4 WHEN 1 THEN 'turf' WHEN 2 THEN 'dirt' WHEN 3 THEN 'obstacle' END AS course_type,
  1000 + o_orderkey % 20 * 100 AS distance,
  CASE o_orderkey % 4 WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'straight' END AS direction,
  CASE o_orderkey % 7 WHEN 1 THEN 'G1' WHEN 2 THEN 'G2' WHEN 3 THEN 'G3' WHEN 5 THEN 'Listed'
    ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'Open' ELSE 'A3' END END AS race_class,
  '12' AS age_condition, o_orderstatus AS sex_condition, o_orderkey % 18 + 1 AS num_horses,
  TIMESTAMP '2026-01-04 12:00:00' AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0""")
def ingest_programme(spark, sf):
    ok, _ = split_required(parse_lines(standin.programme_lines(spark, sf), "BAA", TS))
    return ok.select("source_key", "race_id", "race_date", "venue_code", "venue_name", "race_number", "race_name",
                     "course_type", "distance", "direction", "race_class", "age_condition", "sex_condition",
                     "num_horses", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("ingest_rejects", """
SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'line too short' ELSE 'bad race key' END AS reject_reason,
       count(*) AS lines
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 GROUP BY 1""")
def ingest_rejects(spark, sf):
    _, rejects = split_required(parse_lines(standin.programme_lines(spark, sf), "BAA"))
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("lines"))


@query("ingest_entries", """
SELECT lpad(l_orderkey::VARCHAR, 8, '0') AS race_id, l_linenumber::BIGINT AS horse_number,
  lpad(l_partkey::VARCHAR, 8, '0') AS horse_id, '馬' || l_partkey AS horse_name, l_quantity AS idm,
  -l_discount AS jockey_index, l_partkey % 7 AS running_style, 8::BIGINT AS distance_aptitude,
  l_quantity AS base_odds, l_linenumber::BIGINT AS base_popularity, 8.613::DOUBLE AS base_place_odds,
  13::BIGINT AS base_place_popularity, CASE WHEN l_partkey % 2 = 0 THEN 'B' END AS blinker,
  l_returnflag || l_linestatus AS jockey_name,
  CASE WHEN l_partkey % 5 <> 0 THEN (480 + l_partkey % 100) / 10.0::DOUBLE END AS weight_carried,
  l_linestatus AS trainer_name, '美浦' AS trainer_affiliation,
  lpad(l_partkey::VARCHAR, 8, '0') || strftime(l_shipdate, '%Y%m%d') AS prev_race_key_1,
  l_linenumber::BIGINT AS bracket_number, lpad(l_suppkey::VARCHAR, 5, '0') AS jockey_code,
  CAST(NULL AS VARCHAR) AS trainer_code, floor(l_extendedprice / 100)::BIGINT % 100000 AS prize_money,
  round(l_tax * -100, 1) AS ten_index, l_partkey % 3 + 1 AS sex_code, (l_partkey % 3 + 1)::VARCHAR AS development_code,
  400 + l_partkey % 200 AS confirmed_weight, l_partkey % 20 AS confirmed_weight_diff,
  'S' || l_suppkey AS owner_name, CAST(NULL AS BIGINT) AS big_ticket_index
FROM lineitem""")
def ingest_entries(spark, sf):
    ok, _ = split_required(parse_lines(standin.entry_lines(spark, sf), "KYF"))
    return ok.select(
        "race_id", "horse_number", "horse_id", "horse_name", "idm", "jockey_index", "running_style",
        "distance_aptitude", "base_odds", "base_popularity", "base_place_odds", "base_place_popularity", "blinker",
        "jockey_name", "weight_carried", "trainer_name", "trainer_affiliation", "prev_race_key_1", "bracket_number",
        "jockey_code", "trainer_code", "prize_money", "ten_index", "sex_code", "development_code",
        "confirmed_weight", "confirmed_weight_diff", "owner_name", "big_ticket_index")


@query("ingest_results", """
SELECT lpad(l_orderkey::VARCHAR, 8, '0') AS race_id, l_linenumber::BIGINT AS horse_number,
  lpad(l_partkey::VARCHAR, 8, '0') AS horse_id, l_shipdate::DATE AS race_date, '名馬' AS horse_name,
  1000 + l_partkey % 20 * 100 AS distance,
  CASE l_partkey % 4 WHEN 1 THEN 'turf' WHEN 2 THEN 'dirt' WHEN 3 THEN 'obstacle' END AS course_type,
  CASE l_partkey % 3 WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'straight' END AS direction,
  CASE WHEN l_partkey % 2 = 0 THEN '良' END AS track_condition,
  CASE l_partkey % 7 WHEN 1 THEN 'G1' WHEN 2 THEN 'G2' WHEN 3 THEN 'G3' WHEN 5 THEN 'Listed' END AS grade,
  l_partkey % 18 + 1 AS finish_position,
  CASE WHEN l_partkey % 11 <> 0 THEN (700 + l_partkey % 900) / 10.0::DOUBLE END AS finish_time,
  55.0::DOUBLE AS weight_carried, '騎手' AS jockey_name, l_quantity AS win_odds, -12.0::DOUBLE AS idm,
  CASE WHEN l_partkey % 50 <> 0 THEN (l_partkey % 50) / 10.0::DOUBLE END AS winner_time_diff,
  (330 + l_partkey % 90) / 10.0::DOUBLE AS last_3f_time, l_quantity AS odds_10am_win,
  CASE WHEN l_linenumber % 2 = 0 THEN 420 + l_partkey % 100 END AS horse_weight,
  CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 30
       WHEN l_partkey % 30 >= 10 THEN -(l_partkey % 30) END END AS horse_weight_diff,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 6 + 1 END AS weather_code,
  CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 3 = 0 THEN 'A' END AS course_code,
  CAST(NULL AS BIGINT) AS corner_position_1
FROM lineitem""")
def ingest_results(spark, sf):
    ok, _ = split_required(parse_lines(standin.result_lines(spark, sf), "SEC"))
    return ok.select(
        "race_id", "horse_number", "horse_id", "race_date", "horse_name", "distance", "course_type", "direction",
        "track_condition", "grade", "finish_position", "finish_time", "weight_carried", "jockey_name", "win_odds",
        "idm", "winner_time_diff", "last_3f_time", "odds_10am_win", "horse_weight", "horse_weight_diff",
        "weather_code", "course_code", "corner_position_1")


@query("ingest_horses", """
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS horse_id, trim(p_name) AS horse_name, p_partkey % 5 AS sex_code,
  CASE p_partkey % 5 WHEN 1 THEN '牡' WHEN 2 THEN '牝' WHEN 3 THEN 'セン' END AS sex,
  p_partkey % 11 + 1 AS coat_color_code, p_brand AS sire_name, CAST(NULL AS VARCHAR) AS dam_name,
  p_type AS broodmare_sire_name,
  CASE WHEN p_partkey % 9 <> 0 THEN make_date(2000 + p_partkey % 25, 4, 1) END AS birth_date,
  1998::BIGINT AS sire_birth_year, 'owner' || p_size AS owner_name, '浦河' AS birthplace,
  DATE '2024-01-05' AS data_date, (1100 + p_partkey % 30)::VARCHAR AS sire_line_code
FROM part""")
def ingest_horses(spark, sf):
    ok, _ = split_required(parse_lines(standin.horse_lines(spark, sf), "UKC"))
    return ok.select("horse_id", "horse_name", "sex_code", "sex", "coat_color_code", "sire_name", "dam_name",
                     "broodmare_sire_name", "birth_date", "sire_birth_year", "owner_name", "birthplace",
                     "data_date", "sire_line_code")


@query("ingest_records", """
SELECT o_custkey AS source_key, 7::BIGINT AS horse_number,
  count(*) FILTER (o_orderstatus = 'F') AS jra_win, 2 * count(*) FILTER (o_orderstatus = 'F') AS jra_place,
  3 * count(*) FILTER (o_orderstatus = 'F') AS jra_show, 4 * count(*) FILTER (o_orderstatus = 'F') AS jra_out,
  count(*) FILTER (o_orderstatus = 'O') AS exchange_win, 4 * count(*) FILTER (o_orderstatus = 'O') AS exchange_out,
  count(*) FILTER (o_orderstatus = 'P') AS other_win, 3 * count(*) FILTER (o_orderstatus = 'P') AS other_show,
  CAST(NULL AS BIGINT) AS surface_win, 35::BIGINT AS sire_turf_place_rate, 1650::BIGINT AS sire_avg_place_distance
FROM orders GROUP BY 1""")
def ingest_records(spark, sf):
    ok, _ = split_required(parse_lines(standin.record_lines(spark, sf), "KKA"))
    return ok.select("source_key", "horse_number", "jra_win", "jra_place", "jra_show", "jra_out", "exchange_win",
                     "exchange_out", "other_win", "other_show", "surface_win", "sire_turf_place_rate",
                     "sire_avg_place_distance")


@query("ingest_meetings", """
WITH m AS (SELECT DISTINCT c_nationkey AS n, o_orderdate::DATE AS d
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n AS nation, lpad((n % 12 + 1)::VARCHAR, 2, '0') || strftime(d, '%y') || (month(d) % 10)::VARCHAR
    || '0123456789abcdef'[(day(d) % 16) + 1] AS venue_id, d AS race_date,
  lpad((n % 12 + 1)::VARCHAR, 2, '0') AS venue_code,
  CASE WHEN n % 2 = 0 THEN '中山' WHEN n % 12 >= 10 THEN ''
    ELSE ['札幌','函館','福島','新潟','東京','中山','中京','京都','阪神','小倉'][n % 12 + 1] END AS venue_name,
  year(d) AS year, month(d) % 10 AS kai, '0123456789abcdef'[(day(d) % 16) + 1] AS day,
  n % 3 + 1 AS region_code, '土' AS day_of_week, n % 6 + 1 AS weather_code, 10::BIGINT AS turf_condition_code,
  -(n % 20) AS turf_bias, -1::BIGINT AS straight_bias_innermost, 12::BIGINT AS dirt_bias,
  CASE WHEN n % 5 <> 0 THEN n % 4 + 1 END AS data_category
FROM m""")
def ingest_meetings(spark, sf):
    ok, _ = split_required(parse_lines(standin.meeting_lines(spark, sf), "KAA"))
    return ok.select("nation", "venue_id", "race_date", "venue_code", "venue_name", "year", "kai", "day",
                     "region_code", "day_of_week", "weather_code", "turf_condition_code", "turf_bias",
                     "straight_bias_innermost", "dirt_bias", "data_category")


@query("odds_explode", """
WITH b(odds_type, n, f) AS (VALUES ('win', 18, 7), ('place', 18, 3), ('quinella', 153, 11)),
slots AS (SELECT odds_type, f, unnest(range(n)) AS i FROM b),
pairs AS (SELECT row_number() OVER (ORDER BY a, c) - 1 AS i, a, c
          FROM (SELECT unnest(range(1, 19)) AS a) CROSS JOIN (SELECT unnest(range(1, 19)) AS c) WHERE a < c)
SELECT s.odds_type, coalesce(p.a, s.i + 1) AS first_number, p.c AS second_number, count(*) AS races,
  round(sum(((o_orderkey * f + s.i * 13) % 900 + 10) / 10.0::DOUBLE), 2) AS total
FROM orders CROSS JOIN slots s LEFT JOIN pairs p ON s.odds_type = 'quinella' AND p.i = s.i
WHERE (o_orderkey + s.i) % 10 <> 0 GROUP BY 1, 2, 3""")
def odds_explode(spark, sf):
    return explode_odds(standin.odds_lines(spark, sf)) \
        .groupBy("odds_type", "first_number", "second_number") \
        .agg(F.count("*").alias("races"), F.round(F.sum("odds_value"), 2).alias("total"))


@query("decode_text", """
SELECT c_custkey, ['札幌','函館','福島','新潟','東京'][c_nationkey % 5 + 1] || c_name AS text,
       c_custkey % 3 = 2 AS lossy FROM customer WHERE c_custkey % 3 <> 2
UNION ALL
SELECT c_custkey, c_mktsegment || chr(65533), true FROM customer WHERE c_custkey % 3 = 2""")
def decode_text(spark, sf):
    venue = F.element_at(F.array(*[F.lit(v) for v in list(codes.VENUE.values())[:5]]), F.col("c_nationkey") % 5 + 1)
    text = F.concat(venue, F.col("c_name"))
    kind = F.col("c_custkey") % 3
    content = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.encode(text, "windows-31j")) \
        .otherwise(F.concat(F.encode("c_mktsegment", "UTF-8"), F.unhex(F.lit("FF"))))
    decoded = load(spark, sf, "customer").select("c_custkey", decode_bytes(content).alias("text"))
    return decoded.withColumn("lossy", F.col("text").contains("�"))


# -- scalar fields ------------------------------------------------------------

@query("safe_casts", """
WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN '+' || p_size
    WHEN 2 THEN p_size || '.5' WHEN 3 THEN p_name WHEN 4 THEN '  ' ELSE p_size || 'd' END AS t,
  CASE p_partkey % 5 WHEN 0 THEN '202401' || lpad((p_size % 40)::VARCHAR, 2, '0') WHEN 1 THEN ''
    WHEN 2 THEN '2024' ELSE '20240115' END AS d FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN trim(t)::BIGINT END AS as_int,
  CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+([.][0-9]+)?') THEN trim(t)::DOUBLE END AS as_float,
  CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN nullif(trim(t)::BIGINT, 0) / 10.0::DOUBLE END AS tenths,
  nullif(trim(t), '') AS text, CASE WHEN length(d) = 8 THEN try_strptime(d, '%Y%m%d')::DATE END AS as_date
FROM s""")
def safe_casts(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = (F.when(kind == 0, F.concat(F.lit("　"), size, F.lit(" "))).when(kind == 1, F.concat(F.lit("+"), size))
            .when(kind == 2, F.concat(size, F.lit(".5"))).when(kind == 3, F.col("p_name"))
            .when(kind == 4, "  ").otherwise(F.concat(size, F.lit("d"))))
    slot = F.col("p_partkey") % 5
    day = (F.when(slot == 0, F.concat(F.lit("202401"), F.lpad((F.col("p_size") % 40).cast("string"), 2, "0")))
           .when(slot == 1, "").when(slot == 2, "2024").otherwise("20240115"))
    return load(spark, sf, "part").select(
        "p_partkey", fx.to_int(text).alias("as_int"), fx.to_float(text).alias("as_float"),
        fx.to_tenths(text).alias("tenths"), fx.blank_to_null(fx.strip(text)).alias("text"),
        fx.to_ymd(day).alias("as_date"))


@query("race_key_parts", f"""
SELECT o_orderkey, {PROGRAMME_KEY} AS race_id, substr({PROGRAMME_KEY}, 1, 6) AS meeting_id,
  lpad((c_nationkey % 10 + 1)::VARCHAR, 2, '0') AS venue_code,
  CASE WHEN year(o_orderdate) % 100 <= 50 THEN 2000 ELSE 1900 END + year(o_orderdate) % 100 AS year,
  o_orderkey % 9 + 1 AS meeting, o_orderkey % 10 AS day, o_orderkey % 12 + 1 AS race_number,
  lpad((o_orderkey % 1000)::VARCHAR, 8, '0') || strftime(o_orderdate, '%Y%m%d') AS run_key,
  lpad((o_orderkey % 1000)::VARCHAR, 8, '0') AS run_horse, o_orderdate::DATE AS run_date
FROM orders JOIN customer ON o_custkey = c_custkey""")
def race_key_parts(spark, sf):
    key = standin.race_key(F.col("c_nationkey"), F.col("day"), F.col("o_orderkey"))
    run = fx.run_key(standin.digits(F.col("o_orderkey") % 1000, 8), F.col("day"))
    rows = standin.orders_with_nation(spark, sf).select("o_orderkey", key.alias("race_id"), run.alias("run_key"))
    parts, link = fx.race_key_parts(F.col("race_id")), fx.run_key_parts(F.col("run_key"))
    return rows.select("o_orderkey", "race_id", fx.meeting_key(F.col("race_id")).alias("meeting_id"),
                       *[c.alias(n) for n, c in parts.items()], "run_key",
                       link["horse_id"].alias("run_horse"), link["race_date"].alias("run_date"))


@query("code_decode", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '正常' WHEN 1 THEN '取消' WHEN 2 THEN '除外' WHEN 3 THEN '中止'
    WHEN 4 THEN '失格' WHEN 5 THEN '降着' WHEN 6 THEN '再騎乗' END AS abnormality_label,
  CASE o_orderkey % 7 WHEN 1 THEN '晴' WHEN 2 THEN '曇' WHEN 3 THEN '小雨' WHEN 4 THEN '雨' WHEN 5 THEN '小雪'
    WHEN 6 THEN '雪' END AS weather_label,
  CASE o_orderkey % 40 WHEN 1 THEN '芝G1' WHEN 4 THEN '芝OPA' WHEN 9 THEN '芝3勝クラスC' WHEN 21 THEN 'ダートG1'
    WHEN 38 THEN 'ダート未勝利C' ELSE 'other' END AS class_label
FROM orders""")
def code_decode(spark, sf):
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(
        "o_orderkey", (k % 8).alias("abnormality"), (k % 7).alias("weather"),
        standin.digits(k % 40, 2).alias("class"))
    out = codes.decode_codes(rows, {"abnormality": "abnormality", "weather": "weather", "class": "class"})
    shown = F.col("class").isin("01", "04", "09", "21", "38")
    return out.select("o_orderkey", "abnormality_label", "weather_label",
                      F.when(shown, F.col("class_label")).otherwise("other").alias("class_label"))


@query("class_bands", """
WITH c AS (SELECT o_orderkey, o_orderkey % 64 AS code FROM orders),
b AS (SELECT *, CASE WHEN code BETWEEN 1 AND 18 THEN 'turf' WHEN code BETWEEN 21 AND 38 THEN 'dirt'
  WHEN code BETWEEN 51 AND 62 THEN 'jump' END AS surface,
  code - CASE WHEN code BETWEEN 1 AND 18 THEN 1 WHEN code BETWEEN 21 AND 38 THEN 21
  WHEN code BETWEEN 51 AND 62 THEN 51 END AS step FROM c)
SELECT o_orderkey, surface,
  CASE WHEN step < 3 THEN 'G' || (step + 1) WHEN surface = 'jump'
    THEN ['open', '1win', 'maiden'][((step - 3) // 3) + 1]
    WHEN surface IS NOT NULL THEN ['open', '3win', '2win', '1win', 'maiden'][((step - 3) // 3) + 1] END AS grade,
  CASE WHEN step >= 3 THEN ['A', 'B', 'C'][(step - 3) % 3 + 1] END AS sub_grade
FROM b""")
def class_bands(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 64).alias("code"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in derive.class_parts(F.col("code")).items()])


@query("distance_band", """
SELECT CASE WHEN d <= 1400 THEN 'short' WHEN d <= 1800 THEN 'mile' WHEN d <= 2100 THEN 'middle' ELSE 'long' END
  AS band, CASE WHEN v BETWEEN 1 AND 10 THEN 'central' WHEN v BETWEEN 21 AND 52 THEN 'local'
  WHEN v BETWEEN 61 AND 79 THEN 'overseas' END AS venue_group, substr((1100 + v)::VARCHAR, 1, 2) AS major_line,
  substr((1100 + v)::VARCHAR, 3, 2) AS minor_line, count(*) AS n
FROM (SELECT 1000 + o_orderkey % 15 * 100 AS d, o_orderkey % 80 AS v FROM orders) GROUP BY ALL""")
def distance_band(spark, sf):
    rows = load(spark, sf, "orders").select(
        (1000 + F.col("o_orderkey") % 15 * 100).alias("d"), (F.col("o_orderkey") % 80).alias("v"))
    line = derive.line_parts((1100 + F.col("v")).cast("string"))
    return rows.groupBy(
        derive.distance_band(F.col("d")).alias("band"),
        derive.venue_group(standin.digits("v", 2)).alias("venue_group"),
        *[c.alias(n) for n, c in line.items()]).agg(F.count("*").alias("n"))


@query("derived_scalars", """
SELECT o_orderkey, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter,
  sign(o_orderkey % 7 - 3)::INTEGER AS change_sign, abs(o_orderkey % 7 - 3) AS change_size,
  round((o_orderkey % 18 + 1) / 18.0::DOUBLE, 6) AS relative_draw,
  CASE WHEN o_orderkey % 18 + 1 <= 6 THEN 'inner' WHEN o_orderkey % 18 + 1 <= 12 THEN 'middle' ELSE 'outer' END
    AS draw_side,
  CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
    WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE)
    WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824.0::DOUBLE)
    ELSE printf('%.2f TB', b / 1099511627776.0::DOUBLE) END AS size_label,
  CASE WHEN o_orderkey % 7 > 3 THEN 'up' WHEN o_orderkey % 7 < 3 THEN 'down' ELSE 'same' END || '_' || o_orderstatus
    AS change_x_style, o_orderpriority || '_' || o_orderstatus AS going_x_sire,
  round(o_totalprice * 2, 2) AS weight_x_speed,
  CASE WHEN o_orderkey % 4 > 0 THEN round((o_orderkey % 3) * 100.0::DOUBLE / (o_orderkey % 4), 6) ELSE 0 END AS pct
FROM (SELECT *, o_orderkey * o_orderkey * o_orderkey + 1 AS b FROM orders)""")
def derived_scalars(spark, sf):
    k = F.col("o_orderkey")
    cube = k.cast("decimal(19,0)") * k * k  # passes 64 bits from key 2,097,152 on
    rows = standin.runs(spark, sf)
    cross = derive.crosses(k % 7 - 3, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderstatus"),
                           k, k, F.col("o_totalprice"), F.lit(2.0))
    parts = derive.season(F.col("day")) | derive.weight_change(k % 7 - 3) | derive.relative_draw(k % 18 + 1, F.lit(18))
    parts["relative_draw"] = F.round(parts["relative_draw"], 6)
    return rows.select(
        "o_orderkey", *[c.alias(n) for n, c in parts.items()], derive.byte_label(cube + 1).alias("size_label"),
        cross["change_x_style"].alias("change_x_style"), cross["going_x_sire"].alias("going_x_sire"),
        F.round(cross["weight_x_speed"], 2).alias("weight_x_speed"),
        F.round(derive.percentage(k % 3, k % 4), 6).alias("pct"))


# -- files ----------------------------------------------------------------------

FILES_SQL = """
f AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Baa/BAA' WHEN 1 THEN 'Kyf/kyf' WHEN 2 THEN 'SEC'
  WHEN 3 THEN 'a/b/ZZ' WHEN 4 THEN 'BAAX' WHEN 5 THEN 'UKC' ELSE 'KAA' END || strftime(o_orderdate, '%y%m%d')
  || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.csv' END AS path FROM orders)"""


def _files(spark, sf):
    k = F.col("o_orderkey")
    stem = (F.when(k % 7 == 0, "Baa/BAA").when(k % 7 == 1, "Kyf/kyf").when(k % 7 == 2, "SEC").when(k % 7 == 3, "a/b/ZZ")
            .when(k % 7 == 4, "BAAX").when(k % 7 == 5, "UKC").otherwise("KAA"))
    path = F.concat(stem, F.date_format("o_orderdate", "yyMMdd"), F.when(k % 11 == 0, ".txt").otherwise(".csv"))
    return load(spark, sf, "orders").select("o_orderkey", path.alias("path"))


@query("file_routing", f"""
WITH {FILES_SQL}, m AS (SELECT *, upper(nullif(regexp_extract(path, '(^|/)([A-Za-z]{{2,3}})[0-9]{{6}}\\.csv$', 2), ''))
  AS data_type, regexp_extract(path, '([0-9]{{6}})\\.[a-z]+$', 1) AS stamp FROM f),
r AS (SELECT *, CASE data_type WHEN 'BAA' THEN 'race_info' WHEN 'KYF' THEN 'horse_results' WHEN 'SEC' THEN 'race_results'
  WHEN 'UKC' THEN 'horse_master' WHEN 'KAA' THEN 'venue_info' END AS "table" FROM m)
SELECT o_orderkey, path, data_type, "table", make_date(CASE WHEN substr(stamp, 1, 2)::INT <= 50 THEN 2000 ELSE 1900 END
  + substr(stamp, 1, 2)::INT, substr(stamp, 3, 2)::INT, substr(stamp, 5, 2)::INT) AS file_date,
  lower(path) LIKE '%.csv' AS is_csv,
  CASE WHEN data_type IS NULL THEN 'Invalid filename format' WHEN "table" IS NULL
    THEN 'Unsupported data type: ' || data_type END AS error FROM r""")
def file_routing(spark, sf):
    return fs.route(_files(spark, sf)).withColumn("is_csv", fs.is_csv(F.col("path")))


@query("files_since", f"""
WITH {FILES_SQL} SELECT DISTINCT regexp_extract(path, '([0-9]{{6}})\\.[a-z]+$', 1) AS stamp FROM f
WHERE regexp_extract(path, '([0-9]{{6}})\\.[a-z]+$', 1) >= '000601'
  AND regexp_extract(path, '([0-9]{{6}})\\.[a-z]+$', 1) < '90'""")
def files_since(spark, sf):
    return fs.file_dates_since(_files(spark, sf), "000601")


MANIFEST_SQL = """
cur AS (SELECT doc_id::VARCHAR AS path, lang AS data_type, n_chars AS size, md5(text) AS md5 FROM documents
        WHERE doc_id % 10 <> 1),
old AS (SELECT doc_id::VARCHAR AS path, md5(CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END) AS md5
        FROM documents WHERE doc_id % 10 <> 3),
diff AS (SELECT cur.*, CASE WHEN old.path IS NULL THEN 'new' WHEN old.md5 <> cur.md5 THEN 'changed' ELSE 'same' END
  AS status FROM cur LEFT JOIN old USING (path))"""


def _manifests(spark, sf):
    """Two versions of a file listing: some files were added, some edited, some removed."""
    docs, k = load(spark, sf, "documents"), F.col("doc_id")
    current = docs.where(k % 10 != 1).select(
        k.cast("string").alias("path"), F.col("lang").alias("data_type"), F.col("n_chars").alias("size"),
        F.md5(F.encode("text", "UTF-8")).alias("md5"))
    before = F.when(k % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    previous = docs.where(k % 10 != 3).select(k.cast("string").alias("path"), F.md5(F.encode(before, "UTF-8")).alias("md5"))
    return current, previous


@query("manifest_diff", f"WITH {MANIFEST_SQL} SELECT path, data_type, size, md5, status, status <> 'same' AS to_load FROM diff")
def manifest_diff(spark, sf):
    return fs.manifest_diff(*_manifests(spark, sf))


@query("manifest_summary", f"""
WITH {MANIFEST_SQL}
SELECT coalesce(data_type, 'total') AS data_type, count(*) AS total_files,
  count(*) FILTER (status <> 'same') AS loaded_files, count(*) FILTER (status = 'same') AS skipped_files,
  0::BIGINT AS failed_files, coalesce(sum(size) FILTER (status <> 'same'), 0)::BIGINT AS loaded_bytes
FROM diff GROUP BY ROLLUP (data_type)""")
def manifest_summary(spark, sf):
    return fs.manifest_summary(fs.manifest_diff(*_manifests(spark, sf)))


@query("manifest_sets", f"""
WITH {MANIFEST_SQL}
SELECT 'vanished' AS kind, path FROM old WHERE path NOT IN (SELECT path FROM cur)
UNION ALL SELECT 'unchanged', path FROM (SELECT path, md5 FROM cur INTERSECT SELECT path, md5 FROM old)
UNION ALL SELECT 'changed_or_new', path FROM (SELECT path, md5 FROM cur EXCEPT ALL SELECT path, md5 FROM old)""")
def manifest_sets(spark, sf):
    current, previous = _manifests(spark, sf)
    fresh = current.select("path", "md5").exceptAll(previous.select("path", "md5"))
    return fs.vanished(current, previous).select(F.lit("vanished").alias("kind"), "path") \
        .unionByName(fs.unchanged(current, previous).select(F.lit("unchanged").alias("kind"), "path")) \
        .unionByName(fresh.select(F.lit("changed_or_new").alias("kind"), "path"))


@query("collapse_ws", r"SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', ',', 'g') AS line FROM documents")
def collapse_ws(spark, sf):
    return load(spark, sf, "documents").select("doc_id", pg.collapse_whitespace(F.col("text")).alias("line"))


@query("link_latest", """
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>.*?</ul>')) AS row,
  generate_subscripts(regexp_extract_all(html, '(?s)<ul>.*?</ul>'), 1) - 1 AS pos FROM pages),
l AS (SELECT page_id, pos, regexp_extract_all(row, '<a href="[^"]*">([A-Za-z]+)</a>', 1) AS labels FROM r)
SELECT page_id, labels[-1] AS label, min(pos)::INTEGER AS position FROM l WHERE len(labels) > 0 GROUP BY 1, 2""")
def link_latest(spark, sf):
    return pg.latest_link_per_row(load(spark, sf, "pages"), "html", "page_id", "ul", "[A-Za-z]+")


LINKS_SQL = """
raw AS (SELECT url AS base, unnest(regexp_extract_all(html, 'href=["'']([^"'']*e)["'']', 1)) AS href FROM pages),
u AS (SELECT DISTINCT CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(base, '^([a-zA-Z]+:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-zA-Z]+://[^/?#]+)', 1) || href
  ELSE regexp_replace(regexp_extract(base, '^([a-zA-Z]+://[^/?#]+(/[^?#]*/|/)?)', 1), '/?$', '/') || href END AS url FROM raw),
s AS (SELECT url, split(url, '.com/') AS p FROM u),
l AS (SELECT url, CASE WHEN len(p) = 2 THEN CASE WHEN contains(p[2], '/') THEN split(p[2], '/')[1] ELSE 'root' END END
  AS folder, CASE WHEN len(p) = 2 THEN regexp_extract(url, '([^/]*)$', 1) END AS file_name FROM s)"""


@query("link_listing", f"WITH {LINKS_SQL} SELECT url, folder, file_name FROM l")
def link_listing(spark, sf):
    return pg.link_listing(load(spark, sf, "pages"), F.col("url"), suffix="e", root=".com/")


@query("link_folders", f"WITH {LINKS_SQL} SELECT folder, count(*) AS files FROM l WHERE folder IS NOT NULL GROUP BY 1")
def link_folders(spark, sf):
    return pg.folder_counts(pg.link_listing(load(spark, sf, "pages"), F.col("url"), suffix="e", root=".com/"))


@query("load_log", """
WITH f AS (SELECT o_orderkey % 500 AS n, count(*) AS lines,
  count(*) FILTER (o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR (o_orderkey % 500) % 50 = 0) AS bad
  FROM orders GROUP BY 1)
SELECT CASE WHEN n % 25 = 7 THEN 'bad' ELSE 'BAA' || lpad(n::VARCHAR, 6, '0') || '.csv' END
    || CASE WHEN n % 25 = 7 THEN n::VARCHAR ELSE '' END AS path,
  CASE WHEN n % 25 = 7 OR lines = bad THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN n % 25 = 7 THEN NULL ELSE 'race_info' END AS "table",
  CASE WHEN n % 25 = 7 THEN 0 ELSE lines - bad END AS records, CASE WHEN n % 25 = 7 THEN 0 ELSE bad END AS rejected,
  CASE WHEN n % 25 = 7 THEN 'Invalid filename format' WHEN lines = bad THEN 'No data parsed' END AS error
FROM f""")
def load_log_query(spark, sf):
    n = F.col("source_key") % 500
    path = F.when(n % 25 == 7, F.concat(F.lit("bad"), n.cast("string"))) \
        .otherwise(F.concat(F.lit("BAA"), standin.digits(n, 6), F.lit(".csv")))
    lines = standin.programme_lines(spark, sf).withColumn("path", path) \
        .withColumn("line", F.when(n % 50 == 0, "short").otherwise(F.col("line")))
    files = fs.route(lines.select("path").distinct())
    named = lines.join(files.where(F.col("error").isNull()).select("path"), "path")
    return load_log(files, parse_lines(named, "BAA"))


# -- upsert ----------------------------------------------------------------------

UPSERT_SQL = """
tgt AS (SELECT o_orderkey, o_custkey, o_totalprice, 1 AS version FROM orders WHERE o_orderkey % 5 <> 0),
src AS (SELECT o_orderkey, o_custkey, round(o_totalprice + v, 2) AS o_totalprice, 1 + v AS version
        FROM orders, (VALUES (1), (2)) t(v) WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)"""


def _upsert_sides(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    target = orders.where(k % 5 != 0).withColumn("version", F.lit(1))
    source = orders.where((k % 5 == 0) | (k % 3 == 0)) \
        .withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))) \
        .withColumn("o_totalprice", F.round(F.col("o_totalprice") + F.col("v"), 2)) \
        .withColumn("version", F.col("v") + 1)
    return target, source


@query("upsert_latest", f"WITH {UPSERT_SQL} SELECT o_orderkey, o_custkey, o_totalprice, version FROM src WHERE version = 3")
def upsert_latest(spark, sf):
    _, source = _upsert_sides(spark, sf)
    return tb.latest_per_key(source, ["o_orderkey"], ["v"]).drop("v")


@query("upsert_orders", f"""
WITH {UPSERT_SQL}, s AS (SELECT * FROM src WHERE version = 3)
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.version ELSE t.version END AS version
FROM tgt t FULL JOIN s ON t.o_orderkey = s.o_orderkey""")
def upsert_orders(spark, sf):
    target, source = _upsert_sides(spark, sf)
    return tb.upsert(target, tb.latest_per_key(source, ["o_orderkey"], ["v"]), ["o_orderkey"])


@query("upsert_preserve", f"""
WITH {UPSERT_SQL}, s AS (SELECT * FROM src WHERE version = 3)
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
  coalesce(t.version, s.version) AS version
FROM tgt t FULL JOIN s ON t.o_orderkey = s.o_orderkey""")
def upsert_preserve(spark, sf):
    target, source = _upsert_sides(spark, sf)
    return tb.upsert(target, tb.latest_per_key(source, ["o_orderkey"], ["v"]), ["o_orderkey"], ["version"])
