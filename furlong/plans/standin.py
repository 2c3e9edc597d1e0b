"""Race data shaped from the star-schema tables.

Orders play races, line items entries, parts horses, suppliers jockeys,
customers' nations venues. Record lines are rendered from columns, so parsing
them back must return the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators.in_race import rank_in_race
from furlong.plans.registry import load
from furlong.sources.layouts import COUNTERS


def digits(value: Column | str, width: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.lpad(value.cast("bigint").cast("string"), width, "0")


def compose(length: int, pieces: Sequence[tuple[int, int, Column]]) -> Column:
    """A line of ``length`` characters with each piece at its slice, blanks elsewhere."""
    parts, at = [], 0
    for start, end, value in sorted(pieces, key=lambda p: p[0]):
        if start > at:
            parts.append(F.lit(" " * (start - at)))
        parts.append(F.rpad(F.coalesce(value.cast("string"), F.lit("")), end - start, " "))
        at = end
    if length > at:
        parts.append(F.lit(" " * (length - at)))
    return F.concat(*parts)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small file scan over every core, for the costly text work behind it."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def as_lines(line: Column) -> Column:
    """Records as they come out of a file: its text split at line feeds."""
    return F.explode(F.split(F.concat(line, F.lit("\n")), "\n")).alias("line")


def orders_with_nation(spark: SparkSession, sf: str, every_core: bool = False) -> DataFrame:
    orders = load(spark, sf, "orders")
    orders = (spread(orders) if every_core else orders).withColumn("day", F.col("o_orderdate").cast("date"))
    customers = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def race_key(nation: Column, day: Column, number: Column) -> Column:
    """Venue from the nation, year from the date, the rest from the order number."""
    return F.concat(digits(nation % 10 + 1, 2), F.date_format(day, "yy"), (number % 9 + 1).cast("string"),
                    (number % 10).cast("string"), digits(number % 12 + 1, 2))


def programme_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One programme record per order; some have a damaged key, some are cut short."""
    k = F.col("o_orderkey")
    key = race_key(F.col("c_nationkey"), F.col("day"), k)
    key = F.when(k % 17 == 0, F.concat(F.substring(key, 1, 5), F.lit("X"), F.substring(key, 7, 2))).otherwise(key)
    line = F.concat(
        compose(86, [
            (0, 8, key), (8, 16, F.date_format("day", "yyyyMMdd")), (16, 20, F.lit("1005")),
            (20, 24, digits(1000 + k % 20 * 100, 4)), (24, 25, k % 4), (25, 26, k % 4), (26, 27, F.lit("1")),
            (27, 29, F.lit("12")), (29, 31, F.when(F.col("o_orderpriority") == "1-URGENT", "OP").otherwise("A3")),
            (31, 34, F.col("o_orderstatus")), (34, 35, F.lit("3")), (35, 36, k % 7),
            (36, 86, F.col("o_orderpriority"))]),
        F.lit("    "), (k % 18 + 1).cast("string"), F.lit(" 1　　　　        "))
    line = F.when(k % 19 == 0, F.substring(line, 1, 80)).otherwise(line)
    return orders_with_nation(spark, sf, every_core=True).select(k.alias("source_key"), as_lines(line)).where("line <> ''")


def entry_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One entry record per line item, padded past the last slice."""
    p = F.col("l_partkey")
    line = compose(400, [
        (0, 8, digits("l_orderkey", 8)), (8, 10, digits("l_linenumber", 2)), (10, 18, digits(p, 8)),
        (18, 36, F.concat(F.lit("馬　"), p.cast("string"), F.lit("　"))),
        (36, 41, F.lpad(F.format_string("%.1f", F.col("l_quantity")), 5, " ")),
        (41, 46, F.format_string("%.2f", -F.col("l_discount"))), (73, 74, p % 7), (76, 77, F.lit("8")),
        (78, 83, F.format_string("%.2f", F.col("l_quantity"))), (83, 85, F.col("l_linenumber")),
        (86, 91, F.lit("8.613")), (131, 132, F.when(p % 2 == 0, "B")),
        (153, 159, F.concat(F.col("l_returnflag"), F.lit("　"), F.col("l_linestatus"))),
        (159, 162, digits(F.when(p % 5 == 0, 0).otherwise(480 + p % 100), 3)),
        (163, 169, F.concat(F.lit("　"), F.col("l_linestatus"))), (169, 171, F.lit("美浦")),
        (171, 187, F.concat(digits(p, 8), F.date_format("l_shipdate", "yyyyMMdd"))),
        (251, 252, F.col("l_linenumber")), (295, 300, digits("l_suppkey", 5)), (300, 305, F.lit("")),
        (305, 310, digits(F.floor(F.col("l_extendedprice") / 100), 5)),
        (326, 331, F.format_string("%.1f", F.col("l_tax") * -100.0)), (363, 364, p % 3 + 1),
        (373, 376, digits(400 + p % 200, 3)), (376, 379, F.concat(F.lit("+"), (p % 20).cast("string"))),
        (379, 399, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("　"))),
    ])
    return spread(load(spark, sf, "lineitem")).select(as_lines(line)).where("line <> ''")


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One result record per line item; those of odd line numbers end before the weight tail."""
    p = F.col("l_partkey")
    line = compose(280, [
        (0, 8, digits("l_orderkey", 8)), (8, 10, digits("l_linenumber", 2)), (10, 18, digits(p, 8)),
        (18, 26, F.date_format("l_shipdate", "yyyyMMdd")), (26, 44, F.lit("名　馬")),
        (44, 48, digits(1000 + p % 20 * 100, 4)), (48, 49, p % 4), (49, 50, p % 3),
        (51, 53, F.when(p % 2 == 0, "10").otherwise("1")), (53, 55, F.lit("12")), (61, 62, p % 7),
        (87, 89, F.lit("16")), (93, 95, digits(p % 18 + 1, 2)), (95, 96, F.lit("0")),
        (96, 100, digits(F.when(p % 11 == 0, 0).otherwise(700 + p % 900), 4)), (100, 103, F.lit("550")),
        (103, 109, F.lit("騎　手")), (115, 121, F.format_string("%.1f", F.col("l_quantity"))),
        (121, 123, digits(p % 18 + 1, 2)), (123, 126, F.lit("-12")), (190, 193, digits(p % 50, 3)),
        (196, 199, digits(330 + p % 90, 3)), (219, 225, F.format_string("%.1f", F.col("l_quantity"))),
        (261, 264, digits(420 + p % 100, 3)),
        (264, 267, F.concat(F.when(p % 2 == 0, "+").otherwise("-"), F.lpad((p % 30).cast("string"), 2, " "))),
        (267, 268, p % 6 + 1), (268, 269, F.when(p % 3 == 0, "A")), (269, 270, p % 4 + 1),
    ])
    cut = F.when(F.col("l_linenumber") % 2 == 1, F.substring(line, 1, 265)).otherwise(line)
    return spread(load(spark, sf, "lineitem")).select(as_lines(cut)).where("line <> ''")


def horse_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One horse record per part."""
    k = F.col("p_partkey")
    line = compose(170, [
        (0, 8, digits(k, 8)), (8, 26, F.col("p_name")), (26, 27, k % 5), (27, 29, digits(k % 11 + 1, 2)),
        (31, 49, F.col("p_brand")), (49, 67, F.lit("")), (67, 85, F.col("p_type")),
        (85, 93, F.when(k % 9 == 0, "20240230").otherwise(F.concat(digits(2000 + k % 25, 4), F.lit("0401")))),
        (93, 97, F.lit("1998")), (105, 125, F.concat(F.lit("owner　"), F.col("p_size").cast("string"))),
        (147, 151, F.lit("浦河　")), (151, 152, F.lit("0")), (152, 160, F.lit("20240105")),
        (160, 164, digits(1100 + k % 30, 4)),
    ])
    return spread(load(spark, sf, "part")).select(as_lines(line)).where("line <> ''")


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One condition record per customer: orders by status fill the first three groups."""
    status = F.col("o_orderstatus")
    counts = load(spark, sf, "orders").groupBy("o_custkey").agg(
        *[F.count_if(status == s).alias(s) for s in "FOP"])
    cells = [(0, 8, F.concat(F.lit("0624"), digits(F.col("o_custkey") % 10000, 4))), (8, 10, F.lit("07"))]
    for g, s in enumerate("FOP"):
        at = 10 + 12 * g
        cells += [(at + 3 * i, at + 3 * i + 3, F.lpad((F.col(s) * (i + 1)).cast("string"), 3, " "))
                  for i in range(len(COUNTERS))]
    cells += [(286, 289, F.lit(" 35")), (292, 296, F.lit("1650"))]
    return counts.select(F.col("o_custkey").alias("source_key"), as_lines(compose(306, cells))).where("line <> ''")


def meeting_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One meeting record per nation and order day."""
    n = F.col("c_nationkey")
    line = F.concat(compose(45, [
        (0, 2, digits(n % 12 + 1, 2)), (2, 4, F.date_format("day", "yy")), (4, 5, F.month("day") % 10),
        (5, 6, F.lower(F.hex(F.dayofmonth("day") % 16))), (6, 14, F.date_format("day", "yyyyMMdd")),
        (14, 15, n % 3 + 1), (15, 16, F.lit("土")), (16, 18, F.when(n % 2 == 0, "中山")), (18, 19, n % 6 + 1),
        (19, 21, F.lit("10")), (21, 22, F.lit("1")), (24, 27, F.concat(F.lit("-"), (n % 20).cast("string"))),
        (27, 29, F.lit("-1")), (37, 39, F.lit("20")), (42, 45, F.lit(" 12"))]),
        F.when(n % 5 == 0, "").otherwise((n % 4 + 1).cast("string")))
    return orders_with_nation(spark, sf).select("c_nationkey", "day").distinct() \
        .select(F.col("c_nationkey").alias("nation"), F.col("day").alias("source_day"), as_lines(line)) \
        .where("line <> ''")


def odds_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One base-odds record per order: 18 win, 18 place and 153 quinella prices."""
    k = F.col("o_orderkey")

    def block(count: int, factor: int) -> Column:
        def price(i: Column) -> Column:
            tenths = (k * factor + i * 13) % 900 + 10
            text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
            return F.when((k + i) % 10 == 0, F.lit("     ")).otherwise(F.lpad(text, 5, " "))

        price = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), price)
        return F.array_join(price, "")

    # The prices of a key from 0 on depend on its remainder alone (7, 3 and 11 times 900 are multiples of 900), so they are
    # written once for each; the keys are dealt out and not the long lines.
    prices = F.concat(block(18, 7), block(18, 3), block(153, 11))
    written = spark.range(900).select(F.col("id").alias("_rest"), F.col("id").alias("o_orderkey")) \
        .select("_rest", prices.alias("_prices"))
    keys = spread(load(spark, sf, "orders").select("o_orderkey"))
    return keys.join(F.broadcast(written), k % 900 == F.col("_rest"), "left").select(
        as_lines(F.concat(digits(k, 8), F.lit("18"), F.when(k >= 0, F.col("_prices")).otherwise(prices)))).where("line <> ''")


# -- race-shaped tables ------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs of customers: entity o_custkey, day, tie-break o_orderkey, figure o_totalprice."""
    return load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")).drop("o_orderdate")


def race_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per order and part, with the day of the order.

    Lines are dealt out by order before they are grouped, so grouping, join and places share that one shuffle and no task
    that reads lines keeps them.
    """
    items = load(spark, sf, "lineitem").where(F.col("l_orderkey").isNotNull()).repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_suppkey").alias("suppkey"), F.max("l_quantity").alias("quantity"),
        F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    return items.join(runs(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "day"),
                      F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def placed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with a finishing position: rank by price within the order."""
    return rank_in_race(race_entries(spark, sf), ["l_orderkey"], "price", "position")


def condition_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Placed entries with every column that the named condition groups look at; some values are missing."""
    o, part, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("suppkey")

    def one_of(number: Column, *names: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))

    return placed_entries(spark, sf).select(
        "l_orderkey", "position", part.alias("horse_id"), s.alias("jockey_code"), (s % 20).alias("trainer_code"),
        F.col("o_custkey").alias("owner_code"), F.when(part % 7 > 0, part % 3).alias("blinker"),
        one_of(o, "turf", "dirt").alias("course_type"), (1000 + o % 20 * 100).alias("distance"), (o % 10 + 1).alias("venue_code"),
        one_of(o + part, "1w", "2-3w", "4-8w").alias("layoff"), one_of(o, "right", "left", "straight").alias("direction"),
        F.month("day").alias("season"), (part % 8 + 1).alias("bracket_number"), one_of(o, "良", "稍重", "重", "不良", "他").alias("going"),
        one_of(o, "S", "M", "H", "-").alias("pace"), one_of(part, "jra", "jra", "exchange", "other").alias("organiser"))


def training_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Race, entry, result, pedigree and odds tables in the shape of the warehouse; some races lack a venue or a distance.

    Lines are dealt out by the key of the join that comes next, the horse for entries and the race for the others, before
    they are grouped, so that grouping and join share that shuffle.
    """
    o, part = F.col("o_orderkey"), F.col("l_partkey")
    race, horse = digits("l_orderkey", 8).alias("race_id"), digits(part, 8).alias("horse_id")
    items = load(spark, sf, "lineitem")
    line = ["l_orderkey", "l_partkey"]
    ridden = items.select(horse, *line, "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").repartition("horse_id") \
        .groupBy("horse_id", *line).agg(F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("x"),
                                        F.max("l_discount").alias("d"))
    run = items.select(race, *line, "l_discount").repartition("race_id").groupBy("race_id", *line).agg(F.max("l_discount").alias("d"))
    sizes = items.select(race, *line).repartition("race_id").distinct() \
        .groupBy("race_id", F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("num_horses"))
    races = orders_with_nation(spark, sf).withColumn("race_id", digits(o, 8)).join(sizes, ["race_id", "o_orderkey"]).select(
        "race_id", F.col("day").alias("race_date"),
        F.when(o % 11 > 0, digits(F.col("c_nationkey") % 10 + 1, 2)).alias("venue_code"), (o % 12 + 1).alias("race_number"),
        F.when(F.col("o_orderstatus") == "O", "turf").when(F.col("o_orderstatus") == "F", "dirt")
        .otherwise("obstacle").alias("course_type"), F.when(o % 13 > 0, 1000 + o % 20 * 100).alias("distance"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "重").otherwise("良").alias("track_condition"), "num_horses")
    entries = ridden.select(
        race, part.alias("horse_number"), "horse_id", (part % 8 + 1).alias("bracket_number"),
        digits("s", 5).alias("jockey_code"), digits(F.col("s") % 20, 5).alias("trainer_code"),
        (50 + F.col("q") % 10).alias("weight_carried"), (F.col("x") / 1000).alias("idm"),
        (F.col("d") * 100 - 5).alias("ten_index"))
    results = run.select(
        "race_id", part.alias("horse_number"), ((part + F.col("l_orderkey")) % 13).alias("finish_position"),
        F.when((part + F.col("l_orderkey")) % 37 == 0, 1).otherwise(0).alias("abnormal_code"),
        (33 + F.col("d") * 10).alias("last_3f_time"))
    pedigree = load(spark, sf, "part").select(
        digits("p_partkey", 8).alias("horse_id"), F.col("p_brand").alias("sire_id"),
        F.col("p_type").alias("dam_sire_id"))
    ticks = items.select(race, *line, "l_linenumber", "l_quantity").repartition("race_id") \
        .groupBy("race_id", *line, "l_linenumber").agg(F.max("l_quantity").alias("q"))
    days = load(spark, sf, "orders").select(digits(o, 8).alias("race_id"), o.alias("l_orderkey"), "o_orderdate")
    odds = ticks.join(days, ["race_id", "l_orderkey"]).select(
        "race_id", horse, F.lit("win").alias("odds_type"), F.col("q").alias("odds_value"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("l_linenumber") * 6 - 24))
        .alias("odds_timestamp"))
    return {"races": races, "entries": entries, "results": results, "pedigree": pedigree, "odds": odds}
