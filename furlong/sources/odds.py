"""Base-odds records: repeated five-character values to one row per price."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import fields as fx
from furlong.functions.constants import constant_rows

# 8-character key, 2-digit field size, then 18 win, 18 place and
# 153 quinella prices of five characters each.
MIN_LENGTH = 955
RUNNERS = 18


def pair_dimension(spark: SparkSession) -> DataFrame:
    """Price slot to the pair of numbers i < j of eighteen (153 rows)."""
    pairs = combinations(range(1, RUNNERS + 1), 2)
    rows = [(k, i, j) for k, (i, j) in enumerate(pairs, start=2 * RUNNERS)]
    return constant_rows(spark, rows, "slot int, first_number int, second_number int")


def explode_odds(lines: DataFrame) -> DataFrame:
    """(race_id, num_horses, odds_type, first_number, second_number, odds_value); blank prices are dropped."""
    line, slot = F.col("line"), F.col("slot")
    keep = [c for c in lines.columns if c != "line"]
    texts = F.regexp_extract_all(fx.chars(line, 10, MIN_LENGTH), F.lit("(?s).{5}"), 0)
    # The key is read before the explode, so the long line is not carried along with each price.
    races = lines.where(F.length(line) >= MIN_LENGTH).select(
        *keep, fx.strip(fx.chars(line, 0, 8)).alias("race_id"),
        fx.to_int(fx.chars(line, 8, 10)).alias("num_horses"), texts.alias("texts"))
    values = (
        races.select(*keep, "race_id", "num_horses", F.posexplode("texts").alias("slot", "text"))
        # The test is on the text: one on the finished number would make the optimizer cast twice.
        .where(fx.is_number(F.col("text")))
        .withColumn("odds_value", fx.plain_float(F.col("text")))
    )
    return values.join(F.broadcast(pair_dimension(lines.sparkSession)), "slot", "left").select(
        *keep, "race_id", "num_horses",
        F.when(slot < RUNNERS, "win").when(slot < 2 * RUNNERS, "place").otherwise("quinella").alias("odds_type"),
        F.coalesce("first_number", slot % RUNNERS + 1).cast("bigint").alias("first_number"),
        F.col("second_number").cast("bigint").alias("second_number"), "odds_value")


def to_odds_table(prices: DataFrame, entries: DataFrame, odds_timestamp, ts) -> DataFrame:
    """Rows of the odds table: single-horse prices with the horse id of their entry."""
    single = prices.where(F.col("second_number").isNull()) \
        .withColumnRenamed("first_number", "horse_number")
    return single.join(entries.select("race_id", "horse_number", "horse_id"),
                       ["race_id", "horse_number"]).select(
        "race_id", "horse_id", "odds_type", "odds_value",
        F.lit(odds_timestamp).cast("timestamp").alias("odds_timestamp"), "horse_number",
        F.lit(ts).cast("timestamp").alias("created_at"))
