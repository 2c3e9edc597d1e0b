"""What keeps a query within its limits when tables grow: keys past 32 bits cubed, lines made where they are read, casts that refuse little."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from furlong.functions import fields as fx
from furlong.operators import aggregates as ag
from furlong.plans import standin
from furlong.plans.catalog import QUERIES
from furlong.plans.standin import odds_lines
from furlong.session import SHUFFLE_CONF


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, day = str(tmp_path_factory.mktemp("tables")), dt.datetime(1998, 2, 6)
    keys = [0, 1, 899, 900, 2_097_151, 2_097_152, 9_000_000, None]
    spark.createDataFrame([(k, 1, "O", 10.0, day, "5-LOW") for k in keys],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .write.parquet(f"{folder}/orders.parquet")
    return folder


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cubes_past_64_bits_have_a_size_label(spark, tables):
    labels = {r.o_orderkey: r.size_label for r in QUERIES["derived_scalars"](spark, tables).collect() if r.o_orderkey is not None}
    assert labels[1] == "2.00 B"
    for key in (2_097_151, 2_097_152, 9_000_000):
        assert labels[key] == f"{(key**3 + 1) / 2**40:.2f} TB"


@pytest.mark.parametrize("kind", ("programme", "entries", "results", "horses", "records", "meetings"))
def test_lines_are_drawn_after_the_keys_are_dealt_out(spark, tables, kind):
    plan = optimized(QUERIES[f"whole_{kind}"](spark, tables))
    assert plan.index("md5") < plan.index("Repartition")


def test_odds_lines_are_written_after_the_keys_are_dealt_out(spark, tables):
    lines = {int(r.line[:8]): r.line for r in odds_lines(spark, tables).collect()}
    assert len(lines) == 7 and {len(x) for x in lines.values()} == {955}
    for k, line in lines.items():
        for first, count, factor in ((0, 18, 7), (18, 18, 3), (36, 153, 11)):
            for i in range(count):
                tenths = (k * factor + i * 13) % 900 + 10
                at = 10 + 5 * (first + i)
                assert line[at:at + 5] == ("     " if (k + i) % 10 == 0 else f"{tenths // 10}.{tenths % 10}".rjust(5))
    plan = optimized(odds_lines(spark, tables))
    assert "transform" not in plan[plan.index("Repartition"):plan.index("Relation")]


def test_only_whole_numbers_reach_the_strict_cast(spark):
    texts = {" 12 ": 12, "+7": 7, "-0": 0, "1 2": None, " .5": None, "--1": None, "": None, "　12　": 12, "\x0012": 12, "1\x002": None,
             "99999999999999999999": None, "9223372036854775807": 2**63 - 1, "１２": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.to_int(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts
    assert "RLIKE" in optimized(df)


def test_numbers_read_the_same_with_and_without_wide_blanks(spark):
    texts = {" 1.5": 1.5, "　1.5\xa0": 1.5, "\t.5\x1f": 0.5, "1d": None, "１.5": None, "": None, "1.5\x00": None, "1.5　x": None, "+1e3\x85": 1000.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.to_float(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def test_lines_are_shuffled_once_for_entries_and_places(spark):
    """Grouping, join and places are all by order, and the task that reads lines groups nothing."""
    plan = standin.placed_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning"):]


def test_entries_of_repeated_and_missing_keys(spark, tmp_path):
    day = dt.datetime(1998, 2, 6)
    spark.createDataFrame([(k, c, "O", 1.0, day, "5-LOW") for k, c in ((1, 7), (1, 8), (2, 7), (None, 7))],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5, 9, 3.0, 30.0, 0.1), (1, 5, 4, 5.0, 20.0, 0.2), (1, None, 4, 1.0, 40.0, 0.0), (2, 6, None, 1.0, None, 0.0),
                           (None, 5, 1, 1.0, 1.0, 0.0), (3, 5, 1, 1.0, 1.0, 0.0)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = standin.placed_entries(spark, str(tmp_path)).select("l_orderkey", "l_partkey", "suppkey", "quantity", "price", "o_custkey", "position").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, 5, 4, 5.0, 30.0, 7, 3), (1, 5, 4, 5.0, 30.0, 8, 3), (1, None, 4, 1.0, 40.0, 7, 1), (1, None, 4, 1.0, 40.0, 8, 1), (2, 6, None, 1.0, None, 7, None)], key=repr)


def test_tags_are_texts_made_once_a_row(spark):
    plan = optimized(ag.named_records(standin.condition_entries(spark, "/root/testdata/sf0.001"), ag.condition_groups(), "position"))
    assert "lambda" not in plan  # evaluated element by element without code generation
    tags = next(x for x in plan.splitlines() if "inline" in x)
    assert "cast" not in tags and "concat" not in tags


def test_tasks_read_little_after_a_shuffle_of_race_tables(spark):
    QUERIES["condition_record"](spark, "/root/testdata/sf0.001")
    assert all(spark.conf.get(k) == v for k, v in SHUFFLE_CONF.items()) and int(SHUFFLE_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 8 << 20


@pytest.mark.parametrize("name", ("condition_wide", "counters_unpivot"))
def test_tasks_stay_small_whatever_the_number_of_shuffle_partitions(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)]
    assert len(dealt) == 3 and min(dealt) >= 1000 > int(spark.conf.get("spark.sql.shuffle.partitions"))
