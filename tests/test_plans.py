"""Physical plans: pruned scans, no Python, no pairwise joins, no whole-table windows."""

import re

import pytest

from furlong.plans import catalog

SF = "/root/testdata/sf0.001"
STREAMS = ("stream_odds", "stream_upsert")
QUERIES = {n: q for n, q in catalog.QUERIES.items() if n not in STREAMS}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def schemas(text):
    return re.findall(r"ReadSchema: (.*)", text)


def test_scans_read_only_what_is_needed(spark):
    assert all("l_tax" not in s and "l_extendedprice" not in s for s in schemas(plan(QUERIES["pace_profile"](spark, SF))))
    assert any(s == "struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double>"
               for s in schemas(plan(QUERIES["style_rates"](spark, SF))))


def test_filters_reach_the_scan(spark):
    from furlong.operators import joins as jn
    from furlong.plans.registry import load

    orders = load(spark, SF, "orders").where("o_orderstatus = 'F'")
    text = plan(jn.known(load(spark, SF, "customer"), orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]))
    assert "EqualTo(o_orderstatus,F)" in text


def test_day_partitions_are_pruned(spark, tmp_path):
    from datetime import date

    from furlong.sources.tables import read_table, upsert_table
    from tests.test_tables import races

    upsert_table(spark, str(tmp_path), "race_info", races(spark, [("a", date(2026, 1, 4), 1), ("b", date(2026, 1, 5), 2)]), "x")
    text = plan(read_table(spark, str(tmp_path), "race_info").where("race_date = date'2026-01-05'"))
    assert re.search(r"PartitionFilters: .*race_date#\d+ = 2026-01-05", text)


def test_history_features_share_their_shuffles(spark):
    from furlong.operators import history as hi
    from furlong.plans import standin

    def exchanges(how):
        out = hi.past_n(standin.runs(spark, SF), ["o_custkey"], "day", ["o_orderkey"], "o_totalprice", how=how)
        text = plan(out)
        assert "WindowGroupLimit" in text
        return len(re.findall(r"^\(\d+\) Exchange", text, re.M))

    assert exchanges(("avg",)) == exchanges(("avg", "max", "sd")) <= 5


def test_feature_table_is_built_on_a_pruned_table(spark):
    text = plan(QUERIES["training_data"](spark, SF))
    assert "ExistingRDD" not in text and len(re.findall(r"^\(\d+\) Exchange", text, re.M)) <= 14


def test_top_rows_are_pruned_before_the_shuffle(spark):
    assert plan(QUERIES["top_k"](spark, SF)).count("WindowGroupLimit") >= 2
    assert plan(QUERIES["upsert_latest"](spark, SF)).count("WindowGroupLimit") >= 2
