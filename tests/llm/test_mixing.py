from collections import defaultdict

import pytest

from furlong.llm import mixing
from tests.llm.helpers import by_spark, by_sql, documents, frame, labels

MARKS = [(i, i % 2, 0) for i in range(0, 50, 3)] + [(3, 0, 0), (3, 1, 1), (None, 1, 0), (6, None, None)]


def test_matches_sql_on_awkward_rows(spark):
    docs, marks = frame(spark), labels(spark, MARKS)
    assert by_spark(mixing.mix(docs, labels=marks).drop("row")) == by_sql(mixing.SQL, documents=docs, labels=marks)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_bucket_number_does_not_matter(spark, buckets):
    docs, marks = frame(spark), labels(spark, MARKS)
    assert by_spark(mixing.mix(docs, labels=marks, buckets=buckets).drop("row")) == by_spark(mixing.mix(docs, labels=marks).drop("row"))


def test_targets_are_met_and_limits_kept(spark):
    sums, goals, sizes = defaultdict(int), {}, {}
    rows = mixing.mix(frame(spark), columns=["source"]).collect()
    for r in rows:
        source = r["row"]["source"]
        sums[source] += r["taken"]
        goals[source], sizes[source] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(sums[s] - goals[s]) <= 0.5 for s in goals)
    assert abs(sum(goals.values()) - sum(sizes.values())) < 1e-6 and all(goals[s] <= 3 * sizes[s] for s in goals)


def test_excess_of_small_sources_goes_to_the_others(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["a"] == got["d"] == (1520 - 60) / 2


def test_quality_is_drawn_earlier(spark):
    docs = frame(spark, [(i, "w " * 10, "en", "a" if i < 900 else "b", None, None, None, None, None) for i in range(1000)])
    marks = labels(spark, [(i, i % 2, 0) for i in range(900)])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, labels=marks, weights=(1, 1, 1)).collect()}
    good, bad = sum(taken[i] for i in range(1, 900, 2)), sum(taken[i] for i in range(0, 900, 2))
    assert good > 1.1 * bad


def test_rows_are_repeated_as_taken(spark):
    docs = frame(spark)
    counted = defaultdict(int)
    for r in mixing.repeat_rows(docs, mixing.letter_share()).collect():
        counted[(r["doc_id"], r["text"])] += 1
    expected = defaultdict(int)
    for r in mixing.mix(docs, mixing.letter_share(), columns=["text"]).collect():
        if r["taken"]:
            expected[(r["doc_id"], r["row"]["text"])] += -(-r["taken"] // r["size"])
    assert counted == expected and mixing.repeat_rows(docs).columns == docs.columns


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    blank = [r for r in documents() if not (r[1] or "").split()]
    assert {r["taken"] for r in mixing.mix(frame(spark, blank)).collect()} == {0}


def test_main_path_has_no_python(spark):
    plan = mixing.mix(frame(spark), labels=labels(spark, MARKS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_sources_than_a_broadcast_holds(spark, monkeypatch):
    docs, marks = frame(spark), labels(spark, [(1, 1, 0), (2, 0, 0)])
    few = by_spark(mixing.mix(docs, labels=marks).drop("row"))
    monkeypatch.setattr(mixing, "PLAN_BYTES", 0)
    assert by_spark(mixing.mix(docs, labels=marks).drop("row")) == few
