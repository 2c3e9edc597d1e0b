from pyspark.sql import functions as F

from furlong.llm import exact_dedup
from tests.llm.helpers import by_spark, by_sql, documents, frame


def answer(docs):
    return exact_dedup.mark(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_matches_sql_on_awkward_rows(spark):
    docs = frame(spark)
    assert by_spark(answer(docs)) == by_sql(exact_dedup.SQL, documents=docs)


def test_texts_sampled_as_hot_are_split_without_changing_the_result(spark, monkeypatch):
    rows = documents() + [(1000 + i, "copied  text" if i % 3 else "copied text", None, None, None, None, None, None, None) for i in range(400)]
    docs = frame(spark, rows)
    monkeypatch.setattr(exact_dedup, "SAMPLE", 0.9)
    assert exact_dedup.hot_hashes(docs, "text").count() == 1
    assert by_spark(answer(docs)) == by_sql(exact_dedup.SQL, documents=docs)


def test_one_row_of_each_text_stays_with_all_columns(spark):
    docs = frame(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [(r["text"] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == answer(docs).agg(F.countDistinct("text_sha256")).first()[0]


def test_frequent_texts_keep_one_row_with_all_columns(spark, monkeypatch):
    rows = [(i % 7 or None, "copied  text" if i % 3 else "copied text", None, f"s{i}", None, None, None, None, None) for i in range(300)]
    monkeypatch.setattr(exact_dedup, "SAMPLE", 0.9)
    docs = frame(spark, rows + rows[:50])
    kept = exact_dedup.deduplicate(docs).collect()
    assert len(kept) == 1 and tuple(kept[0]) in rows and (kept[0]["doc_id"], kept[0]["text"]) == (1, "copied  text")


def test_no_text_is_written(spark, monkeypatch):
    written, plain = [], exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df: written.append(df.columns) or plain(df))
    exact_dedup.deduplicate(frame(spark)).collect()
    assert written == [["_hash", "_hot"]]


def test_empty_table(spark):
    assert answer(frame(spark, [])).collect() == []


def test_main_path_has_no_python(spark):
    plan = answer(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
