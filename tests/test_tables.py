import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from furlong.sources import tables as tb
from furlong.sources.schemas import DATASETS, table_schema
from furlong.streaming.ingest import ingest_files, ingest_stream
from tests.test_ingest import PROGRAMME

TS = datetime(2026, 1, 4, 12)


def races(spark, rows, file_date=date(2026, 1, 4)):
    df = spark.createDataFrame(rows, "race_id string, race_date date, distance long")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in table_schema("race_info")],
                     F.lit(file_date).alias("file_date"), F.monotonically_increasing_id().alias("line_no"))


def stored(spark, root):
    return {r.race_id: (r.race_date, r.distance) for r in tb.read_table(spark, root, "race_info").collect()}


D1, D2 = date(2026, 1, 4), date(2026, 1, 5)


def test_upsert_table(spark, tmp_path):
    root = str(tmp_path)
    assert stored(spark, root) == {}
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 1), ("b", D2, 2), ("b", D2, 3)]), "b1")
    assert stored(spark, root) == {"a": (D1, 1), "b": (D2, 3)}
    change = races(spark, [("b", D2, 9), ("c", D2, 4)])
    tb.upsert_table(spark, root, "race_info", change, "b2")
    want = {"a": (D1, 1), "b": (D2, 9), "c": (D2, 4)}
    assert stored(spark, root) == want
    tb.upsert_table(spark, root, "race_info", races(spark, [("b", D2, 0)]), "b2")  # replay of a finished batch
    assert stored(spark, root) == want
    tb.upsert_table(spark, root, "race_info", change, "b3")
    assert stored(spark, root) == want


def test_row_that_moves_to_another_day(spark, tmp_path):
    root = str(tmp_path)
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 1), ("b", D2, 2)]), "b1")
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D2, 5)]), "b2")
    assert stored(spark, root) == {"a": (D2, 5), "b": (D2, 2)}
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 6)]), "b3")
    assert stored(spark, root) == {"a": (D1, 6), "b": (D2, 2)}


def test_batch_that_died_while_moving_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 1), ("b", D1, 2)]), "b1")
    real = tb.write_table
    monkeypatch.setattr(tb, "write_table", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 7)]), "b2")
    monkeypatch.setattr(tb, "write_table", real)
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 0)]), "b2")
    assert stored(spark, root) == {"a": (D1, 7), "b": (D1, 2)}


def many_races(spark, ids, day):
    """One race per id and number of days after 2024-01-01."""
    return races(spark, [(i, date(2024, 1, 1) + timedelta(days=day(k)), 0) for k, i in enumerate(ids)])


def files_by_day(root):
    import glob
    import os

    return {os.path.basename(os.path.dirname(f)): f for f in glob.glob(f"{root}/raw/race_info/race_date=*/*.parquet")}


def test_only_days_of_matched_keys_are_read_and_rewritten(spark, tmp_path):
    """Random keys span the range of all others; the index finds their days all the same."""
    root = str(tmp_path)
    ids = [f"{(i * 7919) % 100_003:06d}" for i in range(60)]
    tb.upsert_table(spark, root, "race_info", many_races(spark, ids, lambda k: k % 20), "b1")
    before = files_by_day(root)
    batch = races(spark, [(min(ids), date(2024, 1, 1) + timedelta(days=ids.index(min(ids)) % 20), 9),
                          (max(ids), date(2024, 1, 1) + timedelta(days=ids.index(max(ids)) % 20), 9), ("500000", date(2024, 3, 1), 9)])
    days = {str(r[0]) for r in tb.indexed_days(spark, root, "race_info", batch).collect()}
    own = {str(date(2024, 1, 1) + timedelta(days=ids.index(i) % 20)) for i in (min(ids), max(ids))}
    assert days == own
    tb.upsert_table(spark, root, "race_info", batch, "b2")
    after = files_by_day(root)
    changed = {d.removeprefix("race_date=") for d in after if after[d] != before.get(d)}
    assert changed == own | {"2024-03-01"} and len(stored(spark, root)) == 61


def test_the_index_is_pruned_by_slot(spark, tmp_path):
    root = str(tmp_path)
    tb.upsert_table(spark, root, "race_info", many_races(spark, [f"{i:06d}" for i in range(200)], lambda k: k % 5), "b1")
    tb.indexed_days(spark, root, "race_info", races(spark, [("000007", D1, 0)]))
    plan = tb.indexed_days(spark, root, "race_info", races(spark, [("000007", D1, 0)]))._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert found and "_slot" in found[1]


def test_days_without_rows_are_removed_without_a_job(spark, tmp_path):
    root = str(tmp_path)
    tb.upsert_table(spark, root, "race_info", many_races(spark, [f"{i:06d}" for i in range(30)], lambda k: k), "b1")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dropping", "")
    tb.drop_days(spark, tb.table_path(root, "race_info"), "race_date", [])
    assert not tracker.getJobIdsForGroup("dropping")
    tb.upsert_table(spark, root, "race_info", many_races(spark, [f"{i:06d}" for i in range(30)], lambda k: 100), "b2")
    assert list(files_by_day(root)) == ["race_date=2024-04-10"] and len(stored(spark, root)) == 30
    # a stale entry of the index leads to a day that is gone, which holds nothing
    tb.upsert_table(spark, root, "race_info", many_races(spark, ["000003"], lambda k: 7), "b3")
    assert stored(spark, root)["000003"][0] == date(2024, 1, 8) and len(stored(spark, root)) == 30


def test_a_table_older_than_its_index_is_indexed_once(spark, tmp_path):
    import shutil

    root = str(tmp_path)
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", D1, 1), ("b", D1, 2)]), "b1")
    shutil.move(f"{root}/_index", f"{root}/_old_index")
    tb.upsert_table(spark, root, "race_info", races(spark, [("a", date(2025, 5, 5), 3)]), "b2")
    assert {k: v[0] for k, v in stored(spark, root).items()} == {"a": date(2025, 5, 5), "b": D1}


def test_null_keys_never_match(spark):
    target = spark.createDataFrame([(1, "t"), (None, "t")], "k int, v string")
    source = spark.createDataFrame([(1, "s", 1), (1, "z", 2), (None, "s", 1), (None, "s", 2)], "k int, v string, n int")
    rows = tb.upsert(target, tb.latest_per_key(source, ["k"], ["n"]), ["k"]).collect()
    assert sorted(map(str, rows)) == sorted(["Row(k=1, v='z')", "Row(k=None, v='t')", "Row(k=None, v='s')",
                                             "Row(k=None, v='s')"])


def test_audit_columns(spark):
    old = datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, old), (2, None)], "k int, created_at timestamp")
    assert {r.created_at for r in tb.with_audit(df, TS).collect()} == {TS}
    kept = {r.k: (r.created_at, r.updated_at) for r in tb.with_audit(df, TS, ["created_at"]).collect()}
    assert kept == {1: (old, TS), 2: (TS, TS)}


def test_catalog(spark):
    tb.ensure_all(spark)
    tb.ensure_all(spark)
    counts = {r.dataset: r.tables for r in tb.inventory(spark).collect()}
    assert counts == {"raw": 8, "features": 1, "predictions": 0, "backtests": 0}
    assert spark.table("raw.odds").columns[-1] == "odds_date"
    for name in DATASETS:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_unexpected_read_errors_are_not_hidden(spark, tmp_path):
    (tmp_path / "raw" / "race_info").mkdir(parents=True)
    (tmp_path / "raw" / "race_info" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="not a Parquet file"):
        tb.read_table(spark, str(tmp_path), "race_info").collect()


def test_stream_from_files(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "tables")
    landing.mkdir()

    def drop(name, *lines):
        (landing / name).write_bytes("\r\n".join(lines).encode("cp932"))

    def run(checkpoint="cp"):
        ingest_stream(spark, str(landing), root, str(tmp_path / checkpoint), clock=lambda: TS).awaitTermination()
        return {r.race_id: r.distance for r in tb.read_table(spark, root, "race_info").collect()}

    other = PROGRAMME.replace("06261101", "06261102")
    drop("BAA260104.csv", PROGRAMME, other, "junk")
    drop("BAA260105.csv", PROGRAMME.replace("1200", "1400", 1))
    drop("nonsense.csv", "x")
    assert run() == {"06261101": 1400, "06261102": 1200}
    assert run() == {"06261101": 1400, "06261102": 1200}
    log = {r.path.rsplit("/", 1)[1]: (r.status, r.records) for r in spark.read.parquet(f"{root}/_log").collect()}
    assert log == {"BAA260104.csv": ("success", 2), "BAA260105.csv": ("success", 1), "nonsense.csv": ("failed", 0)}
    drop("BAB260106.csv", other.replace("1200", "1600", 1))
    assert run() == {"06261101": 1400, "06261102": 1600}
    assert run("fresh") == {"06261101": 1400, "06261102": 1600}
    ingest_files(spark, str(landing / "BAA260104.csv"), root, TS)
    assert {r.race_id: r.distance for r in tb.read_table(spark, root, "race_info").collect()} == \
        {"06261101": 1200, "06261102": 1200}
    rejects = spark.read.parquet(f"{root}/_rejects").select("reject_reason").distinct().collect()
    assert [r[0] for r in rejects] == ["line too short"]
