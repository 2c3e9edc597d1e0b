from datetime import datetime, timedelta

from pyspark.sql import functions as F

from furlong.streaming.odds import last_prices, odds_buckets, open_buckets

T0 = datetime(2026, 1, 4, 9)
KEYS = ["race"]


def feed(spark, folder, rows):
    spark.createDataFrame([(r, T0 + timedelta(minutes=m), v) for r, m, v in rows], "race string, odds_timestamp timestamp, odds_value double") \
        .coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    ticks = spark.readStream.schema("race string, odds_timestamp timestamp, odds_value double").parquet(str(tmp_path / "in"))
    buckets = odds_buckets(ticks, KEYS)
    buckets.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(buckets.schema).parquet(str(tmp_path / "out")), open_buckets(spark, str(tmp_path / "checkpoint"), buckets, KEYS)


def starts(df):
    return {(r.race, (r.bucket_start - T0).seconds // 60) for r in df.collect()}


def test_closed_and_open_buckets_are_all_buckets(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [("a", 1, 2.0), ("a", 8, 3.0), ("a", 1, 2.0), ("b", 35, 5.0), ("b", 38, 4.5), ("a", 39, 9.0)])
    closed, still_open = run(spark, tmp_path)
    assert starts(closed) == {("a", 0)} and starts(still_open) == {("a", 30), ("b", 30)}
    row = still_open.where("race = 'b'").first()
    assert (row.open_value, row.close_value, row.change, row.ticks) == (5.0, 4.5, -0.5, 2)
    assert {r.race: (r.last_value, r.ticks) for r in last_prices(closed, still_open, KEYS).collect()} == {"a": (9.0, 3), "b": (4.5, 2)}
    # started again, the stream closes them as if nobody had looked
    feed(spark, str(tmp_path / "in"), [("c", 90, 1.0)])
    closed, still_open = run(spark, tmp_path)
    assert starts(closed) == {("a", 0), ("a", 30), ("b", 30)} and starts(still_open) == {("c", 90)}


def test_a_stream_without_rows_has_no_open_bucket(spark, tmp_path):
    spark.createDataFrame([], "race string, odds_timestamp timestamp, odds_value double").write.parquet(str(tmp_path / "in"))
    closed, still_open = run(spark, tmp_path)
    assert closed.columns == still_open.columns and still_open.count() == 0


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [("abc"[i % 3], (i * 7) % 120, float(i % 11)) for i in range(200)]
    feed(spark, str(tmp_path / "in"), rows)
    closed, still_open = run(spark, tmp_path)
    batch = odds_buckets(spark.read.parquet(str(tmp_path / "in")), KEYS)
    ticks = lambda df: {(r.race, r.bucket_start): r.ticks for r in df.collect()}
    assert ticks(closed.unionByName(still_open)) == ticks(batch)
    assert closed.join(still_open.select("race", F.col("bucket_start")), ["race", "bucket_start"]).count() == 0
