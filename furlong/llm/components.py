"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long, not null).

    Alternates the large-star and the small-star step until nothing changes, which takes a logarithmic number of
    rounds whatever the shape. Each round is two aggregations and joins on the node; a node with very many neighbours
    is split by the skew join. Rounds are written to the shared folder, which cuts the lineage; only a count and a
    checksum reach the driver.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    current = stored(edges.filter("a <> b").select(high, low).distinct())  # a > b: the larger node points to the smaller
    state = None
    while True:
        check = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == state or check[0] == 0:
            break
        state = check
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        large = stored(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        current = stored(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                         .union(small.select("a", F.col("m").alias("b"))).distinct())
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.union(roots) if state else spark.createDataFrame([], "node long, component long")
