"""Joins and conditions on group keys.

One rule holds for keys that are missing: such a row belongs to no entity and no race, so it has no history, no rank
and no totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.session import shared_dir

#: Column that keeps rows without a key apart from each other in a window.
ALONE = "_alone"


def keyed(keys: Sequence[str]) -> Column:
    """True for rows that have all their keys."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys with each other; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def set_apart(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a column that is different in every row without a key and NULL in the others.

    With it among the keys of a window, rows that belong to no group are dealt over all tasks instead of meeting in one.
    A frame that has the column already keeps it, so that several windows share one shuffle.
    """
    if ALONE in df.columns:
        return df
    return df.withColumn(ALONE, F.when(~keyed(keys), F.monotonically_increasing_id()))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_place(df: DataFrame, order: Sequence[Column], place: str, total: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order`` over all rows, and the number of rows.

    The rows are sorted into ranges on splitters that Spark samples, and written; a prefix sum over the rows of each
    range, one number a task, places them. The order alone decides who is in a range, so a frequent key is no larger
    task as long as the rest of the order tells its rows apart; rows that are equal in all of it are told apart by their number.
    """
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    at = F.monotonically_increasing_id()  # the task, and in the lower 33 bits the row
    ranged = numbered.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie") \
        .withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33))
    ranged = stored(ranged, "ranges")
    ranges = ranged.groupBy("_range").agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from")).alias("_shift"),
                           F.sum("_rows").over(W.partitionBy()).alias(total))
    return ranged.join(starts, "_range").withColumn(place, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
