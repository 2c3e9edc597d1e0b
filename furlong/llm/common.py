"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.session import shared_dir

#: The white space the contracts speak of, and a word as a run of anything else.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, kind: str = "llm") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later steps prune its columns, and a lost executor costs no recomputation beyond this table.
    The tables stay until the owner of ``spark.checkpoint.dir`` empties it, as the result still reads them.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Text without any white space."""
    return F.translate(text, WHITE, "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_interval(identifier: Column) -> Column:
    """A number in (0, 1) that depends on the identifier alone: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(identifier.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay alive between tasks and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


class Bitmap:
    """A fixed-size set of hashes that never misses a member; what it lets through beyond them must be sorted out by a join.

    It keeps the bulk of a large table out of a shuffle when only some of its rows have a partner. Its size does not
    depend on the data: with too many members it lets everything through and the join is an ordinary one.
    """

    BITS = 1 << 24

    def __init__(self, keys: DataFrame, column: str):
        at = F.pmod(F.xxhash64(column), F.lit(self.BITS))
        words = keys.select(at.alias("at"))
        found = words.groupBy(F.shiftright("at", 5).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(self.BITS >> 5, np.uint32)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (self.BITS - 1)
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)

    def may_hold(self, column: Column) -> Column:
        @F.arrow_udf("boolean")
        def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for hashes in batches:
                yield pa.array(self.test(np.asarray(hashes)))

        return test(F.xxhash64(column))
