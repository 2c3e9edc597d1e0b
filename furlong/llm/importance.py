"""Quality by importance resampling.

Words and pairs of words are hashed into a fixed number of buckets. Two generative models, one of labelled good text and
one of all text, give each document the logarithm of their ratio; a Gumbel number is added and the largest keys stay,
which samples without replacement with chances in proportion to the ratio (Gumbel top-k).

The target model is fitted on at most ``TARGET_DOCS`` good documents; the other model counts every document. ``k`` may
be given; else it is the number of documents whose ratio is at least ``LEAST``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.llm.common import give_back, stored, text_of, unit_interval

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
#: With fewer target n-grams a bucket than this, buckets are merged, down to the fewest: else a document that is not in the
#: sample would look unlikely for the words that only it has.
FILLED, FEWEST = 1024, 256
LEAST = 1 / 20
#: N-grams that a task holds at a time, and characters of a text that are split into words at a time.
HELD, PART = 1 << 20, 1 << 21
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A word that repeats the one before it counts as this number.
REPEATED = np.uint64(0x5BD1E9955BD1E995)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Numbers(dict):
    """Word to a 64-bit number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return value


def parts(text: str) -> Iterator[str]:
    """The text in parts that end at white space, so that no word is cut (a longer word is)."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            end = end if end > at else min(len(text), at + PART)
        yield text[at:end]
        at = end


def grams(texts: list[str | None], numbers: Numbers, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (index of the text, bucket), one entry per word and per pair of neighbouring words."""
    ids: list[int] = []
    runs: list[tuple[int, int]] = []
    carried: tuple[int, np.uint64] | None = None  # last word of the block before, as it stands and as it counts

    def block() -> tuple[np.ndarray, np.ndarray]:
        nonlocal carried
        own = np.repeat([k for k, _ in runs], [n for _, n in runs])
        raw = np.array(ids, np.uint64)
        together = own[1:] == own[:-1]
        counted = raw.copy()
        counted[1:][together & (raw[1:] == raw[:-1])] = REPEATED
        skip = 0
        if carried is not None:
            counted[0], skip = carried[1], 1
        shift = np.uint64(64 - (buckets - 1).bit_length())
        single = (counted * MIX_B) >> shift
        pair = ((counted[:-1] * MIX_A + counted[1:]) * MIX_B) >> shift
        carried = (int(raw[-1]), counted[-1])
        return (np.concatenate((own[skip:], own[1:][together])),
                np.concatenate((single[skip:], pair[together])).astype(np.int64))

    for k, text in enumerate(texts):
        for part in parts(text or ""):
            own = [numbers[w] for w in TOKEN.findall(part.lower())]
            if own:
                ids += own
                runs.append((k, len(own)))
            if len(ids) >= HELD:
                yield block()
                ids, runs = [carried[0]], [(runs[-1][0], 1)]
    if len(ids) > (carried is not None):
        yield block()


def fit(docs: DataFrame, good: DataFrame, identifier: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Log ratio of each bucket: occurrences in good documents against those that the model of all text expects there,
    one added to both. All zero without good documents.

    ``good`` holds identifiers of good documents; those with the smallest hashes serve. Every task counts its rows and
    ships at most one row per bucket, so what reaches the driver is ``buckets`` rows.
    """
    chosen = good.select(F.col(identifier).alias("_good")).filter("_good IS NOT NULL").distinct() \
        .orderBy(F.xxhash64("_good"), "_good").limit(target_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, both = Numbers(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            chosen_rows = np.array(batch.column(1), bool)
            for own, bucket in grams(batch.column(0).to_pylist(), numbers, buckets):
                both[0] += np.bincount(bucket, minlength=buckets)
                both[1] += np.bincount(bucket[chosen_rows[own]], minlength=buckets)
        used = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(both[0][used]), pa.array(both[1][used])],
                                         ["bucket", "raw", "target"])
        numbers.clear()
        give_back()

    # the chosen identifiers are at most target_docs rows
    marked = docs.select(text_of(text).alias("t"), F.col(identifier).alias("_id")) \
        .join(F.broadcast(chosen), F.col("_id") == F.col("_good"), "left").select("t", F.col("_good").isNotNull().alias("g"))
    found = marked.mapInArrow(count, "bucket int, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in found:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.any():
        return np.zeros(buckets)
    while len(raw) > FEWEST and target.sum() < FILLED * len(raw):
        raw, target = raw.reshape(-1, 2).sum(axis=1), target.reshape(-1, 2).sum(axis=1)
    expected = target.sum() * raw / raw.sum()
    return np.log((target + 1) / (expected + 1))


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``ratio`` (log_ratio double, n_grams long) of the whole text; 0 and 0 for a null or empty one."""
    buckets = len(ratios)

    @F.arrow_udf("log_ratio double, n_grams long")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = Numbers()
        for texts in batches:
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for own, bucket in grams(texts.to_pylist(), numbers, buckets):
                total += np.bincount(own, ratios[bucket], len(texts))
                n += np.bincount(own, minlength=len(texts))
            yield pa.StructArray.from_arrays([pa.array(total), pa.array(n)], names=["log_ratio", "n_grams"])
        numbers.clear()
        give_back()

    return docs.withColumn("ratio", weigh(text_of(text)))


def resample(docs: DataFrame, ratios: np.ndarray, identifier: str = "doc_id", text: str = "text", k: int | None = None,
             columns: list[str] | None = None) -> DataFrame:
    """Which documents the resampling keeps.

    The ``k`` largest keys (log ratio plus Gumbel number of the identifier) stay; of equal keys the smaller
    identifier, null last; rows that repeat an identifier share its Gumbel number. Empty and null texts have ratio 1.
    Keys are counted in about 7000 bins of rising key; only the bin in which the ``k``-th key lies is ranked row by
    row. An empty table gives no rows.

    Returns row (``columns``), log_ratio, n_grams, key, kept.
    """
    names = columns or [identifier]
    gumbel = -F.log(-F.log(unit_interval(F.col("_id"))))
    scored = score(docs.select(F.struct(*names).alias("row"), F.col(identifier).alias("_id"), F.col(text).alias("_text")), ratios, "_text")
    keyed = scored.select("row", "_id", "ratio.log_ratio", "ratio.n_grams") \
        .withColumn("key", F.col("log_ratio") + gumbel) \
        .withColumn("_bin", F.floor(F.signum("key") * F.log1p(F.abs("key")) * 256).cast("int"))
    keyed = stored(keyed)
    if k is None:
        k = keyed.filter(F.col("log_ratio") >= float(np.log(LEAST))).count()
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_rows"))
    bins = bins.withColumn("_before", F.sum("_rows").over(
        W.orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_rows"))
    placed = keyed.join(F.broadcast(bins), "_bin")  # as many rows as bins
    sure = placed.filter((F.col("_before") + F.col("_rows") <= k) | (F.col("_before") >= k)) \
        .withColumn("kept", F.col("_before") < k)
    order = W.partitionBy("_bin").orderBy(F.desc("key"), F.asc_nulls_last("_id"))
    edge = placed.filter((F.col("_before") < k) & (F.col("_before") + F.col("_rows") > k)) \
        .withColumn("kept", F.row_number().over(order) + F.col("_before") <= k)
    return sure.unionByName(edge).select("row", "log_ratio", "n_grams", "key", "kept")


def good_documents(labels: DataFrame, identifier: str = "doc_id") -> DataFrame:
    return labels.filter("quality = 1").select(identifier)


def filter_quality(docs: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    ratios = fit(docs, good_documents(labels, identifier), identifier, text)
    return resample(docs, ratios, identifier, text, columns=docs.columns).filter("kept").select("row.*")
