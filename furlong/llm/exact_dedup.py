"""Exact duplicates by sorting content.

Rows are range-partitioned on splitters that Spark samples from a short, bounded key of the normalised text
(its head and a hash), sorted externally, and equal neighbours are found by comparing whole texts. Texts that a
sample shows to be very frequent are cut into pieces first, so that no task receives all their copies; the pieces'
winners are compared in a second step, which sees at most ``PIECES`` rows per such text.

Texts are shuffled once and written nowhere: the first of a frequent text comes from its digests, summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.llm.common import squeezed, stored, text_of

PIECES = 64
#: Hot texts are looked for in a sample; it steers the partitioning only, never the result.
SAMPLE, SEEN, MOST = 0.02, 24, 1000


def hot_hashes(docs: DataFrame, text: str) -> DataFrame:
    """Hashes of the most frequent texts, at most ``MOST`` rows."""
    sample = docs.sample(fraction=SAMPLE, seed=11).select(F.xxhash64(squeezed(text_of(text))).alias("_hash"))
    return sample.groupBy("_hash").count().filter(F.col("count") >= SEEN) \
        .orderBy(F.desc("count"), "_hash").limit(MOST).select("_hash", F.lit(True).alias("_hot"))


def mark(docs: DataFrame, identifier: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """One row per input row, with what the comparison of its text found.

    Texts are equal when they agree after deleting white space; a null text counts as empty. Of equal texts the row
    with the most code points stays, then the one with the smallest identifier (null last); of rows that repeat even
    those, exactly one stays. ``columns`` are carried in the struct ``row``; extra columns of any name do no harm.
    An empty table gives an empty result.

    Returns row, keep_id, group_size, kept, text_sha256.
    """
    names = columns or [identifier]
    carried = [] if text in names else [text_of(text).alias("_text")]
    wide = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(identifier).alias("_id"), *carried)
    whole = F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")) if text in names else F.col("_text")
    hot = stored(hot_hashes(docs, text))  # written, as both plans below must speak of the same texts
    keyed = wide.withColumn("_chars", F.length(whole)).withColumn("_norm", squeezed(whole)) \
        .withColumn("_hash", F.xxhash64("_norm")).withColumn("_head", F.substring("_norm", 1, 16)).drop("_norm") \
        .join(F.broadcast(hot), "_hash", "left") \
        .withColumn("_hot", F.coalesce("_hot", F.lit(False))) \
        .withColumn("_piece", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "_chars"), F.lit(PIECES))).otherwise(0))
    cut = keyed.repartitionByRange("_head", "_hash", "_piece").withColumn("_norm", squeezed(whole))
    run = W.partitionBy("_head", "_hash", "_piece", "_norm")
    order = run.orderBy(F.desc("_chars"), F.asc_nulls_last("_id"))
    found = cut.select(
        "row", "_id", "_chars", "_hot", "_piece", F.sha2("_norm", 256).alias("text_sha256"),
        F.row_number().over(order).alias("_place"), F.first("_id").over(order).alias("_keep"),
        F.count(F.lit(1)).over(run).alias("_rows"))
    heads = keyed.filter("_hot").groupBy(F.sha2(squeezed(whole), 256).alias("_sha")).agg(
        F.min(F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_piece"))).alias("_first"),
        F.count(F.lit(1)).alias("_all"))
    merged = heads.select("_sha", F.col("_first._id").alias("_keep_all"), F.col("_first._piece").alias("_at"), "_all")
    # at most MOST texts were called hot, so their winners fit any task
    joined = found.join(F.broadcast(merged), F.col("_hot") & (F.col("text_sha256") == F.col("_sha")), "left")
    return joined.select(
        "row", F.when(F.col("_hot"), F.col("_keep_all")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(F.col("_hot"), F.col("_all")).otherwise(F.col("_rows")).alias("group_size"),
        ((F.col("_place") == 1) & (~F.col("_hot") | (F.col("_at") == F.col("_piece")))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return mark(docs, identifier, text, docs.columns).filter("kept").select("row.*")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
