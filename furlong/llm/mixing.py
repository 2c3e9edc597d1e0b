"""Mixing sources to target weights.

Every document draws an exponential key divided by its quality weight (Efraimidis and Spirakis). Within a source the
documents stand in key order; complete passes over the source come first, then the documents whose running size fits
the rest of the budget. The last of them is cut where the budget ends.

The order of a source is built from buckets of rising key: sizes are summed per bucket with map-side combine, prefix
sums over the buckets find the one in which the budget ends, and only the documents of that bucket are sorted and
summed row by row. So a source with a third of all rows puts a ``buckets``-th of itself into one task at most, and
texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.llm.common import count_words, stored, text_of, unit_interval

BUCKETS = 1024
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Bytes of a plan (one row per source) that are sent to every task.
PLAN_BYTES = 4_000_000
#: Chance weights by label: good, not labelled, bad. Powers of two keep the division exact.
GOOD, UNKNOWN, BAD = 1.0, 0.5, 0.25


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Target words of each source (``source``, ``source_size``).

    Sources take the weights in turn, by code point, null last. A target stops at ``most`` times its source's size;
    what is above goes to the others by weight. Capped sources are a prefix of the order by size over weight, so one
    pass over the running sums finds them. This works on one row per source; the windows see that table only.
    """
    turn = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight.cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("_weight"), F.asc_nulls_last("source"))
    after = order.rowsBetween(0, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    ranked = ranked.withColumn("_left", left).withColumn("_weights", F.sum("_weight").over(after)) \
        .withColumn("_capped", F.col("_left").cast("double") * F.col("_weight")
                    > F.lit(float(most)) * F.col("source_size") * F.col("_weights"))
    level = F.min(F.when(~F.col("_capped"), F.struct(
        F.col("source_size") / F.col("_weight"), F.col("source").isNull(), "source", "_left", "_weights"))).over(whole)
    return ranked.withColumn("_level", level).select(
        "source", "source_size",
        F.when(F.col("_capped"), F.lit(float(most)) * F.col("source_size"))
        .otherwise(F.col("_weight").cast("double") * F.col("_level._left").cast("double")
                   / F.col("_level._weights").cast("double")).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, labels: DataFrame | None = None, identifier: str = "doc_id",
        text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES,
        buckets: int = BUCKETS, columns: Sequence[str] = ()) -> DataFrame:
    """Words that the mix takes of every document, repeats counted.

    A document is drawn the earlier, the higher its weight: ``quality`` (positive), else from ``labels`` (identifier,
    quality; the best of repeated labels counts), else 1. A null source is a source of its own; null and empty texts
    have size 0 and take part with 0 words. Rows that repeat an identifier draw the same key and are told apart by
    size. Reruns agree, as keys depend on the identifier alone. An empty table gives no rows.

    Returns doc_id, size, source_size, target, taken, passes (complete ones) and ``columns`` in the struct ``row``.
    """
    drawn = docs.select(
        F.struct(*[F.col(c) for c in columns] or [F.lit(None).cast("int").alias("none")]).alias("row"),
        F.col(identifier).alias("doc_id"), F.col(source).alias("source"), count_words(text_of(text)).alias("size"),
        (F.lit(1.0) if quality is None else quality).cast("double").alias("_weight"))
    if labels is not None:
        best = labels.groupBy(F.col(identifier).alias("_id")).agg(F.max("quality").alias("_label"))
        chance = F.when(F.col("_label") >= 1, GOOD).when(F.col("_label") < 1, BAD).otherwise(UNKNOWN)
        drawn = drawn.join(best, F.col("doc_id") == F.col("_id"), "left").withColumn("_weight", chance)
    drawn = drawn.withColumn("_key", -F.log(unit_interval(F.col("doc_id"))) / F.col("_weight"))
    drawn = stored(drawn.select("row", "doc_id", "source", "size", "_key", F.least(
        F.lit(buckets - 1), F.floor(F.lit(float(buckets)) * (1 - F.exp(-F.col("_key"))))).cast("int").alias("_bucket")))
    plan = stored(budgets(drawn.groupBy("source", "_bucket").agg(F.sum("size").alias("_slot")), weights, most))
    planned = with_plan(drawn, plan, buckets)
    clear = planned.filter("_edge IS NULL OR _bucket <> _edge") \
        .withColumn("_part", F.when(F.col("_bucket") < F.col("_edge"), F.col("size")).otherwise(0))
    inside = W.partitionBy("source").orderBy("_key", F.asc_nulls_last("doc_id"), "size") \
        .rowsBetween(W.unboundedPreceding, -1)
    edge = planned.filter("_bucket = _edge").withColumn("_part", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("_room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    return clear.unionByName(edge).select(
        "row", "doc_id", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("_part")).alias("taken"), "passes")


def with_plan(drawn: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """Every row with the plan of its source.

    A plan of up to ``PLAN_BYTES`` goes to every task and the rows stay where they are. A larger one is
    repeated for each bucket and joined on source and bucket, so that the rows of a large source are dealt over many tasks.
    """
    share = ["d.*", "source_size", "target", "passes", "_edge", "_room"]
    size = plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48)).first()[0] or 0
    if size <= PLAN_BYTES:
        return drawn.alias("d").join(F.broadcast(plan).alias("p"), F.expr("d.source <=> p.source")).select(share)
    each = plan.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return drawn.alias("d").join(each.alias("p"), F.expr("d.source <=> p.source AND d._bucket = p._slot")).select(share)


def budgets(slots: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: target, complete passes, the bucket in which the rest of the budget ends (null if the source has no
    words) and the words left for that bucket."""
    plan = targets(slots.groupBy("source").agg(F.sum("_slot").alias("source_size")), weights, most) \
        .withColumn("_budget", F.floor(F.col("target") + 0.5).cast("long")) \
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0)) \
        .withColumn("_rest", F.col("_budget") - F.col("passes") * F.col("source_size"))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    running = slots.withColumn("_before", F.coalesce(F.sum("_slot").over(earlier), F.lit(0)))
    edges = running.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source AND _before <= _rest AND _before + _slot > _rest")) \
        .select(F.col("r.source").alias("source"), F.col("_bucket").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_room"))
    return plan.alias("p").join(edges.alias("e"), F.expr("p.source <=> e.source"), "left") \
        .select("p.source", "source_size", "target", "passes", "_edge", "_room")


def repeat_rows(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """The mixed collection: each document as often as the mix takes it, the last, cut pass counting as one."""
    mixed = mix(docs, quality, columns=docs.columns, **options)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.filter("taken > 0").select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def letter_share(text: str = "text") -> Column:
    """A quality weight from the text alone: the share of letters and spaces, between 0.1 and 1."""
    body = text_of(text)
    junk = F.length(F.regexp_replace(body, r"[\p{L}\s]+", "")) / F.greatest(F.length(body), F.lit(1))
    return F.greatest(F.lit(0.1), 1 - junk)


SQL = r"""
WITH best AS (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN quality >= 1 THEN 1.0::DOUBLE WHEN quality < 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS k
  FROM documents LEFT JOIN best ON doc_id = id),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT
            - coalesce((sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
         (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
c AS (SELECT *, rest::DOUBLE * w > 3.0::DOUBLE * source_size * ws AS capped FROM r),
l AS (SELECT rest, ws FROM c WHERE NOT capped ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size
         ELSE w::DOUBLE * (SELECT rest FROM l)::DOUBLE / (SELECT ws FROM l)::DOUBLE END AS target FROM c),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
q AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes,
             budget, coalesce((sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, passes::BIGINT AS passes,
       (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
FROM q
"""
