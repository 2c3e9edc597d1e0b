"""Leak-free target encodings of high-cardinality keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.history import attach_state, state_before, with_state


def _uniform(row_key: Column, salt: str) -> Column:
    """Number in (0, 1) that depends only on the row key, not on partitioning."""
    digest = F.substring(F.md5(F.concat(row_key.cast("string"), F.lit(salt))), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 32)


def gaussian_noise(row_key: Column, sd: float) -> Column:
    """Reproducible normal noise (Box-Muller on two hashes of the row key)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(_uniform(row_key, "a")))
    return radius * F.cos(F.lit(2 * math.pi) * _uniform(row_key, "b")) * sd


def smoothed(total: Column, count: Column, prior: Column, m: float) -> Column:
    """Mean pulled towards the prior, as if ``m`` more rows had the prior's value."""
    return (F.coalesce(total, F.lit(0.0)) + m * prior) / (F.coalesce(count, F.lit(0)) + m)


def target_encode(df: DataFrame, keys: Sequence[str], day: str, targets: Mapping[str, Column], m: float = 10.0,
                  parents: Sequence[Sequence[str]] = (), period: str | None = None,
                  noise: float = 0.0, row_key: Column | None = None) -> DataFrame:
    """Smoothed mean of each target over strictly earlier days, per key.

    ``(sum + m * prior) / (count + m)``, where the prior is the mean over all
    earlier rows, or the encoding of the coarser key for each level of
    ``parents`` (coarsest first), so sparse pairs fall back on their parent.
    With ``period`` (month, year, ...) a row is encoded from earlier periods
    only. Target columns must not be NULL; rows before any history stay NULL.

    Totals per key and day are formed first, so the shuffles carry at most one
    row per key and calendar day and a dominant key costs no more than any
    other. Adds one column per target, named as in ``targets``.
    """
    at = "_at"
    base = df.withColumn(at, (F.date_trunc(period, day) if period else F.col(day)).cast("date"))
    sums = {f"_s_{n}": c.cast("double") for n, c in targets.items()} | {"_n": F.lit(1)}
    counts = [*sums]
    out = attach_state(base, state_before(base, [], at, sums), [], at)
    rows = F.when(F.col("_n") > 0, F.col("_n"))
    out = out.withColumns({f"_p_{n}": F.col(f"_s_{n}") / rows for n in targets}).drop(*counts)
    for level in [*parents, keys]:
        out = attach_state(out, state_before(base, level, at, sums), level, at)
        out = out.withColumns({
            f"_p_{n}": smoothed(F.col(f"_s_{n}"), F.col("_n"), F.col(f"_p_{n}"), m) for n in targets}).drop(*counts)
    for n in targets:
        value = F.col(f"_p_{n}")
        if noise:
            value = value + gaussian_noise(F.concat(row_key.cast("string"), F.lit(n)), noise)
        out = out.withColumn(n, value)
    return out.drop(at, *[f"_p_{n}" for n in targets])


def encode_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], day: str, target: Column, m: float = 10.0) -> DataFrame:
    """One target encoded by several key sets that share one prior; columns are named as in ``sets``."""
    sums = {"_s": target.cast("double"), "_n": F.lit(1)}
    overall = state_before(df, [], day, sums).select(day, (F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))).alias("_p"))
    out = attach_state(df, overall, [], day)
    for name, keys in sets.items():
        out = attach_state(out, state_before(df, keys, day, sums), list(keys), day)
        out = out.withColumn(name, smoothed(F.col("_s"), F.col("_n"), F.col("_p"), m)).drop(*sums)
    return out.drop("_p")


def prior_rate(df: DataFrame, keys: Sequence[str], day: str, hit: Column, name: str,
               when: Column | None = None) -> DataFrame:
    """Plain success rate over strictly earlier days, over the rows where ``when`` holds."""
    counted = F.lit(1) if when is None else F.when(when, 1)
    scored = F.when(hit, counted).otherwise(F.when(counted.isNotNull(), 0))
    return with_state(df, keys, day, {"_hits": scored, "_n": counted}) \
        .withColumn(name, F.col("_hits") / F.when(F.col("_n") > 0, F.col("_n"))).drop("_hits", "_n")
