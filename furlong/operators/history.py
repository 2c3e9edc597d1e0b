"""Features of an entity's earlier runs.

Every history excludes the current row and all rows of the same day: the runs
of one day share the values computed before that day.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators.groups import keyed

Feature = Callable[[WindowSpec], Column]
RUN_NO = "_run_no"


def last_n(order: WindowSpec, n: int) -> WindowSpec:
    return order.rowsBetween(-n, -1)


def with_history(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str],
                 inputs: Sequence[str], features: Mapping[str, Feature], depth: int, dealt: bool = False) -> DataFrame:
    """Add features that look at up to ``depth`` earlier runs.

    Each feature maps the ordered window of an entity to a column using frames
    within ``depth`` rows before the current one (``lag`` or ``last_n``) over
    ``inputs``. ``tie`` orders runs of one day.

    Only the last ``depth`` runs of a day can matter to later days, so only
    those are kept (pruned before the shuffle as well): the window of an entity
    sees at most ``depth`` rows per calendar day, however many rows it owns.
    Features are computed once per day and joined back by entity and day, which
    spreads a dominant entity over its days. Rows without an entity have no
    history.

    With ``dealt`` the rows are dealt out by entity and stay there: the values of
    a day's first run are handed to its other rows in the same sort, without
    pruning and join, so the runs of an entity are one task's.
    """
    entity, tie = list(entity), list(tie)
    order = W.partitionBy(*entity).orderBy(day, *tie)
    one_day = W.partitionBy(*entity, day).orderBy(*tie)
    if dealt:
        rows = df.withColumn(RUN_NO, F.row_number().over(order)).withColumns({f"_h_{name}": make(order) for name, make in features.items()})
        so_far = one_day.rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({name: F.when(keyed([*entity, day]), F.first(f"_h_{name}").over(so_far)) for name in features}) \
            .drop(RUN_NO, *[f"_h_{name}" for name in features])
    columns = list(dict.fromkeys([*entity, day, *tie, *inputs]))
    latest = W.partitionBy(*entity, day).orderBy(*[F.col(c).desc() for c in tie])
    tails = df.where(keyed(entity)).select(*columns).withColumn("_back", F.row_number().over(latest)) \
        .where(F.col("_back") <= depth).drop("_back")
    per_day = (
        tails.withColumn(RUN_NO, F.row_number().over(order))
        .withColumns({f"_h_{name}": make(order) for name, make in features.items()})
        .withColumn("_first", F.row_number().over(one_day)).where(F.col("_first") == 1)
        .select(*entity, day, *[F.col(f"_h_{name}").alias(name) for name in features])
    )
    return df.join(per_day, [*entity, day], "left")


def past_n(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str], value: str,
           ns: Sequence[int] = (3, 5, 10), how: Sequence[str] = ("avg",)) -> DataFrame:
    """Aggregates of the last n runs, named ``past_<n>_<how>_<value>``."""
    functions = {"avg": F.avg, "max": F.max, "min": F.min, "sd": F.stddev_samp, "count": F.count, "sum": F.sum}
    features = {
        f"past_{n}_{h}_{value}": (lambda order, n=n, h=h: functions[h](value).over(last_n(order, n)))
        for n in ns for h in how
    }
    return with_history(df, entity, day, tie, [value], features, max(ns))


def previous(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str],
             columns: Sequence[str], k: int = 1) -> DataFrame:
    """Values of the k-th last run, named ``prev<k>_<column>``."""
    features = {f"prev{k}_{c}": (lambda order, c=c: F.lag(c, k).over(order)) for c in columns}
    return with_history(df, entity, day, tie, columns, features, k)


def form_trend(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str], value: str,
               n: int = 3) -> DataFrame:
    """Slope of the last n figures by run number; NULL below two figures."""
    slope = {f"trend_{n}_{value}": lambda order: F.regr_slope(F.col(value), F.col(RUN_NO))
             .over(last_n(order, n))}
    return with_history(df, entity, day, tie, [value], slope, n)


def changes(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str],
            numeric: Sequence[str] = (), switched: Sequence[str] = ()) -> DataFrame:
    """Change of numeric conditions and switch flags (jockey, stable) against the previous run."""
    out = previous(df, entity, day, tie, [*numeric, *switched], 1)
    out = out.withColumns({f"{c}_change": F.col(c) - F.col(f"prev1_{c}") for c in numeric}
                          | {f"{c}_switch": F.col(c) != F.col(f"prev1_{c}") for c in switched})
    return out.drop(*[f"prev1_{c}" for c in (*numeric, *switched)])


def against_own_mean(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str], value: str,
                     n: int = 10) -> DataFrame:
    """Current condition score minus the entity's mean over its last n runs."""
    out = past_n(df, entity, day, tie, value, [n], ["avg"])
    mean = f"past_{n}_avg_{value}"
    return out.withColumn(f"{value}_vs_own", F.col(value) - F.col(mean)).drop(mean)


# -- one row per entity and day ---------------------------------------------

def entity_days(df: DataFrame, entity: Sequence[str], day: str, tie: Sequence[str] = (),
                condition: str | None = None) -> DataFrame:
    """Runs per entity and day, with the day's last condition.

    Pre-aggregated before the shuffle, so an entity has at most one row per
    calendar day however many rows it owns; the windows below rely on that.
    """
    aggs = [F.count("*").alias("runs")]
    if condition:
        aggs.append(F.max_by(condition, F.struct(*tie)).alias("condition"))
    return df.groupBy(*entity, day).agg(*aggs)


def rest_features(days: DataFrame, entity: Sequence[str], day: str, layoff: int = 90,
                  back_to_back: int = 7) -> DataFrame:
    """Rest days and weeks, back-to-back flag, run number since the last layoff, career starts."""
    order = W.partitionBy(*entity).orderBy(day)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    island = W.partitionBy(*entity, "_island").orderBy(day)
    rest = F.date_diff(F.col(day), F.lag(day).over(order))
    return (
        days.withColumn("rest_days", rest)
        .withColumn("rest_weeks", F.floor(F.col("rest_days") / 7))
        .withColumn("back_to_back", F.col("rest_days") <= back_to_back)
        .withColumn("career_starts", F.coalesce(F.sum("runs").over(earlier), F.lit(0)))
        .withColumn("_fresh", (F.col("rest_days").isNull() | (F.col("rest_days") >= layoff)).cast("int"))
        .withColumn("_island", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("runs_since_layoff", F.row_number().over(island))
        .drop("_fresh", "_island")
    )


def condition_streak(days: DataFrame, entity: Sequence[str], day: str) -> DataFrame:
    """How many race days in a row, including this one, had the same condition."""
    order = W.partitionBy(*entity).orderBy(day)
    island = W.partitionBy(*entity, "_island").orderBy(day)
    same = F.col("condition").eqNullSafe(F.lag("condition").over(order))
    return (
        days.withColumn("_new", (~same).cast("int"))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("streak", F.row_number().over(island))
        .drop("_new", "_island")
    )


# -- cumulative state before a day ------------------------------------------

def state_before(df: DataFrame, keys: Sequence[str], day: str, sums: Mapping[str, Column]) -> DataFrame:
    """Running totals per key and day over strictly earlier days.

    Rows are summed per key and day first (partial aggregation, at most one row
    per key and calendar day), then accumulated. With ``keys`` empty the result
    has one row per calendar day, which one task can accumulate; ``day`` must
    therefore be a date.
    """
    if not isinstance(df.schema[day].dataType, T.DateType):
        raise TypeError(f"{day} must be a date, not {df.schema[day].dataType.simpleString()}")
    daily = df.groupBy(*keys, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    frame = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    return daily.withColumns({n: F.sum(n).over(frame) for n in sums})


def totals_before(df: DataFrame, keys: Sequence[str], day: str, sums: Mapping[str, Column]) -> DataFrame:
    """Add running totals over strictly earlier days of the same key, beside each row and without a join.

    For rows that are dealt out by one of the keys and stay there, so the rows of
    a key are one task's, sorted and streamed; ``with_state`` sums a dominant key per
    day instead. ``day`` is a number of days. Rows without a key or a day have no
    totals and count in none.
    """
    earlier = W.partitionBy(*keys).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumns({n: F.when(keyed([*keys, day]), F.sum(F.when(keyed([day]), c)).over(earlier)) for n, c in sums.items()})


def attach_state(df: DataFrame, state: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Join totals back by key and day; a hot key is spread over its days."""
    if not keys:
        state = F.broadcast(state)  # one row per calendar day
    return df.join(state, [*keys, day], "left")


def with_state(df: DataFrame, keys: Sequence[str], day: str, sums: Mapping[str, Column]) -> DataFrame:
    """Add running totals over strictly earlier days of the same key; rows without a key have none."""
    return attach_state(df, state_before(df, keys, day, sums), list(keys), day)


def moments_before(df: DataFrame, keys: Sequence[str], day: str, values: Mapping[str, Column]) -> DataFrame:
    """Count, mean and standard deviation of each value per key over strictly earlier days.

    Deviations are taken from the key's first daily mean before they are
    squared and summed, so large values lose no digits.
    """
    daily = df.groupBy(*keys, day).agg(*[
        f for n, x in values.items() for f in (F.count(x).alias(f"_n_{n}"), F.avg(x).alias(f"_m_{n}"), F.var_pop(x).alias(f"_v_{n}"))])
    whole = W.partitionBy(*keys).orderBy(day)
    earlier = whole.rowsBetween(W.unboundedPreceding, -1)
    first = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = daily.withColumns({f"_o_{n}": F.first(f"_m_{n}", ignorenulls=True).over(first) for n in values})
    for n in values:
        rows, off = F.col(f"_n_{n}"), F.col(f"_m_{n}") - F.col(f"_o_{n}")
        out = out.withColumns({f"_c_{n}": F.sum(rows).over(earlier), f"_s_{n}": F.sum(rows * off).over(earlier),
                               f"_q_{n}": F.sum(rows * (F.col(f"_v_{n}") + off * off)).over(earlier)})
    stats = {}
    for n in values:
        rows, total, squares = F.col(f"_c_{n}"), F.col(f"_s_{n}"), F.col(f"_q_{n}")
        some = F.when(rows > 0, rows)
        variance = (squares - total * total / some) / F.when(rows > 1, rows - 1)
        stats |= {f"{n}_runs": rows, f"{n}_mean": F.col(f"_o_{n}") + total / some,
                  f"{n}_sd": F.when(variance > 0, F.sqrt(variance))}
    return out.select(*keys, day, *[c.alias(name) for name, c in stats.items()])


def standardised(df: DataFrame, keys: Sequence[str], day: str, values: Mapping[str, Column]) -> DataFrame:
    """(value - par mean) / par sd for each named value, the par taken over earlier days.

    All values share one set of running moments per condition and day.
    """
    out = attach_state(df, moments_before(df, keys, day, values), list(keys), day)
    out = out.withColumns({n: (x - F.col(f"{n}_mean")) / F.col(f"{n}_sd") for n, x in values.items()})
    return out.drop(*[f"{n}_{part}" for n in values for part in ("runs", "mean", "sd")])


def combine(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join several feature tables on the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)
