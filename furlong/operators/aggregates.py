"""Records, rates and profiles: plain aggregations with partial combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.functions.derive import ratio
from furlong.sources.layouts import COUNTERS


def _counts(position: Column) -> list[Column]:
    return [F.count_if(position == 1), F.count_if(position == 2), F.count_if(position == 3), F.count_if(position > 3)]


def placings(position: Column) -> list[Column]:
    """Counters win (1st), place (2nd), show (3rd) and out (beyond)."""
    return [count.alias(name) for count, name in zip(_counts(position), COUNTERS, strict=True)]


def condition_record(df: DataFrame, entity: Sequence[str], conditions: Mapping[str, Column],
                     position: str) -> DataFrame:
    """Counters per entity, condition and its value, as long rows.

    Each row is expanded to one row per condition and pre-aggregated before the
    shuffle, so one pass serves all conditions.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("condition"), c.cast("string").alias("condition_value"))
                      for n, c in conditions.items()])
    return (
        df.select(*entity, position, F.inline(pairs))
        .groupBy(*entity, "condition", "condition_value").agg(*placings(F.col(position)))
    )


@dataclass(frozen=True)
class Condition:
    """Whose record (``entity``, a column), split by which ``values`` (columns), over which rows (``when``)."""

    entity: str
    values: tuple[str, ...] = ()
    when: Column | None = None


def condition_groups(going: str = "going", pace: str = "pace", organiser: str = "organiser") -> dict[str, Condition]:
    """The condition groups of an entry's record, under their published names.

    Columns are those of the joined results: horse_id, jockey_code, trainer_code, owner_code, blinker, course_type,
    distance, venue_code, layoff, direction, season, bracket_number, and the three named by the parameters.
    """
    horse, jockey = "horse_id", "jockey_code"
    return {
        "jra": Condition(horse, when=F.col(organiser) == "jra"),
        "exchange": Condition(horse, when=F.col(organiser) == "exchange"),
        "other": Condition(horse, when=F.col(organiser) == "other"),
        "surface": Condition(horse, ("course_type",)),
        "surface_dist": Condition(horse, ("course_type", "distance")),
        "track_dist": Condition(horse, ("venue_code", "course_type", "distance")),
        "rotation": Condition(horse, ("layoff",)),
        "direction": Condition(horse, ("direction",)),
        "jockey": Condition(horse, (jockey,)),
        "good": Condition(horse, when=F.col(going) == "良"),
        "slightly_heavy": Condition(horse, when=F.col(going) == "稍重"),
        "heavy": Condition(horse, when=F.col(going).isin("重", "不良")),
        "slow_pace": Condition(horse, when=F.col(pace) == "S"),
        "medium_pace": Condition(horse, when=F.col(pace) == "M"),
        "high_pace": Condition(horse, when=F.col(pace) == "H"),
        "season": Condition(horse, ("season",)),
        "bracket": Condition(horse, ("bracket_number",)),
        "jockey_dist": Condition(jockey, ("distance",)),
        "jockey_track_dist": Condition(jockey, ("venue_code", "distance")),
        "jockey_trainer": Condition(jockey, ("trainer_code",)),
        "jockey_owner": Condition(jockey, ("owner_code",)),
        "jockey_blinker": Condition(jockey, ("blinker",)),
        "trainer_owner": Condition("trainer_code", ("owner_code",)),
    }


#: Columns of rows that are dealt out by entity: which entity of the row it is, what its rows are split by besides, and the
#: conditions whose ``when`` holds, a bit each.
ENTITY_NO, PART, WHEN = "_entity_no", "_part", "_when"


def _joined_text(values: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(f"_t_{x}").cast("string") for x in values])


def _owners(conditions: Mapping[str, Condition]) -> list[str]:
    return list(dict.fromkeys(c.entity for c in conditions.values()))


def _values(conditions: Mapping[str, Condition]) -> list[str]:
    return list(dict.fromkeys(x for c in conditions.values() for x in c.values))


def _bits(conditions: Mapping[str, Condition]) -> dict[str, int]:
    bits = {name: 1 << i for i, name in enumerate(n for n, c in conditions.items() if c.when is not None)}
    if len(bits) > 63:
        raise ValueError("more than 63 conditions with a test of their own")
    return bits


def _when(conditions: Mapping[str, Condition]) -> Column:
    """The bits of the conditions whose test holds; a test that is NULL does not."""
    return reduce(lambda a, b: a + b, [F.when(conditions[n].when, F.lit(bit)).otherwise(F.lit(0)) for n, bit in _bits(conditions).items()], F.lit(0)).cast("bigint")


def _by_entity(df: DataFrame, kept: Mapping[str, Column], conditions: Mapping[str, Condition], filtered: bool) -> DataFrame:
    """One row per row and entity of it, with the values its conditions look at, dealt out by entity.

    The expand to conditions comes after this shuffle, so that moves a row once per entity and not once per condition, with
    values as they are and tests as bits. The rows of an entity with a single condition are split by its value as well.
    """
    owners = _owners(conditions)
    own = {e: [c for c in conditions.values() if c.entity == e] for e in owners}
    tested = [e for e in owners if filtered and any(c.when is not None for c in own[e])]
    number = F.col(ENTITY_NO)

    def by_owner(choices: Mapping[int, Column], otherwise: Column) -> Column:
        return F.coalesce(*[F.when(number == n, c) for n, c in choices.items()], otherwise)

    def shared(column: str, users: Sequence[str]) -> Column:
        return F.when(number.isin(*[owners.index(e) for e in users]), F.col(column)).alias(column)

    users = {f"_t_{x}": [e for e in owners if any(x in c.values for c in own[e])] for x in _values(conditions)} | ({WHEN: tested} if tested else {})
    parts = {owners.index(e): _joined_text(own[e][0].values) for e in owners if len(own[e]) == 1}
    rows = df.select(*[c.alias(n) for n, c in kept.items()], *[F.col(e).cast("string").alias(f"_e_{e}") for e in owners],
                     *[F.col(x).alias(f"_t_{x}") for x in _values(conditions)], *[_when(conditions).alias(WHEN)] if tested else [],
                     F.explode(F.array(*[F.lit(n) for n in range(len(owners))])).alias(ENTITY_NO))
    rows = rows.select(*kept, ENTITY_NO, by_owner({n: F.col(f"_e_{e}") for n, e in enumerate(owners)}, F.lit(None)).alias("entity"),
                       by_owner(parts, F.lit("")).alias(PART), *[shared(c, u) for c, u in users.items()])
    return rows.where(F.col("entity").isNotNull()).repartition("entity", PART)


def _tagged(df: DataFrame, kept: Mapping[str, Column], conditions: Mapping[str, Condition], filtered: bool, by_entity: bool = False) -> DataFrame:
    """Columns ``kept`` of a row with (kind, entity, value) of every condition it counts for; none where a key or a value is missing.

    ``kind`` is the number of the condition. Texts are made once a row, before the expand. With ``by_entity`` rows are dealt
    out by entity before the expand and have the column PART.
    """
    joined = list(dict.fromkeys(c.values for c in conditions.values() if len(c.values) > 1))
    if by_entity:
        rows = _by_entity(df, kept, conditions, filtered)
        columns, tests = [*kept, "entity", PART, ENTITY_NO], {n: F.col(WHEN).bitwiseAND(F.lit(bit)) != 0 for n, bit in _bits(conditions).items()}
        texts = rows.select(*columns, *[F.col(WHEN)] if WHEN in rows.columns else [], *[F.col(f"_t_{x}").cast("string").alias(f"_t_{x}") for x in _values(conditions)])
    else:
        columns = list(dict.fromkeys(x for c in conditions.values() for x in (c.entity, *c.values)))
        tests = {n: F.col(f"_w_{n}") for n in _bits(conditions)}
        texts = df.select(*[c.alias(n) for n, c in kept.items()], *[F.col(x).cast("string").alias(f"_t_{x}") for x in columns],
                          *[conditions[n].when.alias(f"_w_{n}") for n in tests if filtered])
    texts = texts.select("*", *[_joined_text(values).alias(f"_j_{i}") for i, values in enumerate(joined)])

    def tag(i: int, name: str, c: Condition) -> Column:
        entity = F.col("entity") if by_entity else F.col(f"_t_{c.entity}")
        known = reduce(lambda a, b: a & b, [entity.isNotNull(), *[F.col(f"_t_{x}").isNotNull() for x in c.values]])
        if filtered and name in tests:
            known = known & tests[name]
        value = F.lit("all") if not c.values else F.col(f"_t_{c.values[0]}") if len(c.values) == 1 else F.col(f"_j_{joined.index(c.values)}")
        return F.struct(F.when(known, F.lit(i).cast("tinyint")).alias("kind"), *[] if by_entity else [entity.alias("entity")], value.alias("condition_value"))

    def tags(owner: str | None = None) -> Column:
        return F.array(*[tag(i, n, c) for i, (n, c) in enumerate(conditions.items()) if owner in (None, c.entity)])

    if not by_entity:
        return texts.select(*kept, F.inline(tags())).where(F.col("kind").isNotNull())
    own = F.coalesce(*[F.when(F.col(ENTITY_NO) == n, tags(e)) for n, e in enumerate(_owners(conditions))])
    return texts.select(*kept, "entity", PART, F.inline(own)).where(F.col("kind").isNotNull())


def _wide(conditions: Mapping[str, Condition]) -> list[str]:
    return [f"{name}_{c}" for name in conditions for c in COUNTERS]


def _known(conditions: Mapping[str, Condition], here: Column) -> Column:
    """Whether any of the conditions looks at a row of the owner at ``here``."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"_t_{x}").isNotNull() for x in c.values], here) for c in conditions.values()], F.lit(False))


def _counted(rows: DataFrame, entity: Sequence[str], conditions: Mapping[str, Condition], here: Mapping[str, Column]) -> DataFrame:
    """``rows`` with the counters ``<condition>_<counter>`` of their entity beside them, 0 where a value is missing.

    ``rows`` are dealt out by ``entity``; ``here`` tells for each owner whether a row is about it. Conditions that look at the
    same values share a window.
    """
    bits, groups = _bits(conditions), {}
    for name, c in conditions.items():
        groups.setdefault(c.values, []).append(name)
    for values in sorted(groups, key=lambda v: not v):  # without values last, as any order of the rows serves it
        known = reduce(lambda a, b: a & b, [F.col(f"_t_{x}").isNotNull() for x in values], F.lit(True))
        whole = W.partitionBy(*entity, "_value") if values else W.partitionBy(*entity)
        counters = {}
        for name in groups[values]:
            own = known & here[conditions[name].entity]
            test = own & (F.col(WHEN).bitwiseAND(F.lit(bits[name])) != 0) if name in bits else own
            counters |= {f"{name}_{k}": F.when(own, count.over(whole)).otherwise(F.lit(0))
                         for k, count in zip(COUNTERS, _counts(F.when(test, F.col("_position"))), strict=True)}
        rows = rows.withColumn("_value", F.when(known, _joined_text(values))).withColumns(counters).drop("_value")
    return rows


def _records_beside(df: DataFrame, ids: Sequence[str], conditions: Mapping[str, Condition], position: str) -> DataFrame:
    """The records of all entities of a row, summed over the rows that share ``ids``: ``<condition>_<counter>``.

    Rows are dealt out by entity, counted in windows and sent back to where the entity among ``ids`` is, the horse of an
    entry; its own records are counted there, so those, the most, are never sent. The rows of an entity are one task's, and are sorted and streamed.
    """
    home = next((e for e in _owners(conditions) if e in ids), None)
    own, away = ({n: c for n, c in conditions.items() if (c.entity == home) == b} for b in (True, False))
    kept = {**{i: F.col(i) for i in ids}, "_position": F.col(position)}
    place = F.concat_ws("/", *[F.col(i).cast("string") for i in ids])
    place = place if home is None else F.coalesce(F.col(home).cast("string"), place)  # rows without a horse are spread
    rows = df.select(*[c.alias(n) for n, c in kept.items()], *[F.col(x).alias(f"_t_{x}") for x in _values(own)], _when(own).alias(WHEN),
                     place.alias("entity"), (F.lit(False) if home is None else F.col(home).isNotNull()).alias("_here")) \
        .repartition("entity").withColumn("_ids", F.struct(*ids))
    rows = rows.withColumn("_any", _known(own, F.col("_here")))
    if away:
        here = {e: F.col(ENTITY_NO) == n for n, e in enumerate(_owners(away))}
        sent = _by_entity(df, kept, away, True)
        sent = sent if WHEN in sent.columns else sent.withColumn(WHEN, F.lit(0))
        sent = sent.where(reduce(lambda a, b: a | b, [_known({n: c for n, c in away.items() if c.entity == e}, h) for e, h in here.items()]))
        sent = _counted(sent, ["entity", PART, ENTITY_NO], away, here).select(*ids, *_wide(away))
        sent = sent.withColumn("_place", place).repartition("_place").groupBy("_place", *ids).agg(*[F.sum(c).alias(c) for c in _wide(away)])
        sent = sent.select("_place", F.struct(*ids).alias("_for"), *_wide(away))
        rows = rows.join(sent, (F.col("entity") == F.col("_place")) & (F.col("_ids") == F.col("_for")), "left") \
            .withColumn("_any", F.col("_any") | F.col("_place").isNotNull())
    rows = _counted(rows, ["entity", "_here"], own, {home: F.col("_here")}) if own else rows
    # the counters sent back are those of all rows that share the ids
    return rows.where("_any").groupBy("entity", *ids).agg(*[F.sum(c).alias(c) for c in _wide(own)], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in _wide(away)]) \
        .select(*ids, *_wide(conditions))


def _name(conditions: Mapping[str, Condition]) -> Column:
    """The name of the condition numbered ``kind``."""
    return F.element_at(F.array(*[F.lit(n) for n in conditions]), F.col("kind") + 1).alias("condition")


def named_records(df: DataFrame, conditions: Mapping[str, Condition], position: str, by_entity: bool = False,
                  beside: Sequence[str] | None = None) -> DataFrame:
    """Counters of several kinds of entities under their conditions: one row per condition, entity and value.

    One tagged expand serves all of them, and the counters are combined before the shuffle, so an entity that owns a
    large share of the rows sends one row per value and task. With ``by_entity`` rows are dealt out by entity before the
    expand instead and the records stay there, for ``entry_records``; they have two columns more, ``kind`` and PART. A row is
    then shuffled once per entity, and the rows of one entity are one task's. With ``beside``, the columns that name an entry, the
    records come beside the rows that they were counted from: one row per entry with ``<condition>_<counter>`` of all its conditions.
    """
    if beside is not None:
        return _records_beside(df, list(beside), conditions, position)
    extra = ["kind", PART] if by_entity else []
    return _tagged(df, {"_position": F.col(position)}, conditions, True, by_entity) \
        .groupBy("kind", "entity", "condition_value", *extra[1:]).agg(*placings(F.col("_position"))) \
        .select(_name(conditions), "entity", "condition_value", *COUNTERS, *extra)


def entry_records(entries: DataFrame, records: DataFrame, ids: Sequence[str], conditions: Mapping[str, Condition]) -> DataFrame:
    """The condition record of each entry: ``<condition>_<counter>`` of its horse, jockey and trainer under its own conditions.

    All conditions are looked up in one join on (condition, entity, value) and widened by entry; an unknown one counts 0.
    Records that were dealt out by entity meet entries dealt out alike: their join needs no shuffle of the expanded rows
    where ``spark.sql.requireAllClusterKeysForCoPartition`` is off. Records that were counted from these entries and came
    beside them need no further look.
    """
    wide = _wide(conditions)
    if set(wide) <= set(records.columns):
        return records.select(*ids, *wide)
    dealt = PART in records.columns
    wanted = _tagged(entries, {c: F.col(c) for c in ids}, conditions, False, dealt)
    if dealt:
        found = wanted.join(records.drop("condition"), ["entity", PART, "kind", "condition_value"], "left").select(*ids, _name(conditions), *COUNTERS)
    else:
        found = wanted.select(*ids, _name(conditions), "entity", "condition_value").join(records, ["condition", "entity", "condition_value"], "left")
    return widen_records(found, ids, list(conditions))


def widen_records(records: DataFrame, entity: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Long counter rows to one row per entity with ``<condition>_<counter>`` columns."""
    named = F.col("condition")
    return records.groupBy(*entity).agg(*[
        F.coalesce(F.sum(F.when(named == g, F.col(c))), F.lit(0)).alias(f"{g}_{c}")
        for g in conditions for c in COUNTERS])


def unpivot_counters(df: DataFrame, ids: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Wide counter columns to rows (group, win, place, show, out)."""
    rows = F.array(*[F.struct(F.lit(g).alias("counter_group"), *[F.col(f"{g}_{c}").alias(c) for c in COUNTERS])
                     for g in groups])
    return df.select(*ids, F.inline(rows))


def rates(counters: DataFrame) -> DataFrame:
    """Starts and win, quinella (first two) and place (first three) rates."""
    win, place, show, out = (F.col(c) for c in COUNTERS)
    starts = win + place + show + out
    return counters.withColumn("starts", starts) \
        .withColumn("win_rate", ratio(win, starts)) \
        .withColumn("quinella_rate", ratio(win + place, starts)) \
        .withColumn("place_rate", ratio(win + place + show, starts))


def sire_record(results: DataFrame, pedigree: DataFrame, sire: str, surface: str, position: str,
                distance: str, horse: str = "horse_id") -> DataFrame:
    """Turf and dirt place rate and mean placed distance of a sire's offspring."""
    placed = F.col(position).between(1, 3)
    joined = results.join(pedigree.select(horse, sire), horse)

    def rate(kind: str) -> Column:
        return F.avg(F.when(F.col(surface) == kind, placed.cast("int")))

    return joined.groupBy(sire).agg(
        rate("turf").alias("turf_place_rate"), rate("dirt").alias("dirt_place_rate"),
        F.avg(F.when(placed, F.col(distance))).alias("avg_place_distance"))


def par_times(results: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation of a time per course conditions."""
    return results.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.avg(value).alias("par_mean"), F.stddev_samp(value).alias("par_sd"))


def style_rates(results: DataFrame, entity: Sequence[str], first_corner: str, last_corner: str) -> DataFrame:
    """How often an entity led, was prominent, and was within fifth at the last corner."""
    def share(cond: Column) -> Column:
        return F.avg(cond.cast("int"))

    return results.groupBy(*entity).agg(
        share(F.col(first_corner) == 1).alias("escape_rate"),
        share(F.col(first_corner).between(1, 4)).alias("lead_rate"),
        share(F.col(last_corner).between(1, 5)).alias("within5_rate"))


def group_rates(results: DataFrame, keys: Sequence[str], position: str,
                levels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Starts, win and place rate per key; ``levels`` gives several groupings in one pass.

    With levels, ``level`` is the grouping id: the bits of the keys that were
    rolled up.
    """
    aggs = [F.count("*").alias("starts"), F.avg((F.col(position) == 1).cast("int")).alias("win_rate"),
            F.avg(F.col(position).between(1, 3).cast("int")).alias("place_rate")]
    if levels is None:
        return results.groupBy(*keys).agg(*aggs)
    sets = [[F.col(c) for c in level] for level in levels]
    return results.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), *aggs)


def layoff_band(rest_days: Column) -> Column:
    """Rest before a run, in weeks bands."""
    return (
        F.when(rest_days.isNull(), "first").when(rest_days <= 13, "1w").when(rest_days <= 27, "2-3w")
        .when(rest_days <= 62, "4-8w").when(rest_days <= 180, "9-25w").otherwise("26w+")
    )


def profile(results: DataFrame, entity: Sequence[str], position: str, figure: str) -> DataFrame:
    """Consistency: position variance, board (first five) rate, best figure. Position 0 is no finish and has no variance."""
    return results.groupBy(*entity).agg(
        F.var_samp(F.when(F.col(position) >= 1, F.col(position))).alias("position_variance"),
        F.avg(F.col(position).between(1, 5).cast("int")).alias("board_rate"),
        F.max(figure).alias("best_figure"))


def earnings(results: DataFrame, entity: Sequence[str], prize: str) -> DataFrame:
    return results.groupBy(*entity).agg(F.count("*").alias("starts"), F.sum(prize).alias("prize_total"))
