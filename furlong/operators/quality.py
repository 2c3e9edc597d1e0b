"""Rule-driven data-quality checks, fused into one aggregate per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.constants import constant_rows
from furlong.functions.derive import percentage

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
RESULT_SCHEMA = ("check_name string, table_name string, passed boolean, severity string, "
                 "message string, details map<string,string>")


# The message texts of a report, {} standing for a value; the detail keys below are fixed as well.
MESSAGES = {
    "exists": "テーブル {} が存在します",
    "missing": "テーブル {} が存在しません",
    "rows": "レコード数: {} (最低期待値: {})",
    "nulls": "カラム '{}': NULL件数 {} / {} ({}%)",
    "duplicates": "主キー ({}): 重複件数 {} / {}",
    "dates": "カラム '{}': 範囲 {} ~ {} {}",
    "numbers": "カラム '{}': 範囲 {} ~ {} (期待値: {} ~ {}) {}",
    "too_old": "古すぎる日付: {}件",
    "too_future": "未来すぎる日付: {}件",
    "below_min": "最小値未満: {}件",
    "above_max": "最大値超過: {}件",
    "normal": "正常",
    "no_value": "None",
}


@dataclass(frozen=True)
class TableCheck:
    """What to check on one table; ``ranges`` overrides the common numeric bounds."""

    dataset: str
    table: str
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    min_rows: int = 0
    description: str = ""
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.dataset}.{self.table}"


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    severity: str


# The five rules, date window, numeric bounds and table configurations.
RULES = (
    Rule("null_check", "required columns hold no NULL", ERROR),
    Rule("duplicate_check", "the key is unique", ERROR),
    Rule("row_count_check", "at least the expected number of rows", WARNING),
    Rule("date_range_check", "dates lie in the accepted window", WARNING),
    Rule("numeric_range_check", "numbers lie within their bounds", INFO),
)
SEVERITY = {rule.name: rule.severity for rule in RULES} | {"table_exists": ERROR}
MIN_DATE = date(2016, 1, 1)
MAX_FUTURE_DAYS = 7
NUMERIC_RANGES = {
    "race_number": (1, 12), "distance": (800, 4000), "num_horses": (1, 18),
    "base_odds": (1.0, 10000.0), "base_popularity": (1, 18), "odds_value": (1.0, 100000.0),
}
TABLE_CHECKS = (
    TableCheck("raw", "race_info", ("race_id",), ("race_id", "race_date", "venue_code", "race_number"),
               ("race_date",), ("race_number", "distance", "num_horses"), 1000, "races"),
    TableCheck("raw", "horse_results", ("race_id", "horse_id"), ("race_id", "horse_id"),
               (), ("base_odds", "base_popularity"), 10000, "entries"),
    TableCheck("raw", "pedigree", ("horse_id",), ("horse_id",), min_rows=1000, description="pedigree"),
    TableCheck("raw", "odds", ("race_id", "horse_id", "odds_type", "odds_timestamp"),
               ("race_id", "horse_id", "odds_type"), ("odds_timestamp",), ("odds_value",), 1000, "odds"),
    TableCheck("features", "training_data", ("race_id", "horse_id"), ("race_id", "horse_id", "race_date"),
               ("race_date",), (), 10000, "training data"),
)


def rule_registry(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, [(r.name, r.description, r.severity) for r in RULES],
                         "name string, description string, severity string")


def select_checks(selector: str | None, checks: Sequence[TableCheck] = TABLE_CHECKS) -> list[TableCheck]:
    """Checks of one ``dataset.table``; split at the first dot, unknown names are an error."""
    if selector is None:
        return list(checks)
    dataset, dot, table = selector.partition(".")
    if not dot:
        raise ValueError("name the table as dataset.table")
    chosen = [c for c in checks if (c.dataset, c.table) == (dataset, table)]
    if not chosen:
        raise ValueError(f"no checks are configured for {selector}")
    return chosen


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(MESSAGES["no_value"]))


def _message(name: str, *values: Column | str) -> Column:
    """The named message with its values filled in."""
    texts = MESSAGES[name].split("{}")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [value.cast("string") if isinstance(value, Column) else F.lit(value), F.lit(text)]
    return F.concat(*parts)


def _row(check: TableCheck, name: str, passed: Column, message: Column, details: dict[str, Column]) -> Column:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(name).alias("check_name"), F.lit(check.name).alias("table_name"), passed.alias("passed"),
        F.lit(SEVERITY[name]).alias("severity"), message.alias("message"),
        F.create_map(*pairs).alias("details"))


def _issues(low: Column, low_name: str, high: Column, high_name: str) -> Column:
    found = F.concat_ws(", ", F.when(low > 0, _message(low_name, low)), F.when(high > 0, _message(high_name, high)))
    return F.when(found == "", MESSAGES["normal"]).otherwise(found)


# Each builder returns (aggregates, result rows over those aggregates).

def check_row_count(check: TableCheck) -> tuple[list[Column], list[Column]]:
    n = F.col("n")
    return [], [_row(check, "row_count_check", n >= check.min_rows,
                     _message("rows", F.format_number(n, 0), f"{check.min_rows:,}"),
                     {"row_count": n, "expected_min": F.lit(check.min_rows)})]


def check_nulls(check: TableCheck) -> tuple[list[Column], list[Column]]:
    aggs, rows = [], []
    n = F.col("n")
    for c in check.not_null:
        nulls = F.col(f"nulls_{c}")
        share = percentage(nulls, n)
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))
        rows.append(_row(
            check, "null_check", nulls == 0,
            _message("nulls", c, F.format_number(nulls, 0), F.format_number(n, 0), F.format_string("%.2f", share)),
            {"column": F.lit(c), "null_count": nulls, "total_count": n, "null_percentage": share}))
    return aggs, rows


def key_value(key: Sequence[str], mode: str) -> Column:
    """What counts as one key value.

    ``tuple`` compares the columns one by one. ``concat`` joins their text
    without a separator, where 1,11 equals 11,1 and a NULL hides the row.
    """
    if mode == "concat":
        return F.concat(*[F.col(c).cast("string") for c in key])
    return F.struct(*key)


def check_duplicates(check: TableCheck) -> list[Column]:
    """Result row over n and n_keys; the key count comes from its own plan, see table_aggregate."""
    if not check.key:
        return []
    n, extra = F.col("n"), F.col("n") - F.col("n_keys")
    return [_row(check, "duplicate_check", extra == 0,
                 _message("duplicates", ", ".join(check.key), F.format_number(extra, 0), F.format_number(n, 0)),
                 {"key_columns": F.lit(",".join(check.key)), "duplicate_count": extra, "total_count": n})]


def check_dates(check: TableCheck, as_of: date) -> tuple[list[Column], list[Column]]:
    aggs, rows = [], []
    latest = as_of + timedelta(days=MAX_FUTURE_DAYS)
    for c in check.dates:
        low, high, old, ahead = (F.col(f"{p}_{c}") for p in ("lo", "hi", "old", "ahead"))
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
                 F.count_if(F.col(c) < F.lit(MIN_DATE)).alias(f"old_{c}"),
                 F.count_if(F.col(c) > F.lit(latest)).alias(f"ahead_{c}")]
        rows.append(_row(
            check, "date_range_check", (old == 0) & (ahead == 0),
            _message("dates", c, _text(low), _text(high), _issues(old, "too_old", ahead, "too_future")),
            {"column": F.lit(c), "min_date": _text(low), "max_date": _text(high), "too_old_count": old,
             "too_future_count": ahead, "expected_min": F.lit(MIN_DATE.isoformat()),
             "expected_max": F.lit(latest.isoformat())}))
    return aggs, rows


def check_numbers(check: TableCheck) -> tuple[list[Column], list[Column]]:
    aggs, rows = [], []
    bounds = NUMERIC_RANGES | dict(check.ranges)
    for c in check.numbers:
        if c not in bounds:
            continue
        least, most = bounds[c]
        low, high, mean, below, above = (F.col(f"{p}_{c}") for p in ("lo", "hi", "avg", "below", "above"))
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg(c).alias(f"avg_{c}"),
                 F.count_if(F.col(c) < least).alias(f"below_{c}"),
                 F.count_if(F.col(c) > most).alias(f"above_{c}")]
        rows.append(_row(
            check, "numeric_range_check", (below == 0) & (above == 0),
            _message("numbers", c, _text(low), _text(high), str(least), str(most),
                     _issues(below, "below_min", above, "above_max")),
            {"column": F.lit(c), "min_val": low, "max_val": high, "avg_val": mean,
             "expected_min": F.lit(least), "expected_max": F.lit(most),
             "below_min_count": below, "above_max_count": above}))
    return aggs, rows


def exists_rows(spark: SparkSession, checks: Sequence[TableCheck], present: set[str]) -> DataFrame:
    rows = [("table_exists", c.name, c.name in present, ERROR,
             MESSAGES["exists" if c.name in present else "missing"].replace("{}", c.name), {})
            for c in checks]
    return constant_rows(spark, rows, RESULT_SCHEMA)


def table_aggregate(df: DataFrame, check: TableCheck, as_of: date, key_mode: str = "tuple") -> DataFrame:
    """Every check of one table as result rows.

    All counts, bounds and averages come from one aggregate over the table. The
    exact key count needs the keys grouped across the cluster, so it is planned
    as ``group by key`` followed by a count: both steps combine partially, so
    neither a repeated key nor the number of keys lands on one task.
    """
    builders = (check_row_count(check), check_nulls(check))
    later = (check_dates(check, as_of), check_numbers(check))
    aggs = [a for b in builders + later for a in b[0]]
    rows = [r for b in builders for r in b[1]] + check_duplicates(check) + [r for b in later for r in b[1]]
    summary = df.agg(F.count("*").alias("n"), *aggs)
    if check.key:
        keys = df.select(key_value(check.key, key_mode).alias("k")).where(F.col("k").isNotNull()) \
            .groupBy("k").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_keys"))
        summary = summary.withColumn("n_keys", keys.scalar())
    return summary.select(F.inline(F.array(*rows)))


def run_checks(spark: SparkSession, tables: Mapping[str, DataFrame | None], checks: Sequence[TableCheck],
               as_of: date, key_mode: str = "tuple") -> DataFrame:
    """Check results of all tables; a missing table (None or absent) only fails its existence check."""
    present = {c.name for c in checks if tables.get(c.name) is not None}
    parts = [exists_rows(spark, checks, present)]
    parts += [table_aggregate(tables[c.name], c, as_of, key_mode) for c in checks if c.name in present]
    return reduce(DataFrame.unionByName, parts)


def _totals() -> list[Column]:
    failed = ~F.col("passed")
    return [F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"),
            F.count_if(failed).alias("failed_checks"),
            *[F.count_if(failed & (F.col("severity") == s)).alias(f"{s.lower()}_count")
              for s in (ERROR, WARNING, INFO)]]


def _status() -> Column:
    return F.when(F.col("error_count") > 0, "FAILED").when(F.col("warning_count") > 0, "WARNING") \
        .otherwise("PASSED")


def summarise(results: DataFrame) -> DataFrame:
    """Totals, failed counts by severity and the overall status."""
    return results.agg(*_totals()).withColumn("status", _status())


def by_table(results: DataFrame) -> DataFrame:
    return results.groupBy("table_name").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def failed_checks(results: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == ERROR, 0).when(F.col("severity") == WARNING, 1).otherwise(2)
    return results.where(~F.col("passed")).orderBy(rank, "table_name", "check_name", "message")


def alerts(results: DataFrame) -> DataFrame:
    """Failed checks that call for an alert."""
    return results.where(~F.col("passed") & (F.col("severity") == ERROR))


def report(results: DataFrame, project: str, at: datetime) -> DataFrame:
    """One row: ids, summary struct and all results as an array (a few rows per table)."""
    stamp = F.lit(at).cast("timestamp")
    row = F.struct("table_name", "check_name", "passed", "severity", "message",
                   F.to_json("details").alias("details"), stamp.alias("timestamp"))
    totals = results.agg(*_totals(), F.array_sort(F.collect_list(row)).alias("results"))
    return totals.select(
        F.date_format(stamp, "yyyyMMdd_HHmmss").alias("report_id"), stamp.alias("generated_at"),
        F.lit(project).alias("project_id"),
        F.struct(*[c for c in totals.columns if c != "results"]).alias("summary"),
        _status().alias("status"), F.col("results"))
