"""Fixed-width ingestion: one declarative plan per record type.

Files of any size are read block by block; a block index numbers the lines and
settles the charset of each file. Each layout becomes a single ``select`` of
substring expressions. Every dropped line keeps a reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from furlong.functions import codes, fields as fx
from furlong.session import prepare
from furlong.sources import files as fs
from furlong.sources.layouts import LAYOUTS, read_fields
from furlong.sources.schemas import required_columns, table_schema

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
LISTING = ("path", "modificationTime", "length")


def decode_bytes(content: Column) -> Column:
    """UTF-8 if valid, else Windows-31J with U+FFFD for undecodable bytes."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")) \
        .otherwise(F.decode(content, "windows-31j"))


def read_text_auto(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per CSV file: route, decoded text, and whether characters were lost."""
    prepare(spark)
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", fs.CSV_GLOB)
        .option("recursiveFileLookup", "true").load(paths)
    )
    return decode_files(raw)


def decode_files(raw: DataFrame) -> DataFrame:
    text = decode_bytes(F.col("content").cast("binary"))
    return (
        fs.route(raw.select("path", F.col("length").alias("size"), text.alias("text")))
        .withColumn("lossy", F.col("text").contains("\ufffd"))
    )


def file_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines of routed files; line numbers start at 1.

    Only line feeds split, so the carriage return of CRLF files stays on the
    line and counts towards its length, as the layouts expect.
    """
    return (
        files.where(F.col("error").isNull())
        .select("path", "data_type", "file_date", F.posexplode(F.split("text", "\n")).alias("_n", "line"))
        .withColumn("line_no", F.col("_n") + 1).drop("_n")
        .where(fx.strip(F.col("line")) != "")
    )


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per CSV file, routed, without reading its content."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", fs.CSV_GLOB)
        .option("recursiveFileLookup", "true").load(paths)
    )
    return fs.route(listed.select(*LISTING))


def plain_path(url: Column) -> Column:
    """The path of a file as the listing spells it: escapes undone, no empty host."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):///", "$1:/")


def _blocks_of_bytes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file, the start of their block and their place in the order of the task that reads it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (
        spark.read.option("lineSep", "\n").option("pathGlobFilter", fs.CSV_GLOB).option("recursiveFileLookup", "true").text(paths)
        .select(F.col("_metadata.file_path").alias("_url"), F.col("_metadata.file_block_start").alias("_block"),
                F.col("value").cast("binary").alias("_bytes"))
        .withColumn("_place", place)
    )


def block_index(raw: DataFrame) -> DataFrame:
    """One row per block: the number its first line has in its file, less its place, and the charset of the file.

    A file is UTF-8 if all its lines are; no byte of a line feed occurs inside a
    Windows-31J character, so lines may be cut before the charset is known.
    """
    blocks = raw.groupBy("_url", "_block").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_lines"), F.bool_and(F.is_valid_utf8("_bytes")).alias("_valid"))
    file = W.partitionBy("_url")
    earlier = file.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(
        "_url", "_block", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.bool_and("_valid").over(file).alias("_utf8"))


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank numbered lines of routed files, in either charset, through the splittable text reader.

    The files are read twice: once for the block index, of one row per block,
    and once for the lines. A file of any size is dealt over its blocks.
    """
    prepare(spark)
    raw = _blocks_of_bytes(spark, paths)
    text = F.when(F.col("_utf8"), F.decode("_bytes", "UTF-8")).otherwise(F.decode("_bytes", "windows-31j"))
    path = plain_path(F.col("_url"))
    lines = (
        raw.join(block_index(raw), ["_url", "_block"])
        .select(path.alias("path"), (F.col("_shift") + F.col("_place")).cast("int").alias("line_no"), text.alias("line"))
        .where(fx.strip(F.col("line")) != "")
    )
    routed = fs.route(lines)
    return routed.where(F.col("error").isNull()).select("path", "data_type", "file_date", "line_no", "line")


def _programme() -> dict[str, Column]:
    key = F.col("race_id")
    parts = fx.race_key_parts(key)
    return {
        "venue_code": parts["venue_code"],
        "venue_name": F.coalesce(fx.lookup(parts["venue_code"], codes.VENUE), F.lit("")),
        "race_number": parts["race_number"],
        "course_type": fx.lookup(F.col("_surface"), codes.SURFACE),
        "direction": fx.direction(F.col("_direction")),
        "race_class": fx.race_class(F.col("_grade"), F.col("_condition")),
        # Runners are found near the end of the record, from character 80 on.
        "num_horses": fx.field_size(F.substring("line", 81, 1 << 30)),
    }


def _result() -> dict[str, Column]:
    return {
        "course_type": fx.lookup(F.col("_surface"), codes.SURFACE),
        "direction": fx.direction(F.col("_direction")),
        "track_condition": fx.lookup(F.col("_going"), codes.GOING),
        "grade": fx.grade(F.col("_grade")),
    }


def _meeting() -> dict[str, Column]:
    venue = F.col("venue_code")
    return {
        "venue_id": F.concat(venue, F.col("_year"), F.col("kai").cast("string"), F.col("day")),
        "year": fx.full_year(fx.to_int(F.col("_year"))),
        "venue_name": F.coalesce("_name", fx.lookup(venue, codes.VENUE), F.lit("")),
    }


DERIVED = {
    "race_info": _programme,
    "race_results": _result,
    "horse_master": lambda: {"sex": fx.lookup(F.col("_sex"), codes.SEX)},
    "venue_info": _meeting,
}


def _key_problem(table: str) -> Column:
    if table == "race_info":
        return F.when(fx.bad_race_key(F.col("race_id")), "bad race key")
    if table == "horse_extended":
        return F.when(fx.to_int(fx.chars(F.col("race_id"), 2, 4)).isNull(), "bad race key")
    return F.lit(None).cast("string")


def parse_lines(lines: DataFrame, record_type: str, ts: datetime | None = None) -> DataFrame:
    """Typed columns of the record's table plus ``reject_reason`` (NULL when the line is good).

    Input columns other than ``line`` are kept. Columns the record does not
    carry are NULL; condition records take their date from the file name.
    """
    layout = LAYOUTS[record_type]
    schema = table_schema(layout.table)
    given, names = lines.columns, set(schema.names)
    keep = [c for c in given if c not in names]
    line = F.col("line")
    parsed = read_fields(lines, layout.fields, keep)
    if layout.table in DERIVED:
        parsed = parsed.withColumns(DERIVED[layout.table]())
    if layout.table == "horse_extended" and "file_date" in given:
        parsed = parsed.withColumn("race_date", F.col("file_date"))
    if ts is not None:
        stamp = F.lit(ts).cast("timestamp")
        parsed = parsed.withColumns({"created_at": stamp, "updated_at": stamp})
    known = set(parsed.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in known}
    parsed = parsed.withColumns(missing) if missing else parsed
    reason = F.coalesce(
        F.when(F.length(line) < layout.min_length, "line too short"),
        _key_problem(layout.table),
        *[F.when(F.col(c).isNull(), f"missing {c}") for c in required_columns(schema)],
    )
    return parsed.select(*[c for c in keep if c != "line"], *schema.names, reason.alias("reject_reason"))


def refuse_files(parsed: DataFrame, file_col: str = "path") -> DataFrame:
    """Give every good line of a file with a missing required value the reason ``file refused``."""
    failing = parsed.where(F.col("reject_reason").startswith("missing ")).select(F.col(file_col).alias("_file")).distinct() \
        .withColumn("_refused", F.lit("file refused"))
    return parsed.join(failing, F.col(file_col) == F.col("_file"), "left") \
        .withColumn("reject_reason", F.coalesce("reject_reason", "_refused")).drop("_file", "_refused")


def split_required(parsed: DataFrame, strict: bool = False, file_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects; in strict mode a missing required value refuses its whole file."""
    if strict:
        parsed = refuse_files(parsed, file_col)
    bad = F.col("reject_reason").isNotNull()
    return parsed.where(~bad).drop("reject_reason"), parsed.where(bad)


def first_errors(rejects: DataFrame, n: int = 5) -> DataFrame:
    """The first few rejects in file order, for the log."""
    return rejects.orderBy("path", "line_no").limit(n)


def ingest(spark: SparkSession, paths: str | Sequence[str], record_type: str,
           ts: datetime, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """All files of one record type: (rows of its table, rejects with file, line, reason)."""
    lines = scan_lines(spark, paths).where(F.col("data_type") == record_type)
    ok, rejects = split_required(parse_lines(lines, record_type, ts), strict)
    table = table_schema(LAYOUTS[record_type].table).names
    return ok.select(*table), rejects.select("path", "line_no", "reject_reason")


def union_types(parts: Sequence[DataFrame]) -> DataFrame:
    """Several record types into one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def load_log(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One outcome row per file: status, records, table and why it failed."""
    counts = parsed.groupBy("path").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("_ok"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    records = F.coalesce(F.col("_ok"), F.lit(0).cast("bigint"))
    error = F.coalesce(F.col("error"), F.when(records == 0, "No data parsed"))
    return (
        files.select("path", "data_type", "table", "error").join(counts, "path", "left")
        .select("path", "table",
                F.when(error.isNull(), "success").otherwise("failed").alias("status"),
                F.when(error.isNull(), records).otherwise(F.lit(0).cast("bigint")).alias("records"),
                F.coalesce("rejected", F.lit(0).cast("bigint")).alias("rejected"),
                error.alias("error"))
    )
