"""File names, routing, incremental manifests and load summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fields as fx
from furlong.sources.layouts import LAYOUTS

# Accepted file names and extensions.
FILE_NAME = r"(?i)^([A-Z]{2,3})([0-9]{6})\.csv$"
CSV_GLOB = "*.[cC][sS][vV]"
SOURCE_SUFFIXES = ("csv", "txt", "lzh")

ROUTES = {record_type: layout.table for record_type, layout in LAYOUTS.items()}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def data_type(path: Column) -> Column:
    """Record type from a path such as ``Baa/BAA260104.csv``, else NULL."""
    return F.upper(fx.blank_to_null(F.regexp_extract(base_name(path), FILE_NAME, 1)))


def file_date(path: Column) -> Column:
    """Date from the six digits of the name: 00-50 are 20yy, 51-99 are 19yy."""
    digits = fx.blank_to_null(F.regexp_extract(base_name(path), r"([0-9]{6})\.[A-Za-z]+$", 1))
    year = fx.full_year(fx.to_int(F.substring(digits, 1, 2)))
    return fx.to_ymd(F.concat(year.cast("string"), F.substring(digits, 3, 4)))


def is_csv(path: Column) -> Column:
    return F.lower(path).endswith(".csv")


def route(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add data type, file date, target table and the reason for a refusal."""
    kind = F.col("data_type")
    return (
        files.withColumn("data_type", data_type(F.col(path_col)))
        .withColumn("file_date", file_date(F.col(path_col)))
        .withColumn("table", fx.lookup(F.coalesce(kind, F.lit("")), ROUTES))
        .withColumn(
            "error",
            F.when(kind.isNull(), "Invalid filename format")
            .when(F.col("table").isNull(), F.concat(F.lit("Unsupported data type: "), kind)))
    )


def file_dates_since(files: DataFrame, start: str, path_col: str = "path") -> DataFrame:
    """Distinct yymmdd stamps of files from ``start`` on, oldest first; years 90-99 are left out."""
    stamp = F.regexp_extract(base_name(F.col(path_col)), r"([0-9]{6})\.[A-Za-z]+$", 1)
    return (
        files.select(stamp.alias("stamp"))
        .where((F.col("stamp") >= start) & (F.col("stamp") < "90"))
        .distinct()
        .orderBy("stamp")
    )


def file_digests(spark, folder: str) -> DataFrame:
    """Path, type folder, size and MD5 of every loadable file; hidden folders are skipped."""
    path = F.regexp_extract(F.col("path"), r"([^/]+/[^/]+)$", 1)
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SOURCE_SUFFIXES))
        .where(~F.col("path").rlike(r"/\."))
        .select(path.alias("path"), F.split(path, "/")[0].alias("data_type"),
                F.col("length").alias("size"), F.md5("content").alias("md5"))
    )


def manifest_diff(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Tag each current file new, changed or same, and whether to load it."""
    known = previous.select(F.col("path"), F.col("md5").alias("_old"))
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_old") != F.col("md5"), "changed").otherwise("same")
    )
    return (
        current.join(known, "path", "left")
        .withColumn("status", status)
        .withColumn("to_load", F.lit(force) | (F.col("status") != "same"))
        .drop("_old")
    )


def vanished(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of the previous manifest that are gone now."""
    return previous.join(current.select("path"), "path", "left_anti")


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.select("path", "md5").intersect(previous.select("path", "md5"))


def manifest_summary(diff: DataFrame) -> DataFrame:
    """Files, loaded, skipped, failed and loaded bytes per type and in total.

    A ``failed`` column marks files whose load went wrong; a dry run has none.
    """
    if "failed" not in diff.columns:
        diff = diff.withColumn("failed", F.lit(False))
    loaded = F.col("to_load") & ~F.col("failed")
    return (
        diff.rollup("data_type")
        .agg(F.count("*").alias("total_files"), F.count_if(loaded).alias("loaded_files"),
             F.count_if(~F.col("to_load")).alias("skipped_files"),
             F.count_if(F.col("to_load") & F.col("failed")).alias("failed_files"),
             F.coalesce(F.sum(F.when(loaded, F.col("size"))), F.lit(0)).alias("loaded_bytes"),
             F.grouping("data_type").alias("_total"))
        .withColumn("data_type", F.when(F.col("_total") == 1, "total").otherwise(F.col("data_type")))
        .drop("_total")
    )
