"""Files arriving in a folder, parsed and upserted by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from furlong.session import prepare
from furlong.sources import files as fs
from furlong.sources.fixed_width import (BINARY_FILE, LISTING, list_files, load_log, parse_lines, refuse_files, scan_lines,
                                         split_required)
from furlong.sources.layouts import LAYOUTS
from furlong.sources.tables import upsert_table


def _now() -> datetime:
    return datetime.now(timezone.utc)


def load_lines(lines: DataFrame, root: str, batch: str, ts: datetime, strict: bool = False) -> DataFrame:
    """Parse and upsert one batch of record lines (path, file_date, line_no, data_type, line).

    The lines are staged by target table, so each table reads only its own;
    they are parsed once, into a staged table that rows, rejects and the
    returned outcome (path, reject_reason) are read from. Within a batch the
    latest file wins. ``strict`` refuses a file with a missing required value.
    """
    spark = lines.sparkSession
    stage = f"{root}/_staging/lines/{batch}"
    lines.withColumn("table", F.coalesce(*[
        F.when(F.col("data_type") == t, layout.table) for t, layout in LAYOUTS.items()])) \
        .write.mode("overwrite").partitionBy("table").parquet(stage)
    staged = spark.read.parquet(stage)
    present = {row[0] for row in staged.select("table").distinct().collect()}
    outcome = spark.createDataFrame([], "path string, reject_reason string")
    for record_type, layout in {lay.table: (t, lay) for t, lay in LAYOUTS.items()}.values():
        if layout.table in present:
            mine = parse_lines(staged.where(F.col("table") == layout.table).drop("table"), record_type, ts)
            held = f"{root}/_staging/parsed/{batch}/{layout.table}"
            (refuse_files(mine) if strict else mine).write.mode("overwrite").parquet(held)
            parsed = spark.read.parquet(held)
            ok, rejects = split_required(parsed)
            upsert_table(spark, root, layout.table, ok, batch)
            rejects.select("path", "line_no", "reject_reason") \
                .write.mode("overwrite").parquet(f"{root}/_rejects/table={layout.table}/batch={batch}")
            outcome = outcome.unionByName(parsed.select("path", "reject_reason"))
    return outcome


def free_staging(spark: SparkSession, root: str, batch: str) -> None:
    """Empty the staged lines of a batch whose outcome has been recorded."""
    spark.createDataFrame([], "line string").write.mode("overwrite").parquet(f"{root}/_staging/lines/{batch}")
    spark.createDataFrame([], "line string").write.mode("overwrite").parquet(f"{root}/_staging/parsed/{batch}")


def load_files(spark: SparkSession, files: DataFrame, root: str, batch: str, ts: datetime, strict: bool = False) -> None:
    """Load the listed, routed files block by block and record the outcome of each one.

    ``files`` has one row per file; only their names pass through the driver.
    """
    files = files.select("path", "data_type", "table", "error")
    paths = [row[0] for row in files.where(F.col("error").isNull()).select("path").collect()]
    if paths:
        outcome = load_lines(scan_lines(spark, paths), root, batch, ts, strict)
    else:
        outcome = spark.createDataFrame([], "path string, reject_reason string")
    load_log(files, outcome).write.mode("overwrite").parquet(f"{root}/_log/batch={batch}")
    free_staging(spark, root, batch)


def batch_name(files: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch: its number and a digest of what it holds.

    A replay of the same files gets the same name and is recognised; a stream
    restarted from an empty checkpoint is not mistaken for an old one.
    """
    columns = [c for c in ("path", "modificationTime", "length", "line_no", "line") if c in files.columns]
    digest = files.agg(F.bit_xor(F.xxhash64(*columns)), F.count("*")).first()
    return f"{batch_id}-{(digest[0] or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{digest[1]}"


def ingest_stream(spark: SparkSession, in_dir: str, root: str, checkpoint: str,
                  clock: Callable[[], datetime] = _now, files_per_batch: int = 1000,
                  strict: bool = False) -> StreamingQuery:
    """Load every new CSV file below ``in_dir`` once, then stop (``availableNow``)."""
    prepare(spark)
    arrivals = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", fs.CSV_GLOB)
        .option("maxFilesPerTrigger", files_per_batch).load(in_dir).select(*LISTING)  # contents are read block by block
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        load_files(batch.sparkSession, fs.route(batch), root, batch_name(batch, batch_id), clock(), strict)

    return (arrivals.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def lines_stream(lines: DataFrame, root: str, checkpoint: str,
                 clock: Callable[[], datetime] = _now) -> StreamingQuery:
    """The same load for a stream that already delivers record lines."""

    def load(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch, batch_id)
        load_lines(batch, root, name, clock())
        free_staging(batch.sparkSession, root, name)

    return (lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_files(spark: SparkSession, paths: str | Sequence[str], root: str, ts: datetime | None = None,
                 strict: bool = False) -> None:
    """Load (or load again) the named files in one batch run."""
    prepare(spark)
    load_files(spark, list_files(spark, paths), root, f"manual-{uuid4().hex}", ts or _now(), strict)
