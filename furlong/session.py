"""Session settings the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC everywhere; the two legacy charset settings let decode() read Windows-31J
# and turn undecodable bytes into U+FFFD instead of failing the job.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    # Rows handed to Python at a time: documents hold some kilobytes each.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}

#: Whether the sides of a join must be dealt out by all its keys. Off, a hot key would stay in one task, so a query names it.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

# What one task reads after a shuffle of the race tables. They are narrow, so 64 MB (Spark's default) of compressed rows are two
# million entries, which several sorts and hash tables of one task hold at a time. Partitions are only ever merged up to that
# size, so there must be enough of them: with the usual 200 a task would grow with the tables.
SHUFFLE_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8388608",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    CO_PARTITION: "true",
}


def prepare(spark: SparkSession, **more: str) -> SparkSession:
    """Apply the runtime settings, and ``more`` of them, to an existing session."""
    for key, value in (RUNTIME_CONF | more).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="furlong-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")
