"""Parquet tables: creation, layout on write, and the keyed upsert."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.constants import constant_rows
from furlong.sources.schemas import DATASETS, TABLES, Table, table_schema


def with_audit(df: DataFrame, ts: datetime, preserve: Sequence[str] = ()) -> DataFrame:
    """Load time in both audit columns; ``preserve`` keeps an existing value where there is one."""
    stamp = F.lit(ts).cast("timestamp")
    return df.withColumns({
        c: F.coalesce(F.col(c), stamp) if c in preserve and c in df.columns else stamp
        for c in ("created_at", "updated_at")})


# -- catalog ---------------------------------------------------------------

def ensure_databases(spark: SparkSession, names: Sequence[str] = DATASETS) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def stored_schema(schema: T.StructType, layout: Table) -> T.StructType:
    """Schema on disk: a derived partition column is added at the end."""
    if layout.partition and layout.partition not in schema.names:
        return T.StructType([*schema.fields, T.StructField(layout.partition, T.DateType())])
    return schema


def ensure_table(spark: SparkSession, name: str, schema: T.StructType | None = None,
                 layout: Table | None = None, location: str | None = None) -> str:
    """Create the table if it is missing; an existing one is left alone."""
    layout = layout or TABLES[name]
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
        for f in stored_schema(schema or table_schema(name), layout))
    full = f"{layout.dataset}.{name}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet"
        + (f" PARTITIONED BY ({layout.partition})" if layout.partition else "")
        + (f" LOCATION '{location}'" if location else ""))
    return full


def ensure_all(spark: SparkSession) -> None:
    ensure_databases(spark)
    for name in TABLES:
        ensure_table(spark, name)


def inventory(spark: SparkSession, datasets: Sequence[str] = DATASETS) -> DataFrame:
    """Number of tables per namespace, empty ones included."""
    found = [(d, t.name) for d in datasets for t in spark.catalog.listTables(d) if not t.isTemporary]
    listed = constant_rows(spark, [(d,) for d in datasets], "dataset string")
    return listed.join(constant_rows(spark, found, "dataset string, table_name string"), "dataset", "left") \
        .groupBy("dataset").agg(F.count("table_name").alias("tables"))


# -- files -----------------------------------------------------------------

def table_path(root: str, name: str) -> str:
    return f"{root}/{TABLES[name].dataset}/{name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table's stored columns in schema order; empty when nothing is loaded yet."""
    schema = stored_schema(table_schema(name), TABLES[name])
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    try:
        return spark.read.schema(nullable).parquet(table_path(root, name)).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], nullable)


def laid_out(df: DataFrame, layout: Table) -> DataFrame:
    """Group rows by partition and sort them inside each file.

    The rebalance hint lets the adaptive planner split an oversized day over
    several files and merge tiny ones, which a plain repartition would not.
    """
    if layout.partition and layout.partition not in df.columns:
        df = df.withColumn(layout.partition, F.expr(layout.partition_expr))
    df = df.hint("rebalance", layout.partition) if layout.partition else df.hint("rebalance")
    order = ([layout.partition] if layout.partition else []) + list(layout.sort)
    return df.sortWithinPartitions(*order) if order else df


def write_table(df: DataFrame, path: str, layout: Table) -> None:
    """Replace the partitions present in ``df`` (or the whole unpartitioned table)."""
    writer = laid_out(df, layout).write.mode("overwrite")
    if layout.partition:
        writer = writer.partitionBy(layout.partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


# -- upsert ----------------------------------------------------------------

def latest_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; rows with a NULL in the key never match and all stay.

    ``row_number = 1`` is pruned on the map side (window group limit), so a key
    with very many copies does not travel whole.
    """
    ranked = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    keyed = source.dropna(subset=list(keys)).withColumn("_rn", F.row_number().over(ranked)) \
        .where(F.col("_rn") == 1).drop("_rn")
    unkeyed = F.lit(False)
    for key in keys:
        unkeyed = unkeyed | F.col(key).isNull()
    return keyed.unionByName(source.where(unkeyed))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           preserve: Sequence[str] = ()) -> DataFrame:
    """Matched keys take every non-key column of the source, new keys are added.

    ``source`` has one row per key. ``preserve`` lists columns (such as
    ``created_at``) that keep the target's value on a match.
    """
    keys = list(keys)
    kept = target.join(source.select(*keys), keys, "left_anti")
    if preserve:
        old = target.select(*keys, *[F.col(c).alias(f"_{c}") for c in preserve])
        source = source.join(old, keys, "left").withColumns(
            {c: F.coalesce(f"_{c}", c) for c in preserve}).drop(*[f"_{c}" for c in preserve])
    return kept.unionByName(source.select(*target.columns))


#: Slots of a key index: a batch of a few keys reads as many slots of it at most.
SLOTS = 64


def _slotted(rows: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """The keys of rows as a hash and its slot."""
    hashed = F.xxhash64(*keys)
    return rows.select(F.pmod(hashed, F.lit(SLOTS)).cast("int").alias("_slot"), hashed.alias("_hash"), *others)


def index_path(root: str, name: str) -> str:
    return f"{root}/_index/{name}"


def add_to_index(rows: DataFrame, root: str, name: str) -> None:
    """Note the days under which the keys of ``rows`` are stored.

    Entries are only added: that of a row that moved on costs a needless look at its former day and nothing else, so an
    entry may be noted before its row is written, and twice.
    """
    layout = TABLES[name]
    entries = _slotted(rows.dropna(subset=list(layout.key)), layout.key, layout.partition).distinct()
    entries.repartition("_slot").sortWithinPartitions("_slot", "_hash").write.mode("append").partitionBy("_slot").parquet(index_path(root, name))


def indexed_days(spark: SparkSession, root: str, name: str, incoming: DataFrame) -> DataFrame:
    """Days that may hold a key of ``incoming``: the slots of its keys are all that is read of the index."""
    layout = TABLES[name]
    if not _is_written(spark, f"{index_path(root, name)}-built"):  # the table is older than its index, or empty
        add_to_index(read_table(spark, root, name), root, name)
        spark.range(1).write.mode("overwrite").parquet(f"{index_path(root, name)}-built")
    wanted = _slotted(incoming.dropna(subset=list(layout.key)), layout.key).distinct()
    slots = [row[0] for row in wanted.select("_slot").distinct().collect()]  # at most SLOTS numbers
    kind = stored_schema(table_schema(name), layout)[layout.partition].dataType
    schema = T.StructType().add("_hash", T.LongType()).add(layout.partition, kind).add("_slot", T.IntegerType())
    index = spark.read.schema(schema).parquet(index_path(root, name)).where(F.col("_slot").isin(slots))
    return index.join(wanted, ["_slot", "_hash"], "left_semi").select(layout.partition).distinct()


def drop_days(spark: SparkSession, path: str, part: str, days: Sequence) -> None:
    """Remove the folders of days that have no row any more; no job is run for them."""
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days:
        value = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={value}"), True)


def _is_written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def upsert_table(spark: SparkSession, root: str, name: str, source: DataFrame, batch: str,
                 order: Sequence[str] = ("file_date", "line_no"), preserve: Sequence[str] = ()) -> None:
    """Upsert ``source`` into a stored table, rewriting only the partitions it touches.

    The merged partitions are first written to a staging table and only then
    moved over the target. A batch that died half-way is repeated from its
    finished staging data, so no state of the target can lose rows; a batch
    that completed is skipped when it is replayed.
    """
    layout, path = TABLES[name], table_path(root, name)
    stage = f"{root}/_staging/{name}/{batch}"
    if _is_written(spark, f"{stage}/done"):
        return
    columns = stored_schema(table_schema(name), layout).names
    part = layout.partition
    if not _is_written(spark, f"{stage}/ready"):
        rows = latest_per_key(source, layout.key, order)
        if part and part not in rows.columns:
            rows = rows.withColumn(part, F.expr(layout.partition_expr))
        rows.select(*columns).write.mode("overwrite").parquet(f"{stage}/source")
        incoming = spark.read.parquet(f"{stage}/source")
        target = read_table(spark, root, name)
        touched = None
        if part:
            # Days that hold a matched key or receive a row: bounded by the calendar.
            touched = indexed_days(spark, root, name, incoming).union(incoming.select(part)).distinct()
            touched.write.mode("overwrite").parquet(f"{stage}/touched")
            touched = spark.read.parquet(f"{stage}/touched")
            days = [row[0] for row in touched.collect()]
            on_day = F.col(part).isin([d for d in days if d is not None])
            target = target.where(on_day | F.col(part).isNull() if None in days else on_day)
        merged = upsert(target, incoming, layout.key, preserve)
        merged.write.mode("overwrite").parquet(f"{stage}/merged")
        spark.range(1).write.mode("overwrite").parquet(f"{stage}/ready")
    merged = spark.read.parquet(f"{stage}/merged")
    if part:
        filled = merged.select(F.col(part).alias("_day")).distinct()
        emptied = spark.read.parquet(f"{stage}/touched").join(filled, F.col(part).eqNullSafe(F.col("_day")), "left_anti").collect()
        add_to_index(merged, root, name)
        write_table(merged, path, layout)
        drop_days(spark, path, part, [row[0] for row in emptied])  # all of their rows moved to another day
    else:
        write_table(merged, path, layout)
    spark.range(1).write.mode("overwrite").parquet(f"{stage}/done")
    for part_of_stage in ("source", "merged"):  # free the staged copies
        schema = spark.read.parquet(f"{stage}/{part_of_stage}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{stage}/{part_of_stage}")


def save_report(report: DataFrame, path: str) -> None:
    """One JSON document per report row."""
    report.coalesce(1).write.mode("overwrite").json(path)
