"""Readers, writers and table maintenance over plain Parquet, JSON and CSV folders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import schemas


def load(spark: SparkSession, folder: str, table: str, schema: StructType | None = None) -> DataFrame:
    """Typed scan of ``folder/table.parquet`` with its declared schema."""
    return spark.read.schema(schema or schemas.base(table)).parquet(f"{folder}/{table}.parquet")


def read_ndjson(spark: SparkSession, path: str, schema: StructType, corrupt: str = "_corrupt") -> DataFrame:
    """Line-delimited JSON with the target's schema; unreadable lines are kept in ``corrupt``."""
    with_corrupt = StructType([*schema.fields, StructField(corrupt, StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .json(path)
    )


def read_commented_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with '#' comment lines, blank lines, a header line and quoted commas; trimmed.

    The first line of a file that is neither a comment nor blank is its header, whatever it says; columns go by place.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("comment", "#")
        .option("quote", '"')
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_staff_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_commented_csv(spark, path, schemas.STAFF_CSV)


def read_assignments_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_commented_csv(spark, path, schemas.ASSIGNMENT_CSV)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def staff_template(staff: DataFrame, assignments: DataFrame) -> DataFrame:
    """One line per staff member with the open primary assignment and empty edit columns."""
    current = assignments.where(F.col("valid_to").isNull() & F.col("is_primary")).select(
        "employee_code", F.col("team").alias("current_team"), F.col("role").alias("current_role")
    )
    joined = staff.join(current, "employee_code", "left")
    known = [
        F.coalesce(F.col(c), F.lit("")).alias(c)
        for c in ("employee_code", "first_name", "last_name", "email", "current_team", "current_role")
    ]
    empty = [
        F.lit("").alias(c) for c in ("new_team", "new_role", "valid_from", "allocation_pct", "is_primary", "notes")
    ]
    return joined.select(*known, *empty)


def stamp_snapshot(df: DataFrame, synced_at) -> DataFrame:
    """A random id and the load time on every row of a snapshot."""
    return df.withColumn("record_id", F.uuid()).withColumn("synced_at", F.lit(synced_at).cast("timestamp_ntz"))


def append_snapshot(df: DataFrame, path: str, date_col: str, synced_at) -> None:
    """Add a snapshot; earlier ones stay. One folder per ``date_col``."""
    by_partition(stamp_snapshot(df, synced_at), date_col).write.mode("append").partitionBy(date_col).parquet(path)


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace the whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def tail_cutoff(target: DataFrame, date_col: str, days: int, fallback: str) -> DataFrame:
    """One row, ``cutoff``: the newest date minus ``days``, or ``fallback`` for an empty table."""
    newest = F.date_sub(F.max(date_col).cast("date"), days)
    return target.agg(F.coalesce(newest, F.lit(fallback).cast("date")).alias("cutoff"))


def rewrite_tail(target: DataFrame, fresh: DataFrame, date_col: str, cutoff) -> DataFrame:
    """Rows before ``cutoff`` of the target, then the fresh window."""
    limit = cutoff.scalar() if isinstance(cutoff, DataFrame) else F.lit(cutoff).cast("date")
    return target.where(F.col(date_col) < limit).unionByName(fresh.select(*target.columns))


def rewrite_tail_on_disk(fresh: DataFrame, path: str, part: str) -> None:
    """Replace only the date folders present in ``fresh``."""
    (by_partition(fresh, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))


def by_partition(df: DataFrame, part: str) -> DataFrame:
    """Rows gathered by partition value for a write: small values share a task, and a value
    that holds too much for one task is split over several."""
    return df.hint("rebalance", part)


def write_layout(df: DataFrame, path: str, part: str, cluster: Sequence[str]) -> None:
    """Date folders whose files hold ranges of the cluster columns, so that a lookup opens few of them.

    Rows are ranged by date and cluster columns: small dates share a task, a large one is split into ranges that do not
    overlap. The last range column spreads rows that agree in all cluster columns; rows equal throughout stay together.
    """
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    ranged = df.withColumn("_spread", F.xxhash64(*hashable)).repartitionByRange(part, *cluster, "_spread")
    ordered = ranged.drop("_spread").sortWithinPartitions(part, *cluster)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(part).parquet(path)


def retain(df: DataFrame, date_col: str, days: int, as_of: date) -> DataFrame:
    """Rows not older than ``days``; on a date partition column this drops whole folders."""
    first = as_of - timedelta(days=days)
    return df.where(F.col(date_col) >= F.lit(first.isoformat()).cast(df.schema[date_col].dataType))


def drop_expired(spark: SparkSession, path: str, part: str, days: int, as_of: date) -> list[str]:
    """Delete the folders of date partition ``part`` that are older than ``days``; their values, oldest first.

    Only folder names are read. The null partition, folders whose value is no date and other files stay; a second run finds
    nothing to do, so a run cut off half-way is simply repeated. A path that does not exist holds nothing to drop.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first, old = as_of - timedelta(days=days), {}
    for status in files.listStatus(root) if files.exists(root) else []:
        name, _, value = status.getPath().getName().partition("=")
        if name != part or not status.isDirectory():
            continue
        try:
            day = date.fromisoformat(value)
        except ValueError:
            continue
        if day < first:
            old[value] = status.getPath()
    for value in sorted(old):
        files.delete(old[value], True)
    return sorted(old)


def write_pages(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Store ``df`` for reading by page: rows ranged by ``order`` in folders ``rows/_range=n``, and per range its rows and the
    rows before it (``ranges``). ``order`` ends in unique columns; equal rows share a range."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_range").parquet(f"{path}/rows")
    # One row a range, as many as the write had tasks.
    stored = df.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts.withColumn("before", F.coalesce(before, F.lit(0))).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{path}/ranges")


def read_page(spark: SparkSession, path: str, schema: StructType, order: Sequence[Column], page: int, limit: int) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows of what ``write_pages`` stored in that ``order``.

    Only the ranges the page touches are read and sorted, so page 1,000,000 costs what the first one does. A page behind the
    last row is empty.
    """
    skip = (max(1, page) - 1) * limit
    ranges = spark.read.schema("_range int, n bigint, before bigint").parquet(f"{path}/ranges")
    # A range holds at least one row, so these are at most ``limit`` ranges.
    touched = ranges.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).collect()
    stored = spark.read.schema(StructType([*schema.fields, StructField("_range", IntegerType())])).parquet(f"{path}/rows")
    rows = stored.where(F.col("_range").isin([r["_range"] for r in touched])).drop("_range")
    start = min((r["before"] for r in touched), default=skip)
    return rows.orderBy(*order).offset(skip - start).limit(limit)


def evolve(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns, missing ones null; columns not declared stay at the end."""
    have = set(df.columns)
    declared = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    extra = [F.col(c) for c in df.columns if c not in set(schema.fieldNames())]
    return df.select(*declared, *extra)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate batches of several sources by column name; missing columns are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
