"""Incremental ingestion on Structured Streaming.

The checkpoint folder carries the progress, so there is no state table to maintain; sinks
are idempotent, so a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import attribute_staff
from ..operators.upsert import MergeSpec, merge_into_path, only_partitions, read_target
from ..session import held
from ..sources.payloads import flatten_audit
from ..sources.tables import by_partition


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, read with the declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def stream_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return stream_files(spark, path, schema, "json")


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(apply).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_to(path: str, part: str | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that writes each batch to its own folder, replaced if the batch repeats."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(part) if part else writer).parquet(f"{path}/batch={batch_id:012d}")

    return write


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def insert_only(path: str, part: str, keys: Sequence[str], schema: StructType) -> Callable[[DataFrame, int], None]:
    """Insert-only sink: rows of a batch whose key the table lacks. Only the partitions the
    batch names are compared and replaced.

    A row with a null in its key equals no other by it, so such rows enter each; but one that the table holds already with
    the same values stays out, so that a repeated batch changes nothing.
    """
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(path)
        keyed = batch.where(whole).groupBy(*keys).agg(F.min(F.struct(*batch.columns)).alias("r")).select("r.*")
        once = keyed.unionByName(batch.where(~whole).distinct()).select(*schema.fieldNames())
        with held(spark, once, "batch-rows") as rows:
            target = only_partitions(read_target(spark, path, part, schema), rows, part)
            same = target.where(~whole).select(*schema.fieldNames())
            new = rows.where(whole).join(target.select(*keys), list(keys), "left_anti").unionByName(rows.where(~whole).subtract(same))
            with held(spark, new, "new-rows") as fresh:
                if not fresh.isEmpty():
                    # Partitions without a new row stay as they are.
                    merged = only_partitions(target, fresh, part).unionByName(fresh, allowMissingColumns=True)
                    (by_partition(merged, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                     .partitionBy(part).parquet(path))

    return write


def audit_sink(path: str, part: str, read_staff: Callable[[], DataFrame], schema: StructType) -> Callable[[DataFrame, int], None]:
    """Audit events end to end: parsed payloads of a batch get their author from the staff list as it is then, are flattened
    and enter the table once each."""
    insert = insert_only(path, part, ["audit_id"], schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        authored = attribute_staff(batch, read_staff())
        flat = flatten_audit(authored, F.col("staff_id")).withColumn(part, F.to_date("occurred_at"))
        insert(flat.select(*schema.fieldNames()), batch_id)

    return write


def stream_upsert(path: str, part: str, spec: MergeSpec, schema: StructType, order: str) -> Callable[[DataFrame, int], None]:
    """Merge sink: the newest row per key (by ``order``) of a batch enters the table, unless
    the table's own is newer."""
    current = F.coalesce(F.col(f"s.{order}") >= F.col(f"t.{order}"), F.col(f"t.{order}").isNull())
    taken = tuple(c for c in schema.names if c not in spec.keys) if spec.update_cols is None else spec.update_cols
    clauses = spec.clauses or ((F.lit(True), taken),)
    spec = replace(spec, clauses=tuple((current & cond, cols) for cond, cols in clauses))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(path)
        first = [order, *[c for c in batch.columns if c != order]]
        newest = batch.groupBy(*spec.keys).agg(F.max(F.struct(*first)).alias("r")).select("r.*")
        rows = newest.select(*schema.fieldNames()).persist()
        merge_into_path(rows, path, part, spec)
        rows.unpersist()

    return write


def stream_dedupe(stream: DataFrame, key: str, ts: str, delay: str = "2 hours") -> DataFrame:
    """First event per key within the allowed lateness; the state forgets older keys."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_counts(stream: DataFrame, ts: str, width: str, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Tumbling counts per key, updated as events arrive."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), *keys, "events")
    )


def current_counts(batches: DataFrame, keys: Sequence[str], value: str = "events") -> DataFrame:
    """Counts only grow, so the current total of a key is its greatest one."""
    return batches.groupBy(*keys).agg(F.max(value).alias(value))


def keyed_totals(path: str, part: str, keys: Sequence[str], value: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """Sink for totals that only grow: one row a key, partitioned by ``part`` (which a key determines), however many batches
    come. Only the partitions a batch names are read and replaced; the greater total stays, so a repeated or an older batch
    changes nothing. Null keys are keys like others; a null total gives way to any other.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(path)
        rows = batch.select(*schema.fieldNames()).persist()
        target = only_partitions(spark.read.schema(schema).parquet(path), rows, part)
        merged = target.select(*rows.columns).unionByName(rows).groupBy(part, *keys).agg(F.max(value).alias(value))
        (by_partition(merged, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(part).parquet(path))
        rows.unpersist()

    return write


def rewrite_window(stream: DataFrame, path: str, part: str, landing: str, checkpoint: str) -> None:
    """Replace the date partitions that the available files name (late-window rewrite), each
    once and with everything landed for it, in however many batches it came.

    The batches are landed under ``landing``, a folder of this run; a run that failed is
    repeated with the same one.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{landing}/batch=none")
    run_available(stream, checkpoint, append_to(landing))
    rows = read_batches(spark, landing, stream.schema)
    (by_partition(rows, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))
