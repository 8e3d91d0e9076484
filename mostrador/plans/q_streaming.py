"""Incremental ingestion: after all available data is processed, the result equals the batch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..operators.upsert import MergeSpec
from ..session import scratch_path
from ..sources import schemas
from ..sources.payloads import flatten_audit, parse
from ..streaming import ingest
from . import landed
from .q_joins import ATTRIBUTED
from .registry import query

MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def landed_files(t):
    """Events as landed line-delimited JSON, in several files, each line also once more in a
    later file (the overlap of two reads)."""
    path = scratch_path(t.spark, "landed")
    e = t.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    for copy in range(2):
        e.repartitionByRange("ts").write.mode("append").options(**MICROS).json(path)
    return path


@query("str_01_ingest", "SELECT event_id, ts, user_id, event_type FROM events UNION ALL SELECT event_id, ts, user_id, event_type FROM events", ["ts"])
def _(t):
    schema, out = schemas.struct(EVENT), scratch_path(t.spark, "ingested")
    stream = ingest.stream_files(t.spark, landed_files(t), schema, files_per_batch=4)
    ingest.run_available(stream, scratch_path(t.spark, "checkpoint"), ingest.append_to(out))
    return ingest.read_batches(t.spark, out, schema)


@query("str_01_audit_ingest", f"""
SELECT split_part(split_part(r.id, '?', 1), '/', 5) AS audit_id, r.action, date_trunc('second', r.created_at) AS occurred_at, x.staff_id
FROM audit_raw r JOIN ({ATTRIBUTED}) x ON x.id = r.id WHERE r.to_user""", ["occurred_at"])
def _(t):
    path, out, checkpoint = scratch_path(t.spark, "audit"), scratch_path(t.spark, "audit-out"), scratch_path(t.spark, "checkpoint")
    payloads = landed.audit(t).select(F.col("payload").alias("value"))
    schema = StructType([*flatten_audit(parse(payloads, "value", "audit")).schema.fields, StructField("day", DateType())])
    sink = ingest.audit_sink(out, "day", lambda: t.shopify_staff, schema)
    # Landed twice: the second reading overlaps with the whole first one. Compressed files cannot be split, so they are many.
    for _ in range(2):
        payloads.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)
        lines = t.spark.readStream.schema("value string").format("text").load(path)
        ingest.run_available(parse(lines, "value", "audit"), checkpoint, sink)
    return t.spark.read.schema(schema).parquet(out).select("audit_id", "action", "occurred_at", "staff_id")


def days(stream):
    return stream.withColumn("day", F.to_date("ts"))


@query("str_02_insert_only", "SELECT event_id, ts, user_id, event_type FROM events", ["ts"])
def _(t):
    schema, out = schemas.struct(EVENT + ", day date"), scratch_path(t.spark, "inserted")
    stream = days(ingest.stream_files(t.spark, landed_files(t), schemas.struct(EVENT), files_per_batch=4))
    ingest.run_available(stream, scratch_path(t.spark, "checkpoint"), ingest.insert_only(out, "day", ["event_id"], schema))
    return t.spark.read.schema(schema).parquet(out).drop("day")


@query("str_02_upsert", "SELECT event_id, ts, user_id, event_type FROM events", ["ts"])
def _(t):
    schema, out = schemas.struct(EVENT + ", day date"), scratch_path(t.spark, "merged")
    stream = days(ingest.stream_files(t.spark, landed_files(t), schemas.struct(EVENT), files_per_batch=4))
    sink = ingest.stream_upsert(out, "day", MergeSpec(("event_id",)), schema, "ts")
    ingest.run_available(stream, scratch_path(t.spark, "checkpoint"), sink)
    return t.spark.read.schema(schema).parquet(out).drop("day")


@query("str_03_dedupe", "SELECT event_id, ts, user_id, event_type FROM events", ["ts"])
def _(t):
    schema, out = schemas.struct(EVENT), scratch_path(t.spark, "deduped")
    stream = ingest.stream_files(t.spark, landed_files(t), schema)
    ingest.run_available(ingest.stream_dedupe(stream, "event_id", "ts", "40 days"), scratch_path(t.spark, "checkpoint"), ingest.append_to(out))
    return ingest.read_batches(t.spark, out, schema)


def _counts(t, width, keys):
    out = scratch_path(t.spark, "counts")
    source = t.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    path = scratch_path(t.spark, "landed")
    source.repartitionByRange("ts").write.options(**MICROS).json(path)
    counted = ingest.stream_counts(ingest.stream_files(t.spark, path, schemas.struct(EVENT), files_per_batch=2), "ts", width, keys, "40 days")
    counted = counted.withColumn("day", F.to_date("window_start"))
    sink = ingest.keyed_totals(out, "day", ["window_start", *keys], "events", counted.schema)
    ingest.run_available(counted, scratch_path(t.spark, "checkpoint"), sink, "update")
    return t.spark.read.schema(counted.schema).parquet(out).drop("day")


@query("str_04_daily_counts", "SELECT date_trunc('day', ts) AS window_start, user_id, COUNT(*) AS events FROM events GROUP BY 1, 2", ["window_start"])
def _(t):
    return _counts(t, "1 day", ["user_id"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("str_04_hourly_counts", "SELECT date_trunc('hour', ts) AS window_start, COUNT(*) AS events FROM events GROUP BY 1", ["window_start"])
def _(t):
    return _counts(t, "1 hour", []).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("str_05_late_rewrite", """
SELECT event_id, event_type, CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-28' THEN user_id + 1000 ELSE user_id END AS user_id FROM events""")
def _(t):
    schema, out, path = schemas.struct(EVENT + ", day date"), scratch_path(t.spark, "window"), scratch_path(t.spark, "landed")
    e = t.base("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    checkpoint = scratch_path(t.spark, "checkpoint")

    def land(rows):
        rows.write.mode("append").options(**MICROS).json(path)
        stream = days(ingest.stream_files(t.spark, path, schemas.struct(EVENT), files_per_batch=1))
        ingest.rewrite_window(stream, out, "day", scratch_path(t.spark, "landing"), checkpoint)

    land(e)
    land(e.where("ts >= '2024-01-28'").withColumn("user_id", F.col("user_id") + 1000))
    return t.spark.read.schema(schema).parquet(out).select("event_id", "event_type", "user_id")
