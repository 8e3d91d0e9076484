"""Readers, writers and table maintenance. Files go to the session's shared folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import schemas, tables
from .registry import query


@query("src_01_typed_scan", "SELECT * FROM orders", ["o_orderdate"])
def _(t):
    return t.base("orders")


AUDIT = ["audit_id", "occurred_at", "staff_id", "staff_email", "action", "subject_type", "subject_id", "raw_payload"]


@query("src_02_ndjson", f"SELECT {', '.join(AUDIT)} FROM shopify_audit_log", ["occurred_at"])
def _(t):
    path = scratch_path(t.spark, "ndjson")
    t.shopify_audit_log.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    rows = tables.read_ndjson(t.spark, path, schemas.shop("shopify_audit_log"))
    return rows.where(F.col("_corrupt").isNull()).select(*AUDIT)


@query("src_03_staff_csv", """
SELECT staff_id, email, first_name, concat(last_name, ', Jr') AS last_name, employee_code, CASE WHEN active THEN 'TRUE' ELSE 'FALSE' END AS active, CAST(NULL AS VARCHAR) AS joined_at FROM shopify_staff""")
def _(t):
    path = scratch_path(t.spark, "staff-csv")
    head = t.spark.range(1).select(F.explode(F.array(
        F.lit("# staff file"), F.lit(""), F.lit(",".join(schemas.STAFF_CSV)))).alias("value"))
    quoted = F.concat(F.lit('"'), "last_name", F.lit(', Jr"'))
    line = F.concat_ws(",", "staff_id", F.concat(F.lit(" "), "email", F.lit("  ")), F.coalesce("first_name", F.lit("")), quoted, "employee_code",
                       F.when(F.col("active"), "TRUE").otherwise("FALSE"), F.lit(""))
    # A staff list is one file; every file has a header of its own.
    head.unionAll(t.shopify_staff.select(line.alias("value"))).coalesce(1).write.text(path)
    return tables.read_staff_csv(t.spark, path)


@query("src_04_csv_export", """
SELECT CAST(id AS VARCHAR) AS id, concat(title, ' 5" ', chr(44), ' new') AS title, vendor FROM shopify_products""")
def _(t):
    path = scratch_path(t.spark, "csv-export")
    shown = t.shopify_products.select("id", F.concat("title", F.lit(' 5" , new')).alias("title"), "vendor")
    tables.write_csv(shown, path)
    return t.spark.read.schema("id string, title string, vendor string").option("header", "true").option("escape", '"').csv(path)


@query("src_05_staff_template", """
SELECT s.employee_code, COALESCE(s.first_name, '') AS first_name, COALESCE(s.last_name, '') AS last_name, COALESCE(s.email, '') AS email, COALESCE(a.team, '') AS current_team,
  COALESCE(a.role, '') AS current_role, '' AS new_team, '' AS new_role, '' AS valid_from, '' AS allocation_pct, '' AS is_primary, '' AS notes
FROM shopify_staff s LEFT JOIN staff_assignments a ON s.employee_code = a.employee_code AND a.valid_to IS NULL AND a.is_primary""")
def _(t):
    return tables.staff_template(t.shopify_staff, t.staff_assignments)


@query("src_06_append_snapshot", """
SELECT snapshot, COUNT(*) AS rows, COUNT(*) AS ids FROM (SELECT '2024-01-01' AS snapshot FROM competitor_prices UNION ALL SELECT '2024-01-02' FROM competitor_prices) s GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "snapshots")
    for day in ("2024-01-01", "2024-01-02"):
        rows = t.competitor_prices.drop("synced_at").withColumn("snapshot_date", F.lit(day).cast("date"))
        tables.append_snapshot(rows, path, "snapshot_date", f"{day} 06:00:00")
    kept = t.spark.read.schema("record_id string, synced_at timestamp_ntz, snapshot_date date").parquet(path)
    return kept.groupBy(F.col("snapshot_date").cast("string").alias("snapshot")).agg(
        F.count("*").alias("rows"), F.count_distinct("record_id").alias("ids"))


@query("src_07_full_refresh", "SELECT review_id, product_id, score FROM raw_yotpo_reviews WHERE status = 'published'")
def _(t):
    path = scratch_path(t.spark, "refresh")
    rows = t.raw_yotpo_reviews.select("review_id", "product_id", "score", "status")
    tables.full_refresh(rows, path)
    tables.full_refresh(rows.where("status = 'published'"), path)
    return t.spark.read.schema("review_id bigint, product_id string, score bigint").parquet(path)


GA_KEYS = "date, session_default_channel_group, session_source_medium, campaign_name"


@query("src_08_rewrite_tail", f"""
SELECT {GA_KEYS}, CASE WHEN date >= (SELECT MAX(date) - 3 FROM raw_traffic_ga4) THEN sessions * 2 ELSE sessions END AS sessions FROM raw_traffic_ga4""", ["date"])
def _(t):
    cols = [c.strip() for c in GA_KEYS.split(",")] + ["sessions"]
    target = t.raw_traffic_ga4.select(*cols)
    cutoff = tables.tail_cutoff(target, "date", 3, "2023-01-01")
    fresh = target.where(F.col("date") >= cutoff.scalar()).withColumn("sessions", F.col("sessions") * 2)
    return tables.rewrite_tail(target, fresh, "date", cutoff)


@query("src_08_tail_cutoff", "SELECT MAX(date) - 3 AS cutoff FROM raw_traffic_ga4", ["cutoff"])
def _(t):
    return tables.tail_cutoff(t.raw_traffic_ga4, "date", 3, "2023-01-01")


@query("src_08_tail_on_disk", f"""
SELECT {GA_KEYS}, CASE WHEN date >= DATE '2024-01-25' THEN sessions * 2 ELSE sessions END AS sessions FROM raw_traffic_ga4""", ["date"])
def _(t):
    path = scratch_path(t.spark, "tail")
    cols = [c.strip() for c in GA_KEYS.split(",")] + ["sessions"]
    target = t.raw_traffic_ga4.select(*cols)
    tables.rewrite_tail_on_disk(target, path, "date")
    fresh = target.where("date >= date'2024-01-25'").withColumn("sessions", F.col("sessions") * 2)
    tables.rewrite_tail_on_disk(fresh, path, "date")
    return t.spark.read.schema(target.schema).parquet(path)


@query("src_09_layout", "SELECT date, session_source_medium, sessions FROM raw_traffic_ga4 WHERE date = DATE '2024-01-17'", ["date"])
def _(t):
    path = scratch_path(t.spark, "layout")
    part, cluster = schemas.LAYOUT["raw_traffic_ga4"]
    rows = t.raw_traffic_ga4.select("date", "session_default_channel_group", "session_source_medium", "sessions")
    tables.write_layout(rows, path, part, cluster)
    return t.spark.read.schema(rows.schema).parquet(path).where("date = date'2024-01-17'").select("date", "session_source_medium", "sessions")


@query("src_10_retain", "SELECT COUNT(*) AS rows, MIN(synced_at) AS first FROM competitor_prices WHERE synced_at >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY", ["first"])
def _(t):
    kept = tables.retain(t.competitor_prices, "synced_at", schemas.RETENTION_DAYS["competitor_prices"], date(2000, 6, 1))
    return kept.agg(F.count("*").alias("rows"), F.min("synced_at").alias("first"))


@query("src_10_retain_on_disk", "SELECT CAST(date_trunc('month', synced_at) AS DATE) AS month, COUNT(*) AS rows FROM competitor_prices WHERE date_trunc('month', synced_at) >= DATE '1997-06-01' - INTERVAL 90 DAY GROUP BY 1", ["month"])
def _(t):
    path = scratch_path(t.spark, "retained")
    rows = t.competitor_prices.withColumn("month", F.trunc("synced_at", "month"))
    tables.rewrite_tail_on_disk(rows, path, "month")
    tables.drop_expired(t.spark, path, "month", schemas.RETENTION_DAYS["competitor_prices"], date(1997, 6, 1))
    return t.spark.read.schema(rows.schema).parquet(path).groupBy("month").agg(F.count("*").alias("rows"))


@query("src_11_evolve", """
SELECT session_id, status, CAST(NULL AS VARCHAR) AS segments, CAST(NULL AS VARCHAR) AS rating_comment, rating_value FROM crisp_conversations""")
def _(t):
    grown = tables.evolve(t.crisp_conversations, schemas.shop("crisp_conversations"))
    return grown.select("session_id", "status", "segments", "rating_comment", "rating_value")
