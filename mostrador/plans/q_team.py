"""Team activity, set operations, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skew
from ..operators import joins, team
from ..session import scratch_path
from ..sources.tables import read_page, union_sources, write_pages
from .registry import E0, E1, query, total

IN = f"occurred_at >= TIMESTAMP '{E0}' AND occurred_at <= TIMESTAMP '{E1}' AND staff_id IS NOT NULL"
ENRICHED = """(SELECT a.*, concat(COALESCE(s.first_name, ''), ' ', COALESCE(s.last_name, '')) AS full_name
  FROM shopify_audit_log a LEFT JOIN shopify_staff s ON a.staff_id = s.staff_id)"""
DAILY = f"SELECT CAST(occurred_at AS DATE) AS date, staff_id, full_name, COUNT(*) AS events FROM {ENRICHED} a WHERE {IN} GROUP BY 1, 2, 3"


def daily(t):
    return team.activity_daily(t.shopify_audit_log, t.shopify_staff, E0, E1)


@query("tea_01_activity_summary", f"""
SELECT staff_id, full_name, action, COUNT(*) AS event_count, MAX(occurred_at) AS last_activity FROM {ENRICHED} a WHERE {IN} GROUP BY 1, 2, 3""", ["last_activity"])
def _(t):
    return team.activity_summary(t.shopify_audit_log, t.shopify_staff, E0, E1)


@query("tea_02_activity_daily", DAILY, ["date"])
def _(t):
    return daily(t)


SPINE = f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{E0}', TIMESTAMP '{E1}', INTERVAL 1 DAY)) AS DATE) AS date)"


@query("tea_03_spine_total", f"""
SELECT d.date, COALESCE(CAST(SUM(a.events) AS BIGINT), 0) AS total FROM {SPINE} d LEFT JOIN ({DAILY}) a ON d.date = a.date GROUP BY d.date""", ["date"])
def _(t):
    return team.activity_spine(daily(t), E0, E1)


@query("tea_03_spine_by_staff", f"""
WITH a AS ({DAILY}), n AS (SELECT DISTINCT full_name FROM a)
SELECT n.full_name, d.date, COALESCE(CAST(SUM(a.events) AS BIGINT), 0) AS events FROM n CROSS JOIN {SPINE} d
LEFT JOIN a ON a.full_name = n.full_name AND a.date = d.date GROUP BY n.full_name, d.date""", ["date"])
def _(t):
    return team.activity_spine_by_staff(daily(t), E0, E1)


def wide(name):
    return f"COALESCE(CAST(SUM(CASE WHEN a.full_name = '{name}' THEN a.events END) AS BIGINT), 0) AS \"{name}\""


@query("tea_03_spine_wide", f"""
SELECT d.date, {wide('HOUSEHOLD N42')}, {wide(' N17')} FROM {SPINE} d LEFT JOIN ({DAILY}) a ON d.date = a.date GROUP BY d.date""", ["date"])
def _(t):
    return team.activity_spine_wide(daily(t), E0, E1, ["HOUSEHOLD N42", " N17"])


PAGE = f"SELECT audit_id, occurred_at, staff_id, full_name, action, subject_type, subject_id FROM {ENRICHED} a WHERE {IN} ORDER BY occurred_at DESC, audit_id"


@query("tea_04_activity_page", f"{PAGE} LIMIT 50 OFFSET 100", ["occurred_at"])
def _(t):
    return team.activity_page(t.shopify_audit_log, t.shopify_staff, E0, E1, page=3)


@query("tea_04_activity_page_indexed", f"{PAGE} LIMIT 50 OFFSET 450", ["occurred_at"])
def _(t):
    path = scratch_path(t.spark, "activity")
    team.index_activity(t.shopify_audit_log, path, E0, E1)
    return team.indexed_page(t.shopify_audit_log, t.shopify_staff, path, page=10)


@query("tea_04_activity_page_after", f"""SELECT * FROM ({PAGE}) p WHERE occurred_at < TIMESTAMP '2024-01-20 10:00:00' ORDER BY occurred_at DESC, audit_id LIMIT 50""", ["occurred_at"])
def _(t):
    return team.activity_page(t.shopify_audit_log, t.shopify_staff, E0, E1, after=("2024-01-20 10:00:00", "zzz"))


@query("tea_04_activity_meta", f"SELECT COUNT(*) AS total_events, CAST(ceil(COUNT(*) / 50e0) AS BIGINT) AS total_pages FROM shopify_audit_log WHERE {IN}")
def _(t):
    return team.activity_meta(t.shopify_audit_log, E0, E1)


@query("tea_05_staff_totals", f"SELECT full_name AS name, {total('events')} AS total FROM ({DAILY}) d GROUP BY 1")
def _(t):
    return team.staff_totals(daily(t))


@query("tea_05_top_staff", f"SELECT full_name AS name, {total('events')} AS total FROM ({DAILY}) d GROUP BY 1 ORDER BY total DESC, name LIMIT 5")
def _(t):
    return team.staff_totals(daily(t), 5)


@query("tea_06_staff_list", "SELECT staff_id, concat(COALESCE(first_name, ''), ' ', COALESCE(last_name, '')) AS full_name FROM shopify_staff")
def _(t):
    return team.staff_list(t.shopify_staff)


@query("tea_06_action_list", "SELECT DISTINCT action FROM shopify_audit_log WHERE action IS NOT NULL")
def _(t):
    return team.action_list(t.shopify_audit_log)


WHO = "COALESCE(s.first_name, a.staff_id) AS employee"
FROM_WHO = "FROM shopify_audit_log a LEFT JOIN shopify_staff s ON CAST(a.staff_id AS VARCHAR) = CAST(s.staff_id AS VARCHAR)"


@query("tea_07_report_actions", "SELECT action, COUNT(*) AS count FROM shopify_audit_log GROUP BY 1")
def _(t):
    return team.activity_report(t.shopify_audit_log, t.shopify_staff, "actions")


@query("tea_07_report_staff_actions", f"SELECT {WHO}, a.action, COUNT(*) AS events {FROM_WHO} GROUP BY 1, 2")
def _(t):
    return team.activity_report(t.shopify_audit_log, t.shopify_staff, "staff_actions")


@query("tea_07_report_comments", f"SELECT {WHO}, COUNT(*) AS events {FROM_WHO} WHERE a.action = 'click' GROUP BY 1")
def _(t):
    return team.activity_report(t.shopify_audit_log, t.shopify_staff, "comments", "click")


@query("tea_08_attribution_coverage", """
SELECT a.staff_id, COUNT(a.audit_id) AS event_count, MAX(s.first_name) AS first_name, MAX(s.last_name) AS last_name, MAX(s.first_name) IS NOT NULL AS matched
FROM shopify_audit_log a LEFT JOIN shopify_staff s ON a.staff_id = s.staff_id WHERE a.staff_id IS NOT NULL GROUP BY 1""")
def _(t):
    return team.attribution_coverage(t.shopify_audit_log, t.shopify_staff)


@query("tea_08_unknown_staff", """
SELECT DISTINCT staff_id FROM shopify_audit_log WHERE staff_id IS NOT NULL AND staff_id NOT IN (SELECT staff_id FROM shopify_staff WHERE first_name IS NOT NULL)""")
def _(t):
    return team.unknown_staff(t.shopify_audit_log, t.shopify_staff)


def raw_events(t):
    return t.audit_raw.select(
        "id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), "action", "message",
        F.col("app_title").alias("appTitle"), F.col("to_app").alias("attributeToApp"), F.col("to_user").alias("attributeToUser"),
        F.col("subject_type").alias("subjectType"))


@query("tea_09_event_profile", """
WITH r AS (SELECT * FROM audit_raw), d AS (
 SELECT 'subject_type' AS dimension, COALESCE(subject_type, 'UNKNOWN') AS value FROM r UNION ALL SELECT 'action', COALESCE(action, 'UNKNOWN') FROM r
 UNION ALL SELECT 'attribution', CASE WHEN to_user THEN 'human' WHEN to_app THEN 'app' ELSE 'none' END FROM r
 UNION ALL SELECT 'app', COALESCE(NULLIF(app_title, ''), 'Unknown App') FROM r WHERE NOT to_user AND to_app
 UNION ALL SELECT 'human_day', CAST(CAST(created_at AS DATE) AS VARCHAR) FROM r WHERE to_user
 UNION ALL SELECT 'id_suffix', concat('?', split_part(id, '?', 2)) FROM r WHERE contains(id, '?'))
SELECT dimension, value, COUNT(*) AS events FROM d GROUP BY 1, 2""")
def _(t):
    return team.event_profile(raw_events(t))


@query("tea_09_event_sample", """
SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS "createdAt", action, message FROM audit_raw WHERE to_user ORDER BY md5(concat(id, '7')), id LIMIT 20""")
def _(t):
    return team.event_sample(raw_events(t))


LISTED = "SELECT employee_code, team, role, valid_from, valid_to, is_primary, allocation_pct FROM staff_assignments"


@query("tea_10_assignments", f"{LISTED} WHERE valid_to IS NULL", ["valid_from", "valid_to"])
def _(t):
    return team.assignments(t.staff_assignments)


@query("tea_10_assignments_all", f"{LISTED} WHERE employee_code = 'emp.25'", ["valid_from", "valid_to"])
def _(t):
    return team.assignments(t.staff_assignments, "emp.25", include_expired=True)


# --- sorts, limits, set operations ----------------------------------------------------

@query("srt_01_top_k", """
SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM gsc_metrics GROUP BY query
ORDER BY clicks DESC, impressions DESC, query LIMIT 20""")
def _(t):
    return (t.gsc_metrics.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
            .orderBy(F.desc("clicks"), F.desc("impressions"), "query").limit(20))


@query("srt_02_case_rank", """
SELECT financial_status, id, row_number() OVER (ORDER BY CASE financial_status WHEN 'paid' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END, total_price DESC, id) AS place
FROM shopify_orders ORDER BY place LIMIT 25""")
def _(t):
    rank = F.when(F.col("financial_status") == "paid", 1).when(F.col("financial_status") == "pending", 2).otherwise(3)
    top = t.shopify_orders.orderBy(rank, F.desc("total_price"), "id").limit(25)
    w = F.row_number().over(skew.Window.orderBy(rank, F.desc("total_price"), "id"))
    return top.select("financial_status", "id", w.alias("place"))


@query("srt_03_nulls_last", "SELECT id, fecha_lanzamiento FROM launches ORDER BY fecha_lanzamiento ASC NULLS LAST, scan_day DESC, id LIMIT 200", ["fecha_lanzamiento"])
def _(t):
    from ..operators.market import launches

    return launches(t.launches).select("id", "fecha_lanzamiento")


@query("srt_04_page", "SELECT id, total_price FROM shopify_orders ORDER BY total_price DESC, id LIMIT 30 OFFSET 60")
def _(t):
    return t.shopify_orders.select("id", "total_price").orderBy(F.desc("total_price"), "id").offset(60).limit(30)


@query("srt_04_page_indexed", "SELECT id, total_price FROM shopify_orders ORDER BY total_price DESC, id LIMIT 30 OFFSET 960")
def _(t):
    path, order = scratch_path(t.spark, "pages"), [F.desc("total_price"), F.asc("id")]
    rows = t.shopify_orders.select("id", "total_price")
    write_pages(rows, path, order)
    return read_page(t.spark, path, rows.schema, order, page=33, limit=30)


@query("set_01_both_sides", """
SELECT CAST(o_orderkey AS VARCHAR) AS k, 'created' AS side, o_orderdate AS at_time FROM orders UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 'paid', o_orderdate + INTERVAL 1 DAY FROM orders""", ["at_time"])
def _(t):
    both = F.explode(F.array(
        F.struct(F.lit("created").alias("side"), F.col("created_at").alias("at_time")),
        F.struct(F.lit("paid").alias("side"), (F.col("created_at") + F.expr("interval 1 day")).alias("at_time"))))
    return t.shopify_orders.select(F.col("id").cast("string").alias("k"), both.alias("s")).select("k", "s.*")


@query("set_02_distinct", "SELECT DISTINCT producto FROM launches")
def _(t):
    return joins.known_values(t.launches, "producto")


@query("set_03_union_sources", """
SELECT property, COUNT(*) AS rows, CAST(SUM(clicks) AS BIGINT) AS clicks, COUNT(note) AS notes FROM (
 SELECT property, clicks, NULL AS note FROM gsc_metrics WHERE property = 'site-a' UNION ALL SELECT property, clicks, query FROM gsc_metrics WHERE property = 'site-b') u GROUP BY 1""")
def _(t):
    a = t.gsc_metrics.where("property = 'site-a'").select("property", "clicks")
    b = t.gsc_metrics.where("property = 'site-b'").select("clicks", "property", F.col("query").alias("note"))
    return union_sources(a, b).groupBy("property").agg(
        F.count("*").alias("rows"), F.sum("clicks").alias("clicks"), F.count("note").alias("notes"))


@query("set_04_difference", """
SELECT DISTINCT event_name FROM commercial_calendar WHERE event_name NOT IN (SELECT event_name FROM commercial_calendar WHERE event_date >= DATE '2024-05-01')""")
def _(t):
    known = t.commercial_calendar.where("event_date >= date'2024-05-01'").select("event_name")
    return joins.new_rows(t.commercial_calendar.select("event_name").distinct(), known, ["event_name"])
