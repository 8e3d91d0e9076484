"""Merges, incremental windows and file checks."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..operators import scoring, series, upsert, validate
from ..operators.upsert import MergeSpec
from .registry import query

ORDER_COLS = ["id", "financial_status", "fulfillment_status", "total_price", "currency"]


def order_batch(t):
    """The order table, and a later batch as large: even ids come again, odd ones as new keys."""
    target = t.shopify_orders.select(*ORDER_COLS)
    key = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id"))
    batch = target.withColumn("id", key).withColumn("financial_status", F.lit("voided")).withColumn(
        "total_price", F.col("total_price") + 1).withColumn("currency", F.lit("USD"))
    return target, batch


@query("ups_01_upsert", """
SELECT id, CASE WHEN id % 2 = 0 THEN 'voided' ELSE financial_status END AS financial_status, fulfillment_status, CASE WHEN id % 2 = 0 THEN total_price + 1 ELSE total_price END AS total_price, currency FROM shopify_orders
UNION ALL SELECT -id, 'voided', fulfillment_status, total_price + 1, 'USD' FROM shopify_orders WHERE id % 2 = 1""")
def _(t):
    target, batch = order_batch(t)
    return upsert.upsert(target, batch, MergeSpec(("id",), ("financial_status", "total_price")))


@query("ups_02_insert_missing", """
SELECT id, financial_status, total_price FROM shopify_orders UNION ALL SELECT -id, 'voided', total_price + 1 FROM shopify_orders WHERE id % 2 = 1""")
def _(t):
    target, batch = order_batch(t)
    return upsert.insert_missing(target, batch, ["id"]).select("id", "financial_status", "total_price")


def message_batch(t):
    """The messages, and a later fetch of all: edited, some scored, some under new ids."""
    target = t.crisp_messages.withColumn("sentiment_magnitude", F.lit(None).cast("double"))
    n = F.length("content")
    batch = target.select(
        F.when(n % 3 == 0, F.concat(F.lit("new-"), "message_id")).otherwise(F.col("message_id")).alias("message_id"), "session_id", "created_at",
        "sender_type", "operator_name", F.concat(F.lit("edited "), "content").alias("content"), F.when(n % 2 == 0, F.lit(0.25)).alias("sentiment_score"),
        F.lit(2.0).alias("sentiment_magnitude"))
    return target, batch


@query("ups_03_ordered_merge", """
WITH t AS (SELECT * FROM crisp_messages), s AS (SELECT CASE WHEN length(content) % 3 = 0 THEN concat('new-', message_id) ELSE message_id END AS message_id, concat('edited ', content) AS new_content,
  CASE WHEN length(content) % 2 = 0 THEN 0.25e0 END AS new_score FROM crisp_messages)
SELECT COALESCE(t.message_id, s.message_id) AS message_id, CASE WHEN t.message_id IS NULL THEN s.new_content WHEN s.message_id IS NOT NULL AND NOT (t.sentiment_score IS NULL AND s.new_score IS NOT NULL) THEN s.new_content ELSE t.content END AS content,
  CASE WHEN t.message_id IS NULL THEN s.new_score WHEN s.message_id IS NOT NULL AND t.sentiment_score IS NULL AND s.new_score IS NOT NULL THEN s.new_score ELSE t.sentiment_score END AS sentiment_score,
  CASE WHEN t.message_id IS NULL OR (s.message_id IS NOT NULL AND t.sentiment_score IS NULL AND s.new_score IS NOT NULL) THEN 2e0 END AS sentiment_magnitude
FROM t FULL OUTER JOIN s ON t.message_id = s.message_id""")
def _(t):
    target, batch = message_batch(t)
    spec = MergeSpec(("message_id",), clauses=upsert.message_clauses())
    return upsert.upsert(target, batch, spec).select("message_id", "content", "sentiment_score", "sentiment_magnitude")


@query("ups_04_keep_columns", """
SELECT staff_id, CASE WHEN list_pos % 2 = 0 THEN concat('new.', email) ELSE email END AS email, employee_code, CASE WHEN list_pos % 2 = 0 THEN FALSE ELSE active END AS active FROM shopify_staff
UNION ALL SELECT concat('n', staff_id), concat('new.', email), concat('gen.', employee_code), FALSE FROM shopify_staff WHERE list_pos % 2 = 1""")
def _(t):
    s = t.shopify_staff
    cols = ["staff_id", "email", "employee_code", "active"]
    batch = s.select(
        "list_pos", F.when(F.col("list_pos") % 2 == 0, F.col("staff_id")).otherwise(F.concat(F.lit("n"), "staff_id")).alias("staff_id"),
        F.concat(F.lit("new."), "email").alias("email"), F.concat(F.lit("gen."), "employee_code").alias("employee_code"), F.lit(False).alias("active"))
    # The batch may arrive as arrays of structs, one page of staff each.
    packed = batch.groupBy(F.floor(F.col("list_pos") / 100).alias("page")).agg(F.collect_list(F.struct(*cols)).alias("rows"))
    rows = packed.select(F.explode("rows").alias("r")).select("r.*")
    return upsert.upsert(s.select(*cols), rows, MergeSpec(("staff_id",), ("email", "active")))


@query("ups_06_set_flag", """
SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM crisp_messages WHERE operator_name = 'op2') THEN TRUE ELSE messages_synced END AS messages_synced FROM crisp_conversations""")
def _(t):
    ids = t.crisp_messages.where("operator_name = 'op2'").select("session_id")
    return upsert.set_flag(t.crisp_conversations, ids, "session_id", "messages_synced").select("session_id", "messages_synced")


CHANGES = """changes AS (SELECT employee_code, seq, CASE seq WHEN 1 THEN 'operations' WHEN 2 THEN 'management' ELSE 'executive' END AS team, concat('new', CAST(seq AS VARCHAR)) AS role, CAST(50 AS BIGINT) AS allocation_pct,
  DATE '2024-02-01' + CAST(seq * 10 AS INT) AS valid_from, CAST(NULL AS DATE) AS valid_to, seq <> 2 AS is_primary, concat(employee_code, '#', CAST(seq AS VARCHAR)) AS assignment_id
 FROM (SELECT employee_code, unnest([1, 2, 3]) AS seq FROM shopify_staff) s)"""


def staff_changes(t):
    seq = F.col("seq")
    return (
        t.shopify_staff.select("employee_code", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
        .select("employee_code", "seq", F.when(seq == 1, "operations").when(seq == 2, "management").otherwise("executive").alias("team"),
                F.concat(F.lit("new"), seq).alias("role"), F.lit(50).cast("bigint").alias("allocation_pct"),
                F.date_add(F.to_date(F.lit("2024-02-01")), seq * 10).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                (seq != 2).alias("is_primary"), F.concat("employee_code", F.lit("#"), seq).alias("assignment_id"))
    )


@query("ups_07_scd2", f"""
WITH {CHANGES}, first_change AS (SELECT employee_code, MIN(valid_from) AS d FROM changes WHERE is_primary GROUP BY 1)
SELECT a.assignment_id, a.employee_code, a.team, a.role, a.allocation_pct, a.valid_from, CASE WHEN a.is_primary AND a.valid_to IS NULL AND f.d IS NOT NULL THEN f.d - 1 ELSE a.valid_to END AS valid_to, a.is_primary
FROM staff_assignments a LEFT JOIN first_change f ON a.employee_code = f.employee_code
UNION ALL SELECT c.assignment_id, c.employee_code, c.team, c.role, c.allocation_pct, c.valid_from, CASE WHEN c.is_primary THEN (SELECT MIN(n.valid_from) - 1 FROM changes n WHERE n.employee_code = c.employee_code AND n.seq > c.seq AND n.is_primary) END, c.is_primary FROM changes c""",
       ["valid_from", "valid_to"])
def _(t):
    return upsert.scd2_apply(t.staff_assignments, staff_changes(t))


@query("ups_07_changeable", f"""
WITH {CHANGES} SELECT assignment_id FROM changes WHERE employee_code IN (SELECT employee_code FROM staff_assignments WHERE is_primary AND valid_to IS NULL)""")
def _(t):
    return upsert.changeable(staff_changes(t), t.staff_assignments).select("assignment_id")


@query("ups_09_high_water", "SELECT occurred_at AS last_processed_at, audit_id AS last_event_id FROM shopify_audit_log ORDER BY occurred_at DESC, audit_id DESC LIMIT 1", ["last_processed_at"])
def _(t):
    return upsert.high_water(t.shopify_audit_log, "occurred_at", "audit_id")


@query("ups_09_rows_in_window", "SELECT action, COUNT(*) AS n FROM shopify_audit_log WHERE occurred_at >= TIMESTAMP '2024-01-20 10:00:00' GROUP BY 1")
def _(t):
    start = upsert.window_start(datetime(2024, 2, 1), mark=datetime(2024, 1, 20, 12), overlap=timedelta(hours=2))
    return upsert.rows_in_window(t.shopify_audit_log, "occurred_at", start).groupBy("action").agg(F.count("*").alias("n"))


@query("ups_10_load_batch", """
WITH b AS (SELECT * FROM (SELECT id, order_id, title, quantity, row_number() OVER (PARTITION BY id ORDER BY product_id, quantity, price) AS rn FROM shopify_order_lines) x WHERE rn = 1)
SELECT id, order_id, concat('new ', title) AS title, quantity FROM b UNION ALL SELECT -id, order_id, title, quantity FROM b WHERE quantity % 2 = 1""")
def _(t):
    cols = ["id", "order_id", "title", "quantity"]
    order = [F.col(c) for c in ("product_id", "quantity", "price")]
    key = F.when(F.col("quantity") % 2 == 0, F.col("id")).otherwise(-F.col("id"))
    known = series.dedupe_first(t.shopify_order_lines, ["id"], order).withColumn("id", key).select(*cols)
    batch = t.shopify_order_lines.withColumn("title", F.concat(F.lit("new "), "title"))
    return upsert.load_batch(batch, known, MergeSpec(("id",), ("title", "quantity")), order).select(*cols)


@query("ups_11_enrich_pending", """
WITH p AS (SELECT message_id FROM crisp_messages WHERE sender_type = 'user' AND sentiment_score IS NULL AND length(content) > 3)
SELECT message_id, CASE WHEN message_id IN (SELECT message_id FROM p) THEN 0e0 ELSE sentiment_score END AS sentiment_score FROM crisp_messages""")
def _(t):
    messages = t.crisp_messages.withColumn("sentiment_magnitude", F.lit(None).cast("double"))
    factory = scoring.lexicon_scorer(frozenset(), frozenset())
    scored = upsert.enrich_pending(messages, lambda rows: scoring.score_texts(rows, factory), None)
    return scored.select("message_id", "sentiment_score")


@query("udf_01_score_texts", """
SELECT message_id, CASE WHEN length(content) > 3 THEN (len(list_filter(w, lambda x: x IN ('le', 'la', 'the', 'der'))) - len(list_filter(w, lambda x: x IN ('de', 'and', 'sch'))))
  / CAST(NULLIF(len(list_filter(w, lambda x: x IN ('le', 'la', 'the', 'der', 'de', 'and', 'sch'))), 0) AS DOUBLE) END AS sentiment_score
FROM (SELECT *, list_transform(regexp_split_to_array(lower(content), '\\s+'), lambda x: trim(x, '.,;:!?')) AS w FROM crisp_messages) m""".replace("\\\\s", "\\s"))
def _(t):
    factory = scoring.lexicon_scorer(frozenset(["le", "la", "the", "der"]), frozenset(["de", "and", "sch"]))
    out = scoring.score_texts(t.crisp_messages.select("message_id", "content"), factory)
    return out.select("message_id", F.when(F.col("sentiment_magnitude") > 0, F.col("sentiment_score")).alias("sentiment_score"))


@query("ups_12_merge_preview", """
SELECT COUNT(*) AS rows, COUNT(CASE WHEN id % 2 = 1 THEN 1 END) AS to_insert, COUNT(CASE WHEN id % 2 = 0 THEN 1 END) AS to_update FROM shopify_orders""")
def _(t):
    target, batch = order_batch(t)
    return upsert.merge_preview(target, batch, ["id"])


# A staff file with every kind of error, derived from the staff table.
STAFF_FILE = """f AS (SELECT list_pos AS line, CASE WHEN list_pos % 17 = 0 THEN concat('s', staff_id) WHEN list_pos % 19 = 0 THEN '77' ELSE CAST(list_pos AS VARCHAR) END AS staff_id,
  CASE WHEN list_pos % 23 = 0 THEN 'nobody' ELSE email END AS email, CASE WHEN list_pos % 29 = 0 THEN 'Bad Code' WHEN list_pos % 31 = 0 THEN 'emp.same' ELSE employee_code END AS employee_code,
  CASE WHEN list_pos % 37 = 0 THEN 'maybe' WHEN list_pos % 2 = 0 THEN '' ELSE 'true' END AS active, CASE WHEN list_pos % 41 = 0 THEN '2024-13-01' WHEN list_pos % 43 = 0 THEN '1/2/2024' WHEN list_pos % 3 = 0 THEN '2024-03-15' END AS joined_at FROM shopify_staff)"""


def staff_file(t):
    n = F.col("list_pos")
    return t.shopify_staff.select(
        n.alias("line"), F.when(n % 17 == 0, F.concat(F.lit("s"), "staff_id")).when(n % 19 == 0, "77").otherwise(n.cast("string")).alias("staff_id"),
        F.when(n % 23 == 0, "nobody").otherwise(F.col("email")).alias("email"), "first_name", "last_name",
        F.when(n % 29 == 0, "Bad Code").when(n % 31 == 0, "emp.same").otherwise(F.col("employee_code")).alias("employee_code"),
        F.when(n % 37 == 0, "maybe").when(n % 2 == 0, "").otherwise("true").alias("active"),
        F.when(n % 41 == 0, "2024-13-01").when(n % 43 == 0, "1/2/2024").when(n % 3 == 0, "2024-03-15").alias("joined_at"))


ID_OK, CODE_OK = "regexp_matches(staff_id, '^\\d+$')", "regexp_matches(employee_code, '^[a-z0-9._-]+$')"


@query("val_01_validate_staff", f"""
WITH {STAFF_FILE}, x AS (SELECT *, row_number() OVER (PARTITION BY staff_id ORDER BY line) AS a, row_number() OVER (PARTITION BY employee_code ORDER BY line) AS b FROM f)
SELECT line, staff_id, employee_code, joined_at = '2024-03-15' AND joined_at IS NOT NULL AS dated, concat_ws('|', CASE WHEN NOT {ID_OK} THEN 'staff_id' END, CASE WHEN {ID_OK} AND a > 1 THEN 'staff_id duplicate' END, CASE WHEN NOT contains(email, '@') THEN 'email' END,
 CASE WHEN NOT {CODE_OK} THEN 'employee_code' END, CASE WHEN {CODE_OK} AND b > 1 THEN 'employee_code duplicate' END, CASE WHEN active = 'maybe' THEN 'active' END, CASE WHEN joined_at IN ('2024-13-01', '1/2/2024') THEN 'joined_at' END) AS errors FROM x""")
def _(t):
    checked = validate.validate_staff(staff_file(t))
    return checked.select("line", "staff_id", "employee_code", F.coalesce(F.col("joined_at") == date(2024, 3, 15), F.lit(False)).alias("dated"),
                          F.array_join("errors", "|").alias("errors"))


@query("val_01_accept_file", f"""
WITH {STAFF_FILE} SELECT 'bad' AS file, line, staff_id FROM f WHERE (SELECT COUNT(*) FROM f WHERE NOT {ID_OK}) = 0
UNION ALL SELECT 'good', line, CAST(line AS VARCHAR) FROM f""")
def _(t):
    n = F.col("list_pos")
    bad = validate.accept_file(validate.validate_staff(staff_file(t)))
    good = t.shopify_staff.select(n.alias("line"), n.cast("string").alias("staff_id"), "email", "first_name", "last_name", "employee_code",
                                  F.lit("").alias("active"), F.lit("2024-03-15").alias("joined_at"))
    kept = validate.accept_file(validate.validate_staff(good))
    return bad.select(F.lit("bad").alias("file"), "line", "staff_id").unionAll(kept.select(F.lit("good"), "line", "staff_id"))


ASSIGN_FILE = """f AS (SELECT list_pos AS line, CASE WHEN list_pos % 13 = 0 THEN 'emp.none' ELSE employee_code END AS employee_code, CASE list_pos % 5 WHEN 0 THEN '' WHEN 1 THEN 'operations' WHEN 2 THEN 'executive' WHEN 3 THEN 'pirates' ELSE 'customer_service' END AS new_team,
  CASE WHEN list_pos % 7 = 0 THEN '2024-02-31' ELSE '2024-02-01' END AS valid_from, CASE WHEN list_pos % 11 = 0 THEN '0' WHEN list_pos % 3 = 0 THEN '' WHEN list_pos % 10 = 1 THEN 'x' ELSE '80' END AS allocation_pct,
  CASE WHEN list_pos % 2 = 0 THEN '' WHEN list_pos % 9 = 1 THEN 'false' ELSE 'true' END AS is_primary FROM shopify_staff)"""


@query("val_02_validate_assignments", f"""
WITH {ASSIGN_FILE} SELECT line, employee_code, new_team AS team, CASE WHEN valid_from <> '2024-02-31' THEN CAST(DATE '2024-02-01' AS VARCHAR) END AS valid_from, CASE allocation_pct WHEN '' THEN 100 WHEN 'x' THEN NULL ELSE CAST(TRY_CAST(allocation_pct AS INT) AS BIGINT) END AS allocation_pct,
  is_primary <> 'false' AS is_primary, concat_ws('|', CASE WHEN new_team = 'pirates' THEN 'team' END, CASE WHEN employee_code = 'emp.none' THEN 'employee_code' END, CASE WHEN valid_from = '2024-02-31' THEN 'valid_from' END,
  CASE WHEN allocation_pct IN ('0', 'x') THEN 'allocation_pct' END) AS errors FROM f WHERE new_team <> ''""")
def _(t):
    n = F.col("list_pos")
    rows = t.shopify_staff.select(
        n.alias("line"), F.when(n % 13 == 0, "emp.none").otherwise(F.col("employee_code")).alias("employee_code"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "operations").when(n % 5 == 2, "executive").when(n % 5 == 3, "pirates").otherwise("customer_service").alias("new_team"),
        F.lit("r").alias("new_role"), F.when(n % 7 == 0, "2024-02-31").otherwise("2024-02-01").alias("valid_from"),
        F.when(n % 11 == 0, "0").when(n % 3 == 0, "").when(n % 10 == 1, "x").otherwise("80").alias("allocation_pct"),
        F.when(n % 2 == 0, "").when(n % 9 == 1, "false").otherwise("true").alias("is_primary"), F.lit(None).cast("string").alias("notes"))
    checked = validate.validate_assignments(rows, t.shopify_staff)
    return checked.select("line", "employee_code", "team", F.col("valid_from").cast("string").alias("valid_from"), "allocation_pct", "is_primary",
                          F.array_join("errors", "|").alias("errors"))
