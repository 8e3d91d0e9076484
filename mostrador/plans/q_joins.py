"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from .registry import D0, D1, NET, query, total, wavg

DAY = f"date BETWEEN DATE '{D0}' AND DATE '{D1}'"


@query("jn_01_sold_lines", f"""
SELECT L.id, L.order_id, L.quantity, L.price FROM shopify_order_lines L JOIN shopify_orders O ON L.order_id = O.id
WHERE O.created_at >= TIMESTAMP '{D0}' AND O.created_at <= TIMESTAMP '{D1}' AND O.{NET}""")
def _(t):
    return joins.sold_lines(t.shopify_orders, t.shopify_order_lines, D0, D1).select("id", "order_id", "quantity", "price")


@query("jn_02_audit_enriched", """
WITH events AS (SELECT audit_id, occurred_at, staff_id, staff_email, action, subject_type, subject_id, raw_payload FROM shopify_audit_log),
people AS (SELECT staff_id, min(employee_code) AS code, min(email) AS mail, any_value(concat_ws(' ', ifnull(first_name, ''), ifnull(last_name, ''))) AS person FROM shopify_staff GROUP BY staff_id)
SELECT events.* EXCLUDE (staff_email), ifnull(code, 'unknown') AS employee_code, ifnull(mail, staff_email) AS staff_email, person AS staff_full_name FROM events JOIN people USING (staff_id)
UNION ALL SELECT events.* EXCLUDE (staff_email), 'unknown', staff_email, ' ' FROM events ANTI JOIN people USING (staff_id)""", ["occurred_at"])
def _(t):
    return joins.audit_enriched(t.shopify_audit_log, t.shopify_staff)


@query("jn_03_activity_with_team", """
WITH terms AS (SELECT employee_code, team, role, is_primary, allocation_pct, valid_from AS first_day, ifnull(valid_to, DATE '9999-12-31') AS last_day FROM staff_assignments WHERE is_primary),
numbered AS (SELECT *, row_number() OVER () AS n FROM activity_log),
found AS (SELECT n, terms.* EXCLUDE (employee_code, first_day, last_day) FROM numbered JOIN terms USING (employee_code) WHERE CAST(occurred_at AS DATE) BETWEEN first_day AND last_day)
SELECT * EXCLUDE (n) FROM numbered LEFT JOIN found USING (n)""", ["occurred_at"])
def _(t):
    return joins.activity_with_team(t.activity_log, t.staff_assignments)


@query("jn_05_traffic_with_orders", f"""
SELECT t.date, t.total_sessions, COUNT(o.id) AS orders FROM shopify_traffic_daily t
LEFT JOIN shopify_orders o ON CAST(o.created_at AS DATE) = t.date AND o.{NET} GROUP BY t.date, t.total_sessions""", ["date"])
def _(t):
    return joins.traffic_with_orders(t.shopify_traffic_daily, t.shopify_orders, D0, D1).select("date", "total_sessions", "orders")


@query("jn_06_marketing_join", """
WITH e AS (SELECT CAST(date AS DATE) AS day, CAST(SUM(CASE WHEN metric_name = 'Opened Email' THEN count ELSE 0 END) AS BIGINT) AS opened FROM klaviyo_metrics GROUP BY 1)
SELECT g.date, g.channel, g.source_medium, g.campaign_name, e.opened AS related_emails_opened
FROM (SELECT DISTINCT date, session_default_channel_group AS channel, session_source_medium AS source_medium, campaign_name FROM raw_traffic_ga4) g
LEFT JOIN e ON g.date = e.day AND g.channel = 'Email'""", ["date"])
def _(t):
    return joins.marketing_traffic(t.raw_traffic_ga4, t.klaviyo_metrics).select(
        "date", "channel", "source_medium", "campaign_name", "related_emails_opened")


@query("jn_07_seo_position", f"""
WITH g AS (SELECT regexp_extract(page, '/products/([^/?]+)', 1) AS handle, {wavg('position', 'impressions')} AS seo_position FROM gsc_metrics GROUP BY 1)
SELECT p.id, p.handle, g.seo_position FROM shopify_products p LEFT JOIN g ON p.handle = g.handle""")
def _(t):
    return joins.seo_position(t.shopify_products, t.gsc_metrics, D0, D1).select("id", "handle", "seo_position")


@query("jn_08_product_pages", f"""
SELECT g.page, g.query, {total('g.clicks')} AS clicks FROM gsc_metrics g
WHERE contains(g.page, concat('/products/', (SELECT handle FROM shopify_products WHERE id = 3))) GROUP BY 1, 2""")
def _(t):
    return joins.product_pages(t.gsc_metrics, t.shopify_products, 3).groupBy("page", "query").agg(F.sum("clicks").alias("clicks"))


@query("jn_08_product_pages_all", """
WITH p AS (SELECT DISTINCT page FROM gsc_metrics), h AS (SELECT id AS product_id, handle FROM shopify_products)
SELECT p.page, h.product_id, h.handle FROM p JOIN h ON contains(p.page, concat('/products/', h.handle))""")
def _(t):
    return joins.product_pages_all(t.gsc_metrics, t.shopify_products)


@query("jn_09_product_seo_card", f"""
SELECT p.title, p.handle, p.vendor, g.* FROM (SELECT * FROM shopify_products WHERE id = 17) p,
 (SELECT {total('clicks')} AS clicks, {total('impressions')} AS impressions, {wavg('position', 'impressions')} AS avg_position FROM gsc_metrics
  WHERE contains(page, concat('/products/', (SELECT handle FROM shopify_products WHERE id = 17))) AND {DAY}) g""")
def _(t):
    return joins.product_seo_card(t.shopify_products, t.gsc_metrics, 17, D0, D1)


@query("jn_10_mark_synced", """
SELECT session_id, CASE WHEN EXISTS (SELECT 1 FROM crisp_messages m WHERE m.session_id = c.session_id AND m.sender_type = 'operator') THEN TRUE ELSE messages_synced END AS messages_synced
FROM crisp_conversations c""")
def _(t):
    return joins.mark_synced(t.crisp_conversations, t.crisp_messages.where("sender_type = 'operator'")).select("session_id", "messages_synced")


@query("jn_11_unassigned_staff", """
SELECT s.employee_code FROM shopify_staff s LEFT JOIN staff_assignments a ON s.employee_code = a.employee_code AND a.valid_to IS NULL WHERE a.employee_code IS NULL""")
def _(t):
    return joins.unassigned_staff(t.shopify_staff, t.staff_assignments)


@query("jn_11_new_staff", """
SELECT DISTINCT staff_id, staff_email FROM shopify_audit_log WHERE staff_id IS NOT NULL AND staff_id NOT IN (SELECT staff_id FROM shopify_staff)""")
def _(t):
    seen = t.shopify_audit_log.where("staff_id is not null").select("staff_id", "staff_email").distinct()
    return joins.new_rows(seen, t.shopify_staff, ["staff_id"])


SECOND_SYNC = """two AS (SELECT keyword, keyword_type, trend_date, interest_value FROM market_trends
  UNION ALL SELECT keyword, CASE WHEN interest_value % 2 = 0 THEN 'product' ELSE keyword_type END, trend_date, 100 - interest_value FROM market_trends)"""


def second_sync(trends):
    """The series after a second sync that also wrote rows of another type: ties on purpose."""
    first = trends.select("keyword", "keyword_type", "trend_date", "interest_value")
    kind = F.when(F.col("interest_value") % 2 == 0, F.lit("product")).otherwise(F.col("keyword_type"))
    return first.unionAll(first.select("keyword", kind, "trend_date", 100 - F.col("interest_value")))


@query("jn_12_latest_signal", f"""
WITH {SECOND_SYNC}, l AS (SELECT keyword, MAX(trend_date) AS d FROM two WHERE keyword_type = 'brand' GROUP BY 1)
SELECT two.keyword, two.keyword_type, two.trend_date, CAST(two.interest_value AS BIGINT) AS interest_value FROM two JOIN l ON two.keyword = l.keyword AND two.trend_date = l.d""", ["trend_date"])
def _(t):
    return joins.latest_signal(second_sync(t.market_trends))


@query("jn_13_position_report", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY scan_date DESC, scraped_at DESC, product_id) AS rn FROM shopping_position),
h AS (SELECT keyword, COUNT(*) AS scans, string_agg(concat(CAST(scan_date AS VARCHAR), '/', COALESCE(CAST(organic_position AS VARCHAR), '-'), '/', COALESCE(CAST(paid_position AS VARCHAR), '-')), '|'
   ORDER BY scan_date, organic_position NULLS FIRST, paid_position NULLS FIRST) AS history FROM shopping_position WHERE scan_date >= DATE '2001-10-01' - 60 GROUP BY 1)
SELECT l.keyword, l.product_id, l.organic_position, l.paid_position, l.top_competitor_name, l.scan_date, l.scraped_at,
  p.organic_position AS prev_organic_position, p.paid_position AS prev_paid_position, h.scans, h.history
FROM r l LEFT JOIN r p ON l.keyword = p.keyword AND p.rn = 2 LEFT JOIN h ON l.keyword = h.keyword WHERE l.rn = 1""", ["scan_date", "scraped_at"])
def _(t):
    from ..operators.series import shopping_position_report

    rep = shopping_position_report(t.shopping_position, "2001-10-01")
    dash = F.lit("-")
    shown = F.flatten(F.transform("history", lambda h: F.array_repeat(F.concat_ws(
        "/", h["scan_date"].cast("string"), F.coalesce(h["organic_position"].cast("string"), dash),
        F.coalesce(h["paid_position"].cast("string"), dash)), h["scans"].cast("int"))))
    return rep.withColumn("scans", F.aggregate("history", F.lit(0).cast("bigint"), lambda a, h: a + h["scans"])).withColumn(
        "history", F.array_join(shown, "|"))


@query("jn_14_match_launches", """
WITH cand AS (SELECT DISTINCT producto, marca FROM launches), shelf AS (SELECT DISTINCT lower(title) AS title, lower(vendor) AS vendor FROM shopify_products),
hit AS (SELECT DISTINCT c.producto, c.marca FROM cand c JOIN shelf p ON (contains(p.title, lower(c.producto)) OR contains(p.title, lower(c.marca)))
  AND (contains(p.vendor, lower(c.marca)) OR contains(lower(c.marca), p.vendor)))
SELECT l.id, l.producto, l.marca, CASE WHEN h.producto IS NOT NULL THEN 'EXISTENTE' ELSE 'NUEVO LANZAMIENTO' END AS estado_db
FROM launches l LEFT JOIN hit h ON l.producto = h.producto AND l.marca = h.marca""")
def _(t):
    return joins.match_launches(t.launches, t.shopify_products).select("id", "producto", "marca", "estado_db")


# The launch names above carry a model suffix; here they are cut to what shops print.
@query("jn_14_match_launch_names", """
WITH named AS (SELECT id, split_part(producto, ' mk', 1) AS producto, marca FROM launches), cand AS (SELECT DISTINCT producto, marca FROM named),
shelf AS (SELECT DISTINCT lower(title) AS title, lower(vendor) AS vendor FROM shopify_products),
hit AS (SELECT DISTINCT c.producto, c.marca FROM cand c JOIN shelf p ON (contains(p.title, lower(c.producto)) OR contains(p.title, lower(c.marca)))
  AND (contains(p.vendor, lower(c.marca)) OR contains(lower(c.marca), p.vendor)))
SELECT l.id, l.producto, l.marca, CASE WHEN h.producto IS NOT NULL THEN 'EXISTENTE' ELSE 'NUEVO LANZAMIENTO' END AS estado_db
FROM named l LEFT JOIN hit h ON l.producto = h.producto AND l.marca = h.marca""")
def _(t):
    named = t.launches.withColumn("producto", F.split_part("producto", F.lit(" mk"), F.lit(1)))
    return joins.match_launches(named, t.shopify_products).select("id", "producto", "marca", "estado_db")


@query("jn_15_attribute_names", """
WITH r AS (SELECT metric_name, CASE WHEN flow_name = '' THEN '' ELSE concat('f', flow_name) END AS flow_id, CASE WHEN campaign_name = '' THEN 'mx' ELSE concat('m', campaign_name) END AS message_id, count FROM klaviyo_metrics),
f AS (SELECT DISTINCT concat('f', flow_name) AS id, flow_name AS name FROM klaviyo_metrics WHERE flow_name <> '' AND flow_name <> 'Flow 3'),
c AS (SELECT DISTINCT concat('m', campaign_name) AS id, campaign_name AS name FROM klaviyo_metrics WHERE campaign_name <> '')
SELECT CASE WHEN r.flow_id <> '' THEN COALESCE(f.name, concat('(ID: ', r.flow_id, ')')) ELSE '' END AS flow_name,
  CASE WHEN r.flow_id = '' AND r.message_id <> '' THEN COALESCE(c.name, concat('(ID: ', r.message_id, ')')) ELSE '' END AS campaign_name,
  metric_name, CAST(SUM(count) AS BIGINT) AS count FROM r LEFT JOIN f ON r.flow_id = f.id LEFT JOIN c ON r.message_id = c.id GROUP BY 1, 2, 3""")
def _(t):
    m = t.klaviyo_metrics
    rows = m.select("metric_name", "count",
                    F.when(F.col("flow_name") == "", "").otherwise(F.concat(F.lit("f"), "flow_name")).alias("flow_id"),
                    F.when(F.col("campaign_name") == "", "mx").otherwise(F.concat(F.lit("m"), "campaign_name")).alias("message_id"))
    flows = m.where("flow_name not in ('', 'Flow 3')").select(F.concat(F.lit("f"), "flow_name").alias("id"), F.col("flow_name").alias("name")).distinct()
    mails = m.where("campaign_name <> ''").select(F.concat(F.lit("m"), "campaign_name").alias("id"), F.col("campaign_name").alias("name")).distinct()
    return joins.attribute_names(rows, flows, mails).groupBy("flow_name", "campaign_name", "metric_name").agg(F.sum("count").alias("count"))


NORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
ATTRIBUTED = f"""
WITH e AS (SELECT id, author_id, regexp_extract(id, 'staff_member_id=(\\d+)', 1) AS gid, {NORM.format('message')} AS msg,
  list_transform(regexp_extract_all(message, '<a[^>]*>(.*?)</a>', 1), lambda x: {NORM.format('x')}) AS links FROM audit_raw),
s AS (SELECT staff_id, list_pos, {NORM.format('first_name')} AS fn, {NORM.format('last_name')} AS ln, {NORM.format("concat(first_name, ' ', last_name)")} AS full_name
  FROM shopify_staff WHERE first_name IS NOT NULL AND last_name IS NOT NULL),
m AS (SELECT e.id, min_by(s.staff_id, s.list_pos) AS staff_id FROM e JOIN s ON e.author_id IS NULL AND e.gid = '' AND e.msg IS NOT NULL AND (
   contains(e.msg, s.full_name) OR len(list_filter(e.links, lambda x: contains(x, s.full_name) OR (contains(x, s.fn) AND contains(x, s.ln)))) > 0
   OR (contains(concat(' ', e.msg, ' '), concat(' ', s.fn, ' ')) AND contains(concat(' ', e.msg, ' '), concat(' ', s.ln, ' ')))
   OR (length(s.fn) >= 4 AND len(e.links) > 0 AND contains(concat(' ', e.links[1], ' '), concat(' ', s.fn, ' ')))) GROUP BY e.id)
SELECT e.id, COALESCE(split_part(e.author_id, '/', 5), NULLIF(e.gid, ''), m.staff_id) AS staff_id FROM e LEFT JOIN m ON e.id = m.id"""


@query("jn_16_attribute_staff", ATTRIBUTED)
def _(t):
    raw = t.audit_raw.select("id", "message", F.struct(F.col("author_id").alias("id")).alias("author"))
    return joins.attribute_staff(raw, t.shopify_staff).select("id", "staff_id")


@query("alg_12_author_match", f"SELECT staff_id, COUNT(*) AS events FROM ({ATTRIBUTED}) x GROUP BY staff_id")
def _(t):
    raw = t.audit_raw.select("id", "message", F.struct(F.col("author_id").alias("id")).alias("author"))
    return joins.attribute_staff(raw, t.shopify_staff).groupBy("staff_id").agg(F.count("*").alias("events"))


@query("jn_17_convert_price", """
WITH p AS (SELECT product_id, our_price, CASE product_id % 8 WHEN 0 THEN 'us' WHEN 1 THEN 'cl' WHEN 2 THEN 'mx' WHEN 3 THEN 'ar' WHEN 4 THEN 'co' WHEN 5 THEN 'es' WHEN 6 THEN 'fr' END AS country FROM competitor_prices),
c AS (SELECT *, CASE country WHEN 'cl' THEN 'CLP' WHEN 'mx' THEN 'MXN' WHEN 'ar' THEN 'ARS' WHEN 'co' THEN 'COP' WHEN 'es' THEN 'EUR' ELSE 'USD' END AS target_currency FROM p),
r AS (SELECT *, CASE target_currency WHEN 'CLP' THEN 950e0 WHEN 'MXN' THEN 17.5e0 WHEN 'EUR' THEN 0.92e0 ELSE 1e0 END AS exchange_rate FROM c)
SELECT *, our_price * exchange_rate AS converted_price FROM r""")
def _(t):
    rates = t.spark.createDataFrame([("CLP", 950.0), ("MXN", 17.5), ("EUR", 0.92), ("USD", 5.0)], "currency string, rate double")
    where = F.expr("element_at(array('us','cl','mx','ar','co','es','fr',null), cast(product_id % 8 as int) + 1)")
    return joins.convert_price(t.competitor_prices.select("product_id", "our_price", where.alias("country")), rates)


@query("jn_18_join_as_string", """
SELECT a.product_id, a.n, p.title FROM (SELECT CAST(product_id AS VARCHAR) AS product_id, COUNT(*) AS n FROM shopify_order_lines GROUP BY 1) a
JOIN (SELECT CAST(id AS VARCHAR) AS product_id, title FROM shopify_products) p ON a.product_id = p.product_id""")
def _(t):
    counts = t.shopify_order_lines.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(F.count("*").alias("n"))
    return joins.join_as_string(counts, t.shopify_products.select(F.col("id").alias("product_id"), "title"), "product_id")


@query("jn_19_overlay", """
WITH b AS (SELECT DISTINCT strftime(trend_date, '%b %-d %Y') AS label FROM market_trends WHERE trend_date >= DATE '1996-01-01'),
s AS (SELECT strftime(trend_date, '%b %-d %Y') AS label, keyword AS term, DATE '2002-02-03' AS saved_on, NULLIF(interest_value, 50) AS value FROM market_trends)
SELECT s.label, concat(s.term, ' (', CAST(s.saved_on AS VARCHAR), ')') AS series, COALESCE(s.value, 0) AS value FROM s WHERE s.label IN (SELECT label FROM b)""")
def _(t):
    label = F.date_format("trend_date", "MMM d yyyy").alias("label")
    base = t.market_trends.where("trend_date >= date'1996-01-01'").select(label)
    saved = t.market_trends.select(label, F.col("keyword").alias("term"), F.to_date(F.lit("2002-02-03")).alias("saved_on"),
                                   F.nullif("interest_value", F.lit(50)).alias("value"))
    return joins.overlay(base, saved)


@query("jn_20_attach_volumes", """
SELECT p.id, p.title, COALESCE(v.avg_monthly_searches, 0) AS avg_monthly_searches, COALESCE(v.last_month_searches, 0) AS last_month_searches
FROM shopify_products p LEFT JOIN keyword_volumes v ON lower(split_part(p.title, ' ', 2)) = v.keyword""")
def _(t):
    items = t.shopify_products.select("id", "title", F.initcap(F.split_part("title", F.lit(" "), F.lit(2))).alias("keyword"))
    return joins.attach_volumes(items, t.keyword_volumes).drop("keyword")


@query("jn_20_attach_positions", """
WITH s AS (SELECT keyword, MIN(organic_position) AS organic_position FROM shopping_position GROUP BY 1)
SELECT p.id, p.keyword, s.organic_position FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'no such item' ELSE title END AS keyword FROM shopify_products) p JOIN s ON p.keyword = s.keyword""")
def _(t):
    items = t.shopify_products.select("id", F.when(F.col("id") % 4 == 0, "no such item").otherwise(F.col("title")).alias("keyword"))
    return joins.attach_positions(items, t.shopping_position.groupBy("keyword").agg(F.min("organic_position").alias("organic_position")))


