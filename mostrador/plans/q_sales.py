"""Sales, purchasing, customers, date filters."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.exprs import SOLD_SCAN, money_sum, sold
from ..operators import joins, overview, sales, team, upsert
from ..operators import market as mkt
from .registry import D0, D1, E0, E1, NET, count_if, div0, js, money, money_if, pct0, query, safe, total, wavg

DAYS = 7669  # days from D0 to D1
RANGE = f"created_at >= TIMESTAMP '{D0}' AND created_at <= TIMESTAMP '{D1}'"
ORDERS_IN = f"FROM shopify_orders WHERE {RANGE}"
SOLD_LINES = f"shopify_order_lines L JOIN shopify_orders O ON L.order_id = O.id WHERE O.{RANGE.replace('AND created_at', 'AND O.created_at')} AND O.{NET}"


# --- filters --------------------------------------------------------------------------

@query("flt_01_in_range", "SELECT id, created_at FROM shopify_orders WHERE created_at >= TIMESTAMP '1997-03-01' AND created_at <= TIMESTAMP '1997-06-30 12:00:00'", ["created_at"])
def _(t):
    return dt.in_range(t.shopify_orders, "created_at", "1997-03-01", "1997-06-30T12:00:00Z").select("id", "created_at")


for _name, _sql in {
    "mtd": "created_at >= TIMESTAMP '1997-05-01' AND created_at <= TIMESTAMP '1997-05-17 08:00:00'",
    "ytd": "created_at >= TIMESTAMP '1997-01-01' AND created_at <= TIMESTAMP '1997-05-17 08:00:00'",
    "30d": "created_at >= TIMESTAMP '1997-04-17 08:00:00' AND created_at <= TIMESTAMP '1997-05-17 08:00:00'",
}.items():
    @query(f"flt_01_default_{_name}", f"SELECT COUNT(*) AS orders, {money('total_price')} AS value FROM shopify_orders WHERE {_sql}")
    def _(t, _name=_name):
        kept = dt.in_range(t.shopify_orders, "created_at", "not a date", None, _name, datetime(1997, 5, 17, 8))
        return kept.agg(F.count("id").alias("orders"), money_sum("total_price").alias("value"))


for _name, (_a, _b) in {
    "today": ("2024-01-17", "2024-01-17"), "yesterday": ("2024-01-16", "2024-01-16"), "3d": ("2024-01-14", "2024-01-17"),
    "7d": ("2024-01-10", "2024-01-17"), "month": ("2024-01-01", "2024-01-17"), "quarter": ("2024-01-01", "2024-01-17"),
    "year": ("2024-01-01", "2024-01-17"),
}.items():
    @query(f"flt_02_preset_{_name}", f"SELECT action, COUNT(*) AS n FROM shopify_audit_log WHERE CAST(occurred_at AS DATE) BETWEEN DATE '{_a}' AND DATE '{_b}' GROUP BY action")
    def _(t, _name=_name):
        return dt.in_preset(t.shopify_audit_log, "occurred_at", _name, date(2024, 1, 17)).groupBy("action").agg(F.count("*").alias("n"))


@query("flt_03_in_dates", "SELECT date, total_sessions FROM shopify_traffic_daily WHERE date BETWEEN DATE '1996-02-01' AND DATE '1997-02-28'", ["date"])
def _(t):
    return dt.in_dates(t.shopify_traffic_daily, "date", "1996-02-01", "1997-02-28").select("date", "total_sessions")


@query("flt_04_maybe_range", """
SELECT 'open' AS mode, COUNT(*) AS n FROM crisp_conversations
UNION ALL SELECT 'half', COUNT(*) FROM crisp_conversations
UNION ALL SELECT 'both', COUNT(*) FROM crisp_conversations WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'""")
def _(t):
    modes = {"open": (None, None), "half": ("2024-01-05", None), "both": ("2024-01-05", "2024-01-20")}
    counts = [dt.maybe_range(t.crisp_conversations, "created_at", *b).agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n")
              for m, b in modes.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("flt_05_activity_filter", """
SELECT audit_id, staff_id, action FROM shopify_audit_log WHERE staff_id IN ('3', '17', '41', '88') AND action IN ('click', 'purchase')""")
def _(t):
    return team.filter_activity(t.shopify_audit_log, ["3", "17", "41", "88"], ["click", "purchase"]).select("audit_id", "staff_id", "action")


@query("flt_05_activity_filter_open", "SELECT action, COUNT(*) AS n FROM shopify_audit_log WHERE staff_id IS NOT NULL GROUP BY action")
def _(t):
    return team.filter_activity(t.shopify_audit_log).groupBy("action").agg(F.count("*").alias("n"))


@query("flt_06_sold_status", f"""
SELECT {count_if(NET)} AS net, {count_if("financial_status = 'paid'")} AS paid, {count_if("financial_status IN ('paid', 'partially_paid')")} AS scan FROM shopify_orders""")
def _(t):
    s = "financial_status"
    return t.shopify_orders.agg(F.count_if(sold(s)).alias("net"), F.count_if(sold(s, ("paid",))).alias("paid"),
                                F.count_if(sold(s, SOLD_SCAN)).alias("scan"))


OPEN = """financial_status = 'paid' AND COALESCE(fulfillment_status, '') <> 'fulfilled' AND (""" + " OR ".join(
    f"estado_de_pedido LIKE '{i}. %'" for i in range(6)) + ")"


@query("flt_07_open_orders_pred", f"SELECT id, estado_de_pedido FROM shopify_orders WHERE {OPEN}")
def _(t):
    return t.shopify_orders.where(sales.open_orders_pred()).select("id", "estado_de_pedido")


@query("flt_08_product_search", """
SELECT id, title, handle, vendor FROM shopify_products WHERE lower(title) LIKE '%ring%' OR lower(handle) LIKE '%ring%'
ORDER BY created_at DESC, id LIMIT 20""")
def _(t):
    return joins.product_search(t.shopify_products, " RING ").select("id", "title", "handle", "vendor")


@query("flt_09_product_prefix", "SELECT id, title FROM shopify_products WHERE title LIKE 'blue%' ORDER BY title, id LIMIT 10")
def _(t):
    return joins.product_prefix(t.shopify_products, "blue").select("id", "title")


@query("flt_10_unsynced", "SELECT session_id FROM crisp_conversations WHERE messages_synced IS NOT TRUE")
def _(t):
    return upsert.unsynced(t.crisp_conversations).select("session_id")


@query("flt_11_payload_search", """
SELECT audit_id, occurred_at, staff_id, action, json_extract_string(raw_payload, '$.k') AS k FROM shopify_audit_log
WHERE lower(raw_payload) LIKE '%: 7%' ORDER BY occurred_at DESC, audit_id LIMIT 10""", ["occurred_at"])
def _(t):
    hits = joins.payload_search(t.shopify_audit_log, ": 7", 10)
    return hits.select("audit_id", "occurred_at", "staff_id", "action", F.get_json_object("raw_payload", "$.k").alias("k"))


@query("flt_11_staff_search", "SELECT staff_id, email FROM shopify_staff WHERE lower(first_name) LIKE '%mach%' OR lower(last_name) LIKE '%mach%'")
def _(t):
    return joins.staff_search(t.shopify_staff, "MACH").select("staff_id", "email")


OPEN_LINES = f"""
SELECT o.id, o.order_number, o.created_at, o.total_price, o.currency, o.estado_de_pedido, l.id AS line_id, l.title, l.quantity, l.price, l.vendor
FROM (SELECT * FROM shopify_orders WHERE {OPEN}) o LEFT JOIN shopify_order_lines l ON o.id = l.order_id"""


@query("flt_12_open_order_search", f"""
WITH o AS ({OPEN_LINES}), hit AS (SELECT id, MAX(total_price) AS total_price FROM o
  GROUP BY id, CAST(order_number AS VARCHAR), estado_de_pedido
  HAVING (CAST(MAX(order_number) AS VARCHAR) LIKE '%widget%' OR bool_or(lower(title) LIKE '%widget%')) AND MAX(estado_de_pedido) LIKE '1%')
SELECT COALESCE({money('total_price')}, 0e0) AS total_amount, COUNT(*) AS orders FROM hit""")
def _(t):
    return sales.open_orders_total(sales.search_open_orders(t.shopify_orders, t.shopify_order_lines, "widget", "1"))


@query("flt_13_upcoming", """
SELECT event_name, event_date FROM commercial_calendar WHERE event_date >= DATE '2024-06-01'
ORDER BY event_date, event_name LIMIT 100""", ["event_date"])
def _(t):
    return mkt.upcoming(t.commercial_calendar, "2024-06-01").select("event_name", "event_date")


@query("flt_14_launch_search", """
SELECT id, producto, marca FROM launches WHERE scan_day = DATE '2024-01-03' AND (lower(producto) LIKE '%ring%' OR lower(marca) LIKE '%ring%')""")
def _(t):
    return mkt.launch_search(t.launches, "2024-01-03", "Ring").select("id", "producto", "marca")


@query("flt_15_pending_sentiment", """
SELECT message_id, content FROM crisp_messages WHERE sender_type = 'user' AND sentiment_score IS NULL AND content IS NOT NULL AND length(content) > 3""")
def _(t):
    return upsert.pending_sentiment(t.crisp_messages).select("message_id", "content")


@query("flt_16_changed_since", """
SELECT session_id FROM crisp_conversations WHERE updated_at >= TIMESTAMP '2024-01-12' OR created_at >= TIMESTAMP '2024-01-12'""")
def _(t):
    return upsert.changed_since(t.crisp_conversations, "2024-01-12").select("session_id")


# --- sales ----------------------------------------------------------------------------

@query("sal_01_sales_kpis", f"""
WITH s AS (SELECT {money('total_price')} AS gross_sales, {money_if(NET, 'total_price')} AS net_sales, COUNT(id) AS gross_order_count,
  {count_if(NET)} AS net_order_count, {money('total_discounts')} AS total_discounts, {money_if(NET, 'total_discounts')} AS net_discounts {ORDERS_IN})
SELECT *, {div0('net_sales', 'net_order_count')} AS aov, net_sales / {DAYS}e0 AS average_daily_sales FROM s""")
def _(t):
    return sales.sales_kpis(t.shopify_orders, D0, D1)


@query("sal_02_sales_trend", f"""
SELECT CAST(created_at AS DATE) AS date, {money_if(NET, 'total_price')} AS net_sales, {money('total_price')} AS gross_sales, COUNT(id) AS orders
{ORDERS_IN} GROUP BY 1""", ["date"])
def _(t):
    return sales.sales_trend(t.shopify_orders, D0, D1)


@query("sal_03_status_mix", f"""
SELECT COALESCE(financial_status, 'unknown') AS status, COUNT(id) AS count, {money('total_price')} AS value {ORDERS_IN} GROUP BY 1""")
def _(t):
    return sales.status_mix(t.shopify_orders, D0, D1)


DAILY = f"""SELECT CAST(created_at AS DATE) AS sale_date, COUNT(id) AS gross_orders, {money('total_price')} AS gross_sales,
  {money('total_discounts')} AS total_discounts, {count_if(NET)} AS net_orders, {money_if(NET, 'total_price')} AS net_sales,
  {count_if("financial_status = 'paid'")} AS paid_count, {count_if("financial_status = 'pending'")} AS pending_count,
  {count_if("financial_status = 'refunded'")} AS refunded_count, {count_if("financial_status = 'partially_refunded'")} AS partially_refunded_count,
  {count_if("financial_status NOT IN ('paid', 'pending', 'refunded', 'partially_refunded')")} AS other_count
FROM shopify_orders GROUP BY 1"""


@query("sal_04_sales_daily", DAILY, ["sale_date"])
def _(t):
    """Ten measures per day."""
    return sales.sales_daily(t.shopify_orders)


COUNTS = ["paid_count", "pending_count", "refunded_count", "partially_refunded_count", "other_count"]
SUMMARY = f"""SELECT {money('net_sales')} AS net_sales, {money('gross_sales')} AS gross_sales, {money('total_discounts')} AS total_discounts,
  {total('net_orders')} AS net_orders, {total('gross_orders')} AS gross_orders, {', '.join(f'{total(c)} AS {c}' for c in COUNTS)} FROM d"""


@query("sal_05_sales_summary", f"""
WITH d AS ({DAILY}), s AS ({SUMMARY}) SELECT *, {div0('net_sales', 'net_orders')} AS aov, net_sales / {DAYS}e0 AS avg_daily_sales FROM s""")
def _(t):
    return sales.sales_summary(sales.sales_daily(t.shopify_orders), D0, D1)


@query("sal_05_summary_statuses", f"""
WITH d AS ({DAILY}), s AS ({SUMMARY}), r AS (SELECT 'Paid' AS name, paid_count AS value FROM s UNION ALL SELECT 'Pending', pending_count FROM s
  UNION ALL SELECT 'Refunded', refunded_count FROM s UNION ALL SELECT 'Partially Refunded', partially_refunded_count FROM s
  UNION ALL SELECT 'Other', other_count FROM s) SELECT * FROM r WHERE value > 0""")
def _(t):
    return sales.summary_statuses(sales.sales_summary(sales.sales_daily(t.shopify_orders), D0, D1))


def top_sql(k):
    return f"""SELECT L.product_id, L.title AS product_title, COALESCE(L.vendor, 'Desconocido') AS brand, {total('L.quantity')} AS quantity_sold,
  {money('L.price * L.quantity')} AS gross_revenue FROM {SOLD_LINES} GROUP BY L.product_id, L.title, L.vendor
  ORDER BY gross_revenue DESC, L.product_id, L.title, L.vendor NULLS FIRST LIMIT {k}"""


@query("sal_06_top_products", top_sql(5))
def _(t):
    return sales.top_products(t.shopify_order_lines, t.shopify_orders, D0, D1, 5)


@query("sal_06_top_products_100", top_sql(100))
def _(t):
    return sales.top_products(t.shopify_order_lines, t.shopify_orders, D0, D1, 100)


@query("sal_07_top_brands", f"""
SELECT COALESCE(L.vendor, 'Desconocido') AS brand, {total('L.quantity')} AS quantity_sold, {money('L.price * L.quantity')} AS gross_revenue
FROM {SOLD_LINES} GROUP BY L.vendor ORDER BY gross_revenue DESC, L.vendor NULLS FIRST LIMIT 20""")
def _(t):
    return sales.top_brands(t.shopify_order_lines, t.shopify_orders, D0, D1, 20)


@query("sal_08_top_products_seo", f"""
WITH top AS ({top_sql(100)}), g AS (SELECT regexp_extract(page, '/products/([^/?]+)', 1) AS handle, {wavg('position', 'impressions')} AS seo_position
  FROM gsc_metrics WHERE date BETWEEN DATE '{D0}' AND DATE '{D1}' GROUP BY 1)
SELECT top.*, P.handle, g.seo_position FROM top LEFT JOIN shopify_products P ON top.product_id = P.id LEFT JOIN g ON g.handle = P.handle""")
def _(t):
    return sales.top_products_seo(t.shopify_order_lines, t.shopify_orders, t.shopify_products, t.gsc_metrics, D0, D1)


@query("sal_09_shop_kpis", f"""
WITH s AS (SELECT {money_if("financial_status = 'paid'", 'total_price')} AS net_sales, COUNT(id) AS total_orders,
  {count_if("financial_status = 'paid'")} AS paid_orders, MAX(currency) AS currency FROM shopify_orders)
SELECT *, {div0('net_sales', 'paid_orders')} AS aov FROM s""")
def _(t):
    return sales.shop_kpis(t.shopify_orders)


@query("sal_10_open_orders", f"""
WITH o AS ({OPEN_LINES}) SELECT id, order_number, created_at, total_price, currency, estado_de_pedido, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  COUNT(*) AS line_count, string_agg(COALESCE(CAST(line_id AS VARCHAR), '-') || ':' || COALESCE(title, '-') || ':' || COALESCE(vendor, '-') || ':' || COALESCE(CAST(quantity AS VARCHAR), '-'),
    '|' ORDER BY line_id, title, quantity, price, vendor NULLS FIRST) AS lines
FROM o GROUP BY id, order_number, created_at, total_price, currency, estado_de_pedido""", ["created_at"])
def _(t):
    rows = sales.open_orders(t.shopify_orders, t.shopify_order_lines)
    dash = F.lit("-")
    shown = F.transform("lines", lambda l: F.concat_ws(
        ":", F.coalesce(l["line_id"].cast("string"), dash), F.coalesce(l["title"], dash), F.coalesce(l["vendor"], dash),
        F.coalesce(l["quantity"].cast("string"), dash)))
    return rows.withColumn("line_count", F.size("lines").cast("bigint")).withColumn("lines", F.array_join(shown, "|"))


@query("sal_11_scan_candidates", f"""
SELECT L.product_id, L.title, {total('L.quantity')} AS total_sold FROM shopify_orders o JOIN shopify_order_lines L ON o.id = L.order_id
WHERE o.financial_status IN ('paid', 'partially_paid') AND o.created_at >= TIMESTAMP '1998-05-01' - INTERVAL 30 DAY AND L.product_id IS NOT NULL
GROUP BY L.product_id, L.title ORDER BY total_sold DESC, L.product_id, L.title LIMIT 30""")
def _(t):
    return sales.scan_candidates(t.shopify_order_lines, t.shopify_orders, "1998-05-01")


@query("sal_12_overview_metrics", f"""
WITH s AS (SELECT {money_if(NET, 'total_price')} AS net, COUNT(id) AS n {ORDERS_IN}),
tr AS (SELECT {total('total_sessions')} AS sessions FROM shopify_traffic_daily WHERE date BETWEEN DATE '{D0}' AND DATE '{D1}'),
ord AS (SELECT COUNT(*) AS n FROM shopify_orders o WHERE o.{NET} AND CAST(o.created_at AS DATE) IN (SELECT date FROM shopify_traffic_daily)),
em AS (SELECT COALESCE({total('count')}, 0) AS n, COALESCE({money('sum_value')}, 0e0) AS v FROM klaviyo_metrics WHERE date >= TIMESTAMP '{D0}' AND date <= TIMESTAMP '{E1}' AND metric_name = 'Placed Order'),
su AS (SELECT COUNT(session_id) AS n, {count_if("status = 'resolved'")} AS r, {js('AVG(rating_value)', 1)} AS c FROM crisp_conversations WHERE created_at >= TIMESTAMP '{D0}' AND created_at <= TIMESTAMP '{E1}'),
rv AS (SELECT COUNT(*) AS n, {count_if("status = 'published'")} AS p, {count_if("status = 'published' AND score >= 4")} AS g, AVG(CASE WHEN status = 'published' THEN score END) AS a FROM raw_yotpo_reviews)
SELECT 'sales' AS domain, 'net_sales' AS metric, net AS value FROM s UNION ALL SELECT 'sales', 'total_orders', CAST(n AS DOUBLE) FROM s
UNION ALL SELECT 'traffic', 'total_sessions', CAST(sessions AS DOUBLE) FROM tr
UNION ALL SELECT 'traffic', 'avg_conversion_rate', {pct0('ord.n', 'sessions')} FROM tr, ord
UNION ALL SELECT 'email', 'total_orders', CAST(n AS DOUBLE) FROM em UNION ALL SELECT 'email', 'total_revenue', v FROM em
UNION ALL SELECT 'support', 'total_conversations', CAST(n AS DOUBLE) FROM su UNION ALL SELECT 'support', 'resolved_conversations', CAST(r AS DOUBLE) FROM su
UNION ALL SELECT 'support', 'avg_csat', c FROM su UNION ALL SELECT 'support', 'resolution_rate', {pct0('r', 'n')} FROM su
UNION ALL SELECT 'reviews', 'total_reviews', CAST(n AS DOUBLE) FROM rv UNION ALL SELECT 'reviews', 'average_rating', a FROM rv
UNION ALL SELECT 'reviews', 'sentiment_score', {js(pct0('g', 'p'))} FROM rv""")
def _(t):
    return overview.overview_metrics(t.shopify_orders, t.shopify_traffic_daily, t.klaviyo_metrics, t.crisp_conversations,
                                     t.raw_yotpo_reviews, D0, E1, D0, D1)


def overview_part(t, name):
    return overview.overview(t.shopify_orders, t.shopify_traffic_daily, t.klaviyo_metrics, t.crisp_conversations, t.raw_yotpo_reviews,
                             t.shopify_audit_log, t.shopify_staff, D0, D1)[name]


@query("sal_12_overview_sales_trend", f"SELECT CAST(created_at AS DATE) AS date, {money_if(NET, 'total_price')} AS net_sales {ORDERS_IN} GROUP BY 1", ["date"])
def _(t):
    return overview_part(t, "sales_trend")


@query("sal_12_overview_traffic_trend", f"""
SELECT t.date, t.total_sessions, t.unique_visitors, (SELECT COUNT(*) FROM shopify_orders o WHERE o.{NET} AND CAST(o.created_at AS DATE) = t.date) AS orders
FROM shopify_traffic_daily t WHERE t.date BETWEEN DATE '{D0}' AND DATE '{D1}'""", ["date"])
def _(t):
    return overview_part(t, "traffic_trend")


@query("sal_12_overview_top_staff", """
SELECT concat(COALESCE(s.first_name, ''), ' ', COALESCE(s.last_name, '')) AS name, COUNT(*) AS total
FROM shopify_audit_log a LEFT JOIN shopify_staff s ON a.staff_id = s.staff_id WHERE a.staff_id IS NOT NULL
GROUP BY 1 ORDER BY total DESC, name LIMIT 5""")
def _(t):
    return team.staff_totals(team.activity_daily(t.shopify_audit_log, t.shopify_staff, E0, E1), 5)


@query("sal_13_status_matrix", """
SELECT financial_status, fulfillment_status, COUNT(*) AS count FROM shopify_orders
WHERE estado_de_pedido LIKE '0. %' OR estado_de_pedido LIKE '1. %' OR estado_de_pedido LIKE '2. %' GROUP BY 1, 2""")
def _(t):
    return sales.status_matrix(t.shopify_orders)


@query("sal_14_line_product_probe", """
SELECT L.product_id, L.title, P.id AS joined_id, P.handle FROM shopify_order_lines L LEFT JOIN shopify_products P ON L.product_id = P.id
WHERE L.title LIKE '%red ring%' OR L.title LIKE '%blue bolt%'""")
def _(t):
    return sales.line_product_probe(t.shopify_order_lines, t.shopify_products, ["red ring", "blue bolt"])


@query("cus_01_customer_kpis", f"""
SELECT COUNT(id) AS total_customers, {money('total_spent')} AS global_revenue, {safe(money('total_spent'), 'COUNT(total_spent)')} AS global_ltv,
AVG(orders_count) AS global_recurrence FROM shopify_customers WHERE orders_count > 0""")
def _(t):
    return sales.customer_kpis(t.shopify_customers)


@query("cus_02_customer_geo", f"""
SELECT city, province, COUNT(id) AS total_customers, {money('total_spent')} AS total_revenue, {safe(money('total_spent'), 'COUNT(total_spent)')} AS avg_ltv,
AVG(orders_count) AS avg_orders FROM shopify_customers WHERE country = 'NATION_7' AND city IS NOT NULL AND city <> '' AND orders_count > 0
GROUP BY city, province ORDER BY total_customers DESC, city, province NULLS FIRST LIMIT 20""")
def _(t):
    return sales.customer_geo(t.shopify_customers, "NATION_7")



