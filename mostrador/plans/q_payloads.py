"""Payload flattening: payloads built from the tables must flatten back to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import payloads as pl
from . import landed
from .registry import query


@query("nrm_01_orders", """
SELECT id, order_number, created_at, updated_at, total_price, subtotal_price, total_discounts, COALESCE(financial_status, 'unknown') AS financial_status,
  COALESCE(fulfillment_status, 'unfulfilled') AS fulfillment_status, currency, estado_de_pedido FROM shopify_orders""", ["created_at", "updated_at"])
def _(t):
    return pl.flatten_orders(pl.parse(landed.orders(t), "payload", "order"), landed.order_notes(t))


LINE = "order_id, product_id, variant_id, title, vendor, quantity, price FROM shopify_order_lines"


@query("nrm_02_order_lines", f"SELECT id, {LINE} UNION ALL SELECT -id, {LINE}")
def _(t):
    return pl.flatten_order_lines(pl.parse(landed.order_lines(t), "payload", "order"))


@query("nrm_03_products", """
SELECT id, title, CASE WHEN id % 3 <> 0 THEN vendor END AS vendor, product_type, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE status END AS status, handle, created_at FROM shopify_products""", ["created_at"])
def _(t):
    return pl.flatten_products(pl.parse(landed.products(t), "payload", "product")).drop("updated_at", "published_at")


@query("nrm_03_variants", """
SELECT id, product_id, title, price, sku, inventory_quantity FROM shopify_product_variants WHERE product_id % 10 <> 0
UNION ALL SELECT -id, product_id, title, 0e0, NULL, 0 FROM shopify_product_variants WHERE product_id % 10 <> 0""")
def _(t):
    return pl.flatten_variants(pl.parse(landed.variants(t), "payload", "product")).drop("created_at", "updated_at")


@query("nrm_04_customers", """
SELECT id, TIMESTAMP '2024-01-01 00:00:00' AS created_at, CASE WHEN id % 2 = 0 THEN 'ENABLED' ELSE 'UNKNOWN' END AS state, CASE WHEN id % 7 <> 0 THEN NULLIF(city, '') END AS city,
  CASE WHEN id % 7 <> 0 THEN province END AS province, CASE WHEN id % 7 <> 0 THEN country END AS country, orders_count, total_spent,
  CASE WHEN orders_count > 0 AND id % 3 = 0 THEN 'USD' ELSE 'CLP' END AS currency FROM shopify_customers""", ["created_at"])
def _(t):
    return pl.flatten_customers(pl.parse(landed.customers(t), "payload", "customer")).drop("updated_at", "zip")


@query("nrm_05_conversations", """
SELECT session_id, date_trunc('millisecond', created_at) AS created_at, date_trunc('millisecond', updated_at) AS updated_at, status, concat('web,', visitor_nickname) AS segments, rating_value,
  CASE WHEN rating_value IS NOT NULL THEN 'ok' END AS rating_comment, people_id, channel_origin, visitor_nickname, NULLIF(visitor_email, '') AS visitor_email, NULLIF(visitor_phone, '') AS visitor_phone
FROM crisp_conversations""", ["created_at", "updated_at"])
def _(t):
    return pl.flatten_conversations(pl.parse(landed.conversations(t), "payload", "conversation"))


@query("nrm_06_channels", """
SELECT session_id, CASE WHEN conv % 5 = 0 THEN NULL WHEN conv % 5 = 1 THEN channel_origin WHEN conv % 5 = 2 THEN channel_origin WHEN conv % 5 = 3 THEN 'urn:other' ELSE 'crisp' END AS channel
FROM (SELECT *, length(content) AS conv, sender_type AS channel_origin FROM crisp_messages) m""")
def _(t):
    n = F.length("content") % 5
    raw = (F.when(n == 0, "").when(n == 1, F.concat(F.lit("urn:crisp.im:"), "sender_type", F.lit(":0")))
           .when(n == 2, F.col("sender_type")).when(n == 3, "urn:other").otherwise("crisp"))
    return t.crisp_messages.select("session_id", tx.normalize_channel(raw).alias("channel"))


@query("nrm_07_messages", """
SELECT message_id, session_id, date_trunc('millisecond', created_at) AS created_at, sender_type, operator_name, content FROM crisp_messages WHERE sender_type <> 'system'""", ["created_at"])
def _(t):
    return pl.flatten_messages(pl.parse(landed.messages(t), "payload", "message"))


@query("nrm_08_audit", """
SELECT split_part(split_part(id, '?', 1), '/', 5) AS audit_id, date_trunc('second', created_at) AS occurred_at, split_part(author_id, '/', 5) AS staff_id, CAST(NULL AS VARCHAR) AS staff_email, action,
  COALESCE(subject_type, nested_type, 'N/A') AS subject_type, COALESCE(split_part(subject_id, '/', 5), split_part(nested_id, '/', 5), 'N/A') AS subject_id, id AS payload_id
FROM audit_raw WHERE to_user""", ["occurred_at"])
def _(t):
    flat = pl.flatten_audit(pl.parse(landed.audit(t), "payload", "audit"))
    return flat.withColumn("payload_id", F.get_json_object("raw_payload", "$.id")).drop("raw_payload")


@query("nrm_09_resource_ids", "SELECT id, split_part(split_part(id, '?', 1), '/', 5) AS clean, split_part(author_id, '/', 5) AS author FROM audit_raw")
def _(t):
    return t.audit_raw.select("id", tx.clean_gid("id").alias("clean"), tx.staff_gid("author_id").alias("author"))


@query("nrm_10_ga4", """
SELECT date, session_default_channel_group, session_source_medium, campaign_name, sessions, total_users, new_users, engagement_rate, average_session_duration, conversions, ecommerce_purchases,
  purchase_revenue, CAST(0 AS BIGINT) AS add_to_carts FROM raw_traffic_ga4""", ["date"])
def _(t):
    return pl.flatten_ga4(pl.parse(landed.ga4(t), "payload", "ga4"))


@query("nrm_11_gsc", """
SELECT md5(concat(CAST(date AS VARCHAR), '-', property, '-', page, '-', query)) AS id, date, property, page, query, clicks, impressions, ctr, position FROM gsc_metrics""", ["date"])
def _(t):
    return pl.flatten_gsc(pl.parse(landed.gsc(t), "payload", "gsc"))


SOURCE = "metric_name, CASE WHEN campaign_name = '' THEN '' ELSE concat('m', campaign_name) END AS message_id, CASE WHEN flow_name = '' THEN '' ELSE concat('f', flow_name) END AS flow_id"


@query("nrm_12_metric_series", f"""
SELECT date, {SOURCE}, count, sum_value FROM klaviyo_metrics WHERE count > 0 OR sum_value > 0
UNION ALL SELECT TIMESTAMP '2024-02-02', {SOURCE}, 1, 0e0 FROM klaviyo_metrics""", ["date"])
def _(t):
    return pl.flatten_metric_series(pl.parse(landed.metric_series(t), "payload", "metric_series"))


@query("nrm_13_reviews", """
SELECT review_id, product_id, score, votes_up, votes_down, CASE WHEN score > 2 THEN 'good' ELSE '' END AS content, '' AS title, date_trunc('second', created_at) AS created_at, verified_buyer, status
FROM raw_yotpo_reviews""", ["created_at"])
def _(t):
    return pl.flatten_reviews(pl.parse(landed.reviews(t), "payload", "review"))


@query("nrm_14_trends", """
SELECT keyword, make_date(CAST(year(trend_date + 6) AS INT), CAST(month(trend_date) AS INT), CAST(day(trend_date) AS INT)) AS trend_date, interest_value, FALSE AS is_partial FROM market_trends""", ["trend_date"])
def _(t):
    return pl.flatten_trend(pl.parse(landed.trends(t), "payload", "trend"))


@query("nrm_14_trends_alt", "SELECT keyword, trend_date, interest_value, FALSE AS is_partial FROM market_trends", ["trend_date"])
def _(t):
    return pl.flatten_trend_alt(pl.parse(landed.trends_alt(t), "payload", "trend_alt"))


LISTED = f"""listed AS (SELECT product_id, competitor_name, competitor_price, has_stock, i, [{', '.join(landed.STORES)}][(product_id + i) % {len(landed.STORES)} + 1] AS source
  FROM competitor_prices, (SELECT unnest(range({len(landed.STORES)})) AS i) x)"""
KEYWORD = "concat('kw ', CAST(product_id AS VARCHAR)) AS keyword"


# The comma is not a digit or dot, so '$12,50' reads as 1250.
@query("nrm_15_listings", f"""
WITH {LISTED} SELECT {KEYWORD}, product_id, i + 1 AS rank, concat('Offer of ', source) AS competitor_title, (competitor_price + i) * 100 + 50 AS competitor_price, source AS competitor_name, has_stock
FROM listed WHERE source <> ''""")
def _(t):
    return pl.flatten_listings(pl.parse(landed.listings(t), "payload", "listings")).drop("competitor_url", "thumbnail_url")


def listed_at(i):
    return f"[{', '.join(landed.STORES)}][(product_id + {i}) % {len(landed.STORES)} + 1]"


FIRST_OTHER = "list_position(list_transform(sources, lambda x: contains(lower(x), 'mi tienda')), FALSE)"


@query("nrm_16_shelf_position", f"""
WITH l AS (SELECT product_id, competitor_price, [{', '.join(listed_at(i) for i in range(len(landed.STORES)))}] AS sources FROM competitor_prices),
p AS (SELECT *, list_position(list_transform(sources, lambda x: contains(lower(x), 'mi tienda')), TRUE) AS organic,
  list_position(list_transform([sources[3], sources[2], sources[1]], lambda x: contains(lower(x), 'mi tienda')), TRUE) AS paid, {FIRST_OTHER} AS other FROM l)
SELECT {KEYWORD}, product_id, NULLIF(organic, 0) AS organic_position, NULLIF(paid, 0) AS paid_position, sources[other] AS top_competitor_name, competitor_price + other - 1 + 0.5e0 AS top_competitor_price FROM p""")
def _(t):
    return pl.shelf_position(pl.parse(landed.listings(t), "payload", "listings"), "Mi Tienda")


@query("nrm_17_status_notes", "SELECT id, estado_de_pedido AS note FROM shopify_orders")
def _(t):
    return landed.order_notes(t).select("id", tx.parse_note("value").alias("note"))


@query("nrm_18_volumes", """
SELECT keyword, avg_monthly_searches, CASE WHEN length(keyword) % 2 = 0 THEN last_month_searches ELSE 0 END AS last_month_searches FROM keyword_volumes""")
def _(t):
    return pl.flatten_volumes(pl.parse(landed.volumes(t), "payload", "volumes"))


@query("nrm_19_staff", """
SELECT CASE WHEN staff_id LIKE 'x%' THEN concat('gid://shop/StaffMember/', staff_id) ELSE staff_id END AS staff_id, email, first_name, last_name,
  CASE WHEN first_name IS NOT NULL THEN concat(lower(first_name), '.', lower(last_name)) ELSE split_part(email, '@', 1) END AS employee_code, active FROM shopify_staff""")
def _(t):
    return pl.flatten_staff(pl.parse(landed.staff(t), "payload", "staff"))


@query("nrm_20_variant_titles", """
SELECT v.id, CASE WHEN v.title = 'Default Title' THEN p.title ELSE concat(p.title, ' - ', v.title) END AS title, v.price FROM shopify_products p JOIN shopify_product_variants v ON v.product_id = p.id""")
def _(t):
    return pl.variant_titles(t.shopify_products, t.shopify_product_variants)


@query("nrm_21_fenced_json", """
SELECT id, concat(producto, '!') AS producto, marca FROM launches WHERE id % 4 <> 3""")
def _(t):
    body = F.to_json(F.array(F.struct(F.concat("producto", F.lit("!")).alias("producto"), "marca")))
    kind = F.col("id") % 4
    reply = (F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(kind == 1, F.concat(F.lit("  ```\n"), body, F.lit("```")))
             .when(kind == 2, body).otherwise(F.concat(F.lit("Sorry: "), body)))
    return pl.fenced_rows(t.launches.select("id", reply.alias("reply")), "reply", "producto string, marca string")


@query("nrm_22_html_body", r"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN
  regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') ELSE html END AS content FROM pages""")
def _(t):
    return t.base("pages").select("page_id", tx.html_body("html").alias("content"))


@query("nrm_23_calls", """
SELECT session_id, extension_id, extension_name, extension_id AS ext_pos, direction, result, duration, date_trunc('second', start_time) AS start_time FROM call_log WHERE extension_id <> 6""", ["start_time"])
def _(t):
    return pl.flatten_calls(pl.parse(landed.calls(t), "payload", "calls")).drop("seq")
