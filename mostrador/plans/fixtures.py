"""The shop's tables as views over the landed base tables.

Every view is one statement that Spark and an ANSI engine both run over the whole base
tables. They stand in for the tables the loaders of ``sources`` would fill.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..sources import schemas
from ..sources.tables import load

VIEWS: dict[str, str] = {
    "shopify_orders": """
SELECT o_orderkey AS id, o_orderkey + 1000 AS order_number, o_custkey AS customer_id,
  o_orderdate AS created_at, o_orderdate AS updated_at, o_totalprice AS total_price, o_totalprice AS subtotal_price,
  CAST(o_orderkey % 10 AS DOUBLE) AS total_discounts,
  CASE WHEN o_orderkey % 10 < 5 THEN 'paid' WHEN o_orderkey % 10 = 5 THEN 'pending' WHEN o_orderkey % 10 = 6 THEN 'refunded'
       WHEN o_orderkey % 10 = 7 THEN 'partially_refunded' WHEN o_orderkey % 10 = 8 THEN 'partially_paid' ELSE NULL END AS financial_status,
  CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'P' THEN 'partial' ELSE NULL END AS fulfillment_status,
  'CLP' AS currency, concat(CAST(o_orderkey % 8 AS STRING), '. ', o_orderpriority) AS estado_de_pedido FROM orders""",
    "shopify_order_lines": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS product_id,
  l_partkey * 1000 + l_suppkey AS variant_id, p_name AS title,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'Desconocido' ELSE p_brand END AS vendor,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "shopify_products": """
SELECT p_partkey AS id, p_name AS title, p_brand AS vendor, p_type AS product_type,
  CASE WHEN p_size % 5 = 0 THEN 'draft' ELSE 'active' END AS status,
  concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS handle,
  CAST(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INT) AS TIMESTAMP) AS created_at FROM part""",
    "shopify_product_variants": """
SELECT l_partkey * 1000 + l_suppkey AS id, l_partkey AS product_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Default Title' ELSE concat('V', CAST(l_suppkey AS STRING)) END AS title,
  CAST(MAX(CAST(FLOOR(l_extendedprice) AS BIGINT) % 1000) AS DOUBLE) AS price, concat('SKU-', CAST(l_partkey AS STRING)) AS sku,
  CAST(SUM(CAST(l_quantity AS BIGINT)) % 100 AS BIGINT) AS inventory_quantity FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "shopify_customers": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN NULL ELSE concat('City ', CAST(c_custkey % 30 AS STRING)) END AS city,
  c_mktsegment AS province, n_name AS country, COALESCE(n, 0) AS orders_count, COALESCE(s, 0.0) AS total_spent
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey AS k, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY o_custkey) x ON c_custkey = k""",
    "shopify_traffic_daily": """
SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) * 50 AS total_sessions, COUNT(DISTINCT l_partkey) * 40 AS unique_visitors,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pageviews, CAST(40 + COUNT(*) % 20 AS DOUBLE) AS bounce_rate FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""",
    "raw_traffic_ga4": """
SELECT CAST(ts AS DATE) AS date, CASE event_type WHEN 'click' THEN 'Email' WHEN 'view' THEN 'Organic Search' WHEN 'error' THEN NULL ELSE event_type END AS session_default_channel_group,
  concat('src', CAST(user_id % 20 AS STRING), ' / ', event_type) AS session_source_medium, concat('camp', CAST(user_id % 3 AS STRING)) AS campaign_name,
  COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS total_users, COUNT(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS new_users,
  CAST(COUNT(*) % 7 AS DOUBLE) / 8 AS engagement_rate, CAST(COUNT(*) % 5 AS DOUBLE) * 30 AS average_session_duration,
  CAST(SUM(CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END) AS BIGINT) AS conversions, CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS ecommerce_purchases,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS purchase_revenue,
  CAST(SUM(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END) AS BIGINT) AS add_to_carts FROM events
  GROUP BY CAST(ts AS DATE), event_type, user_id % 20, user_id % 3""",
    "gsc_metrics": """
SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_suppkey % 2 = 0 THEN 'site-a' ELSE 'site-b' END AS property,
  concat('https://shop.example/products/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '?variant=1' WHEN 2 THEN '/reviews' ELSE '-pro' END) AS page,
  concat(p_name, ' ', p_type) AS query, CAST(l_linenumber AS BIGINT) AS clicks, CAST(CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 10 END AS BIGINT) AS impressions,
  CAST(CASE WHEN l_quantity < 3 THEN 0.0 ELSE l_linenumber / (l_quantity * 10) END AS DOUBLE) AS ctr, CAST(1 + l_suppkey % 40 AS DOUBLE) AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "klaviyo_metrics": """
SELECT date_trunc('day', ts) AS date, CASE event_type WHEN 'click' THEN 'Clicked Email' WHEN 'view' THEN 'Opened Email' WHEN 'signup' THEN 'Received Email' WHEN 'purchase' THEN 'Placed Order' ELSE 'Bounced Email' END AS metric_name,
  CASE WHEN user_id % 3 = 0 THEN concat('Campaign ', CAST(user_id % 7 AS STRING)) ELSE '' END AS campaign_name, CASE WHEN user_id % 3 = 1 THEN concat('Flow ', CAST(user_id % 5 AS STRING)) ELSE '' END AS flow_name,
  COUNT(*) AS count, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum_value FROM events
  GROUP BY date_trunc('day', ts), event_type, CASE WHEN user_id % 3 = 0 THEN concat('Campaign ', CAST(user_id % 7 AS STRING)) ELSE '' END, CASE WHEN user_id % 3 = 1 THEN concat('Flow ', CAST(user_id % 5 AS STRING)) ELSE '' END""",
    "raw_yotpo_reviews": """
SELECT event_id AS review_id, concat('SKU-', CAST(user_id AS STRING)) AS product_id, 1 + CAST(FLOOR(value) AS BIGINT) % 5 AS score, user_id % 4 AS votes_up, user_id % 3 AS votes_down,
  ts AS created_at, user_id % 2 = 0 AS verified_buyer, CASE WHEN event_type = 'error' THEN 'pending' ELSE 'published' END AS status FROM events""",
    "crisp_messages": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS message_id, concat('session_', lpad(CAST(conv_id AS STRING), 8, '0')) AS session_id, ts AS created_at,
  CASE role WHEN 'assistant' THEN 'operator' ELSE role END AS sender_type, CASE WHEN role = 'assistant' THEN concat('op', CAST(conv_id % 4 AS STRING)) END AS operator_name, text AS content,
  CASE WHEN role = 'user' AND length(text) > 30 THEN CAST(length(text) % 21 - 10 AS DOUBLE) / 10 END AS sentiment_score
  FROM conversations JOIN events ON event_id = conv_id * 50 + turn * 3""",
    "crisp_conversations": """
SELECT concat('session_', lpad(CAST(conv_id AS STRING), 8, '0')) AS session_id, MIN(ts) AS created_at, MAX(ts) AS updated_at,
  CASE conv_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'pending' ELSE 'unresolved' END AS status, CASE WHEN conv_id % 3 = 0 THEN 1 + conv_id % 5 END AS rating_value,
  CASE WHEN conv_id % 5 < 2 THEN concat('p', CAST(CAST(FLOOR(conv_id / 10) AS BIGINT) AS STRING)) END AS people_id,
  CASE WHEN conv_id % 11 = 10 THEN NULL WHEN conv_id % 3 = 0 THEN 'chat' WHEN conv_id % 3 = 1 THEN 'whatsapp' ELSE 'email' END AS channel_origin,
  concat('nick', CAST(conv_id % 10 AS STRING)) AS visitor_nickname, CASE WHEN conv_id % 7 = 0 THEN 'user@example.com' WHEN conv_id % 7 = 1 THEN '' ELSE concat('v', CAST(CAST(FLOOR(conv_id / 6) AS BIGINT) AS STRING), '@x.test') END AS visitor_email,
  CASE WHEN conv_id % 2 = 0 THEN concat('+56', CAST(CAST(FLOOR(conv_id / 4) AS BIGINT) AS STRING)) ELSE '' END AS visitor_phone,
  CASE WHEN conv_id % 6 = 0 THEN FALSE WHEN conv_id % 6 = 1 THEN NULL ELSE TRUE END AS messages_synced
  FROM conversations JOIN events ON event_id = conv_id * 50 + turn * 3 GROUP BY conv_id""",
    "shopify_staff": """
SELECT concat(CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END, CAST(c_custkey AS STRING)) AS staff_id, c_custkey AS list_pos, concat('u', CAST(c_custkey AS STRING), '@shop.test') AS email,
  CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE c_mktsegment END AS first_name,
  concat('N', CAST(c_custkey AS STRING)) AS last_name, concat('emp.', CAST(c_custkey AS STRING)) AS employee_code, c_custkey % 8 <> 0 AS active FROM customer""",
    "shopify_audit_log": """
SELECT CAST(event_id AS STRING) AS audit_id, ts AS occurred_at, CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS staff_id, concat('raw', CAST(user_id AS STRING), '@shop.test') AS staff_email,
  event_type AS action, CASE event_id % 4 WHEN 0 THEN 'Product' WHEN 1 THEN 'Order' WHEN 2 THEN 'Collection' ELSE 'Page' END AS subject_type, CAST(event_id % 500 AS STRING) AS subject_id, props AS raw_payload FROM events""",
    "staff_assignments": """
SELECT concat(CAST(c_custkey AS STRING), '-', CAST(v AS STRING)) AS assignment_id, concat(CASE WHEN c_custkey % 6 = 0 THEN 'ext.' ELSE 'emp.' END, CAST(c_custkey AS STRING)) AS employee_code,
  CASE (c_custkey + v) % 3 WHEN 0 THEN 'operations' WHEN 1 THEN 'management' ELSE 'executive' END AS team, concat('role', CAST(v AS STRING)) AS role, CAST(CASE v WHEN 3 THEN 20 ELSE 100 END AS BIGINT) AS allocation_pct,
  CASE v WHEN 1 THEN DATE '2024-01-05' WHEN 2 THEN DATE '2024-01-16' ELSE DATE '2024-01-10' END AS valid_from, CASE v WHEN 1 THEN DATE '2024-01-15' END AS valid_to, v < 3 AS is_primary
  FROM (SELECT c_custkey, explode(ARRAY(1, 2, 3)) AS v FROM customer) x""",
    "activity_log": """
SELECT CAST(event_id AS STRING) AS activity_id, ts AS occurred_at, CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('emp.', CAST(user_id AS STRING)) END AS employee_code, event_type AS activity_type, 'product' AS resource_type, CAST(event_id % 500 AS STRING) AS resource_id FROM events""",
    "market_trends": """
SELECT p_brand AS keyword, 'brand' AS keyword_type, 'CL' AS geo, CAST(date_trunc('week', l_shipdate) AS DATE) AS trend_date, CAST(SUM(CAST(l_quantity AS BIGINT)) % 101 AS BIGINT) AS interest_value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    "competitor_prices": """
SELECT l_partkey AS product_id, CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS DOUBLE) AS our_price, s_name AS competitor_name, CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 2000 AS DOUBLE) AS competitor_price, l_suppkey % 9 <> 0 AS has_stock, l_shipdate AS synced_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "shopping_position": """
SELECT p_name AS keyword, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS scan_date, MIN(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 1 + l_suppkey % 20 END) AS organic_position,
  MIN(CASE WHEN l_suppkey % 3 = 0 THEN 1 + l_suppkey % 5 END) AS paid_position, MIN(concat('Supplier ', CAST(l_suppkey AS STRING))) AS top_competitor_name, l_shipdate AS scraped_at
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, l_partkey, l_shipdate""",
    "ads_campaign_daily": """
SELECT l_suppkey AS campaign_id, concat('Campaign ', CAST(l_suppkey AS STRING)) AS campaign_name, CASE WHEN l_suppkey % 10 = 0 THEN 'REMOVED' WHEN l_suppkey % 2 = 0 THEN 'ENABLED' ELSE 'PAUSED' END AS status,
  CAST(l_shipdate AS DATE) AS date, CAST(SUM(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS impressions, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks, CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT) * 1000) AS BIGINT) AS cost_micros
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "ads_conversions": """
SELECT l_suppkey AS campaign_id, CAST(l_shipdate AS DATE) + 1 AS date, concat('Google Ads || ', l_returnflag, ' || x') AS action_name, CASE l_linestatus WHEN 'F' THEN 'PURCHASE' ELSE 'SIGNUP' END AS category,
  CAST(COUNT(*) AS DOUBLE) AS conversions, CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT)) AS DOUBLE) AS conversions_value FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE) + 1, l_returnflag, l_linestatus""",
    "call_log": """
SELECT CAST(FLOOR(event_id / 2) AS BIGINT) AS session_id, user_id % 8 AS extension_id, CASE WHEN user_id % 8 = 7 THEN NULL ELSE concat('Ext ', CAST(user_id % 8 AS STRING)) END AS extension_name, event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'Outbound' ELSE 'Inbound' END AS direction, CASE event_type WHEN 'error' THEN 'Missed' WHEN 'signup' THEN 'Voicemail' ELSE 'Call connected' END AS result, CAST(FLOOR(value) AS BIGINT) * 10 AS duration, ts AS start_time FROM events""",
    "launches": """
SELECT p_partkey AS id, concat(p_name, ' mk', CAST(p_size AS STRING)) AS producto, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown Co' ELSE p_brand END AS marca, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS categoria,
  DATE '2024-01-01' + CAST(p_partkey % 4 AS INT) AS scan_day, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '2024-03-01' + CAST(p_size AS INT) END AS fecha_lanzamiento FROM part""",
    "commercial_calendar": """
SELECT concat('Event ', CAST(event_id AS STRING)) AS event_name, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(event_id % 300 AS INT) END AS event_date FROM events""",
    "keyword_volumes": """
SELECT p_name AS keyword, CAST(COUNT(*) * 10 AS BIGINT) AS avg_monthly_searches, CAST(SUM(CAST(p_size AS BIGINT)) AS BIGINT) AS last_month_searches FROM part GROUP BY p_name
  UNION ALL SELECT split_part(p_name, ' ', 2) AS keyword, CAST(COUNT(*) * 7 AS BIGINT) AS avg_monthly_searches, CAST(SUM(CAST(p_size AS BIGINT)) AS BIGINT) AS last_month_searches FROM part GROUP BY split_part(p_name, ' ', 2)""",
    "audit_raw": """
SELECT concat('gid://shop/BasicEvent/', CAST(event_id AS STRING), CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN concat('?staff_member_id=', CAST(user_id AS STRING)) WHEN event_id % 9 = 0 THEN '?v=2' ELSE '' END) AS id,
  ts AS created_at, event_type AS action,
  CASE event_id % 6 WHEN 0 THEN concat('<a href="/users/7">', c_mktsegment, ' N', CAST(user_id AS STRING), '</a> updated <b>product</b> ', CAST(event_id AS STRING))
       WHEN 1 THEN concat('N', CAST(user_id AS STRING), ', ', c_mktsegment, ' changed the order')
       WHEN 2 THEN concat('Order edited: <a class="u">N', CAST(user_id AS STRING), ' - ', c_mktsegment, '</a>')
       WHEN 3 THEN concat('<a>', c_mktsegment, '</a> added a note to <a>order ', CAST(event_id AS STRING), '</a>')
       WHEN 4 THEN 'A nightly job finished' END AS message,
  CASE WHEN user_id % 10 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Flow App' ELSE '' END END AS app_title,
  user_id % 10 = 0 AND event_id % 4 <> 0 AS to_app, user_id % 10 <> 0 AS to_user,
  CASE event_id % 4 WHEN 0 THEN 'Product' WHEN 1 THEN 'Order' END AS subject_type,
  CASE event_id % 4 WHEN 0 THEN concat('gid://shop/Product/', CAST(event_id % 500 AS STRING)) WHEN 1 THEN concat('gid://shop/Order/', CAST(event_id % 500 AS STRING)) END AS subject_id,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat('gid://shop/StaffMember/', CAST(user_id AS STRING)) END AS author_id,
  CASE WHEN event_id % 4 = 2 THEN 'Customer' END AS nested_type, CASE WHEN event_id % 4 = 2 THEN concat('gid://shop/Customer/', CAST(event_id % 70 AS STRING)) END AS nested_id
  FROM events JOIN customer ON user_id = c_custkey""",
}

# The ANSI engine unnests arrays with its own function.
_SPARK_ONLY = ("explode(ARRAY(1, 2, 3))", "unnest([1, 2, 3])")
_SPARK_VIEWS = dict(VIEWS)
VIEWS["staff_assignments"] = VIEWS["staff_assignments"].replace(*_SPARK_ONLY)


class Tables:
    """Base tables by ``base(name)``, shop tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, table: str) -> DataFrame:
        return load(self.spark, self.sf_dir, table)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _SPARK_VIEWS:
            raise AttributeError(name)
        used: dict[str, DataFrame] = {}

        def bind(m: re.Match) -> str:
            if m.group(2) not in schemas.BASE:
                return m.group(0)
            used[m.group(2)] = self.base(m.group(2))
            return f"{m.group(1)} {{{m.group(2)}}}"

        sql = re.sub(r"\b(FROM|JOIN) (\w+)", bind, _SPARK_VIEWS[name])
        df = self.spark.sql(sql, **used)
        # Wall-clock columns stay free of any zone.
        zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
        return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns])
