"""Declared schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Landed base tables.
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Shop tables: the columns the operators read and write.
SHOP = {
    "shopify_orders": (
        "id bigint, order_number bigint, customer_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "total_price double, subtotal_price double, total_discounts double, financial_status string, "
        "fulfillment_status string, currency string, estado_de_pedido string"
    ),
    "shopify_order_lines": (
        "id bigint, order_id bigint, product_id bigint, variant_id bigint, title string, vendor string, "
        "quantity bigint, price double"
    ),
    "shopify_products": (
        "id bigint, title string, vendor string, product_type string, status string, handle string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, published_at timestamp_ntz"
    ),
    "shopify_product_variants": (
        "id bigint, product_id bigint, title string, price double, sku string, inventory_quantity bigint, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "shopify_customers": (
        "id bigint, created_at timestamp_ntz, updated_at timestamp_ntz, state string, city string, "
        "province string, country string, zip string, orders_count bigint, total_spent double, currency string"
    ),
    "shopify_traffic_daily": (
        "date date, total_sessions bigint, unique_visitors bigint, pageviews bigint, bounce_rate double"
    ),
    "raw_traffic_ga4": (
        "date date, session_default_channel_group string, session_source_medium string, campaign_name string, "
        "sessions bigint, total_users bigint, new_users bigint, engagement_rate double, "
        "average_session_duration double, conversions bigint, ecommerce_purchases bigint, "
        "purchase_revenue double, add_to_carts bigint"
    ),
    "gsc_metrics": (
        "id string, date date, property string, page string, query string, clicks bigint, "
        "impressions bigint, ctr double, position double"
    ),
    "klaviyo_metrics": (
        "date timestamp_ntz, metric_name string, campaign_name string, flow_name string, count bigint, sum_value double"
    ),
    "raw_yotpo_reviews": (
        "review_id bigint, product_id string, score bigint, votes_up bigint, votes_down bigint, content string, "
        "title string, created_at timestamp_ntz, verified_buyer boolean, status string"
    ),
    "crisp_conversations": (
        "session_id string, created_at timestamp_ntz, updated_at timestamp_ntz, status string, segments string, "
        "rating_value bigint, rating_comment string, people_id string, channel_origin string, "
        "visitor_nickname string, visitor_email string, visitor_phone string, messages_synced boolean"
    ),
    "crisp_messages": (
        "message_id string, session_id string, created_at timestamp_ntz, sender_type string, operator_name string, "
        "content string, sentiment_score double, sentiment_magnitude double"
    ),
    "shopify_audit_log": (
        "audit_id string, occurred_at timestamp_ntz, staff_id string, staff_email string, action string, "
        "subject_type string, subject_id string, ip_address string, user_agent string, raw_payload string, "
        "ingested_at timestamp_ntz"
    ),
    "shopify_staff": (
        "staff_id string, email string, first_name string, last_name string, employee_code string, active boolean, "
        "joined_at date, left_at date, updated_at timestamp_ntz"
    ),
    "staff_assignments": (
        "assignment_id string, employee_code string, team string, role string, allocation_pct bigint, "
        "valid_from date, valid_to date, is_primary boolean, notes string, created_at timestamp_ntz, created_by string"
    ),
    "activity_log": (
        "activity_id string, occurred_at timestamp_ntz, employee_code string, activity_type string, "
        "resource_type string, resource_id string, resource_handle string, resource_title string, "
        "fields_changed array<string>, source string, confidence double, metadata string"
    ),
    "shopify_snapshots": (
        "snapshot_date date, resource string, resource_id string, payload string, tags array<string>"
    ),
    "competitor_prices": (
        "record_id string, product_id bigint, product_title string, vendor string, keyword_searched string, "
        "our_price double, competitor_name string, competitor_title string, competitor_price double, "
        "has_stock boolean, competitor_url string, thumbnail_url string, price_diff_amount double, "
        "price_diff_pct double, is_competitive boolean, data_source string, synced_at timestamp_ntz"
    ),
    "market_trends": (
        "record_id string, keyword string, keyword_type string, geo string, trend_date date, interest_value bigint, "
        "is_partial boolean, signal string, signal_detail string, vendor_products bigint, avg_stock double, "
        "data_source string, synced_at timestamp_ntz"
    ),
    "market_size_metrics": (
        "product_id bigint, product_title string, vendor string, keyword string, avg_price double, "
        "avg_monthly_searches bigint, last_month_searches bigint, avg_potential_buyers double, "
        "last_month_buyers double, market_size_avg double, market_size_last double, market_share_avg double, "
        "market_share_last double, synced_at timestamp_ntz"
    ),
    "shopping_position": (
        "keyword string, product_id bigint, scan_date date, scan_hour bigint, organic_position bigint, "
        "paid_position bigint, top_competitor_name string, top_competitor_price double, scraped_at timestamp_ntz"
    ),
    "market_intelligence_launches": (
        "id string, producto string, marca string, categoria string, especificaciones_clave string, fuente string, "
        "estado_db string, fecha_escaneo timestamp_ntz, fecha_lanzamiento date"
    ),
    "commercial_calendar": (
        "id string, event_name string, event_type string, event_date date, description string, source string, "
        "created_at timestamp_ntz"
    ),
}

# Partition column and clustering columns per table.
LAYOUT = {
    "shopify_audit_log": ("occurred_day", ["staff_id", "action"]),
    "market_trends": ("trend_date", ["keyword", "signal"]),
    "competitor_prices": ("synced_day", ["product_id", "competitor_name"]),
    "shopping_position": ("scan_date", ["keyword", "product_id"]),
    "gsc_metrics": ("date", ["property", "page"]),
    "raw_traffic_ga4": ("date", ["session_default_channel_group"]),
}

# Days kept per table.
RETENTION_DAYS = {"competitor_prices": 90, "shopping_positions": 365, "market_trends": 730}

# Landed API payloads.
PAYLOAD = {
    "order": (
        "id bigint, order_number bigint, created_at string, updated_at string, total_price string, "
        "subtotal_price string, total_discounts string, financial_status string, fulfillment_status string, "
        "currency string, line_items array<struct<id:bigint, product_id:bigint, variant_id:bigint, title:string, "
        "vendor:string, quantity:bigint, price:string>>"
    ),
    "product": (
        "id bigint, title string, vendor string, product_type string, status string, handle string, "
        "created_at string, updated_at string, published_at string, variants array<struct<id:bigint, title:string, "
        "price:string, sku:string, inventory_quantity:bigint, created_at:string, updated_at:string>>"
    ),
    "customer": (
        "id string, createdAt string, updatedAt string, state string, numberOfOrders string, "
        "amountSpent struct<amount:string, currencyCode:string>, "
        "defaultAddress struct<city:string, province:string, country:string, zip:string>"
    ),
    "audit": (
        "id string, createdAt string, action string, message string, appTitle string, attributeToApp boolean, "
        "attributeToUser boolean, criticalAlert boolean, subjectType string, subjectId string, "
        "author struct<id:string, name:string>, subject struct<__typename:string, id:string>"
    ),
    "conversation": (
        "session_id string, created_at bigint, updated_at bigint, state string, status bigint, people_id string, "
        "meta struct<segments:array<string>, origin:string, nickname:string, email:string, phone:string, "
        "data:struct<rating:struct<value:bigint, comment:string>>>"
    ),
    "message": (
        "session_id string, fingerprint string, type string, `from` string, timestamp bigint, content string, "
        "user struct<nickname:string>"
    ),
    "ga4": "dimensionValues array<struct<value:string>>, metricValues array<struct<value:string>>",
    "gsc": "property string, keys array<string>, clicks bigint, impressions bigint, ctr double, position double",
    "metric_series": (
        "metric_name string, dates array<string>, data array<struct<dimensions:array<string>, "
        "measurements:struct<count:array<bigint>, sum_value:array<double>>>>"
    ),
    "review": (
        "id bigint, sku string, score bigint, votes_up bigint, votes_down bigint, content string, title string, "
        "created_at string, verified_buyer boolean, deleted boolean"
    ),
    "trend": (
        "keyword string, timeline array<struct<date:string, is_partial:boolean, "
        "values:array<struct<query:string, extracted_value:bigint>>>>"
    ),
    "trend_alt": "keyword string, points array<struct<date_from:string, values:array<bigint>>>",
    "listings": (
        "keyword string, product_id bigint, shopping_results array<struct<title:string, source:string, store:string, "
        "price:string, extracted_price:double, tag:string, badge:string, second_hand_condition:string, "
        "link:string, thumbnail:string>>, ads_results array<struct<source:string, price:string>>"
    ),
    "volumes": (
        "text string, keyword_idea_metrics struct<avg_monthly_searches:bigint, "
        "monthly_search_volumes:array<struct<monthly_searches:bigint>>>"
    ),
    "staff": "id string, email string, firstName string, lastName string, active boolean",
    "calls": (
        "ext_pos bigint, extension struct<id:bigint, name:string>, failed boolean, records array<struct<"
        "sessionId:bigint, direction:string, result:string, duration:bigint, startTime:string>>"
    ),
}

STAFF_CSV = "staff_id,email,first_name,last_name,employee_code,active,joined_at".split(",")
ASSIGNMENT_CSV = (
    "employee_code,first_name,last_name,email,current_team,current_role,new_team,new_role,valid_from,"
    "allocation_pct,is_primary,notes"
).split(",")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def base(table: str) -> StructType:
    return struct(BASE[table])


def shop(table: str) -> StructType:
    return struct(SHOP[table])
