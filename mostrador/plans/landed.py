"""Landed payloads rebuilt from the shop tables, as JSON text in column ``payload``.

Each table row becomes a payload of its own, so nothing is grouped; nested lists carry the
row and one or more variations of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def as_payload(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))


def orders(t) -> DataFrame:
    o = t.shopify_orders
    return as_payload(o.select(
        "id", "order_number", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"),
        *[F.col(c).cast("string").alias(c) for c in ("total_price", "subtotal_price", "total_discounts")],
        "financial_status", "fulfillment_status", "currency"))


def order_lines(t) -> DataFrame:
    """Order payloads with two lines each: the table's line and its refund under -id."""

    def line(sign: int, vendor: Column) -> Column:
        return F.struct((F.col("id") * sign).alias("id"), "product_id", "variant_id", "title", vendor.alias("vendor"), "quantity",
                        F.col("price").cast("string").alias("price"))

    vendor = F.col("vendor")
    return as_payload(t.shopify_order_lines.select(
        F.col("order_id").alias("id"), F.array(line(1, vendor), line(-1, F.coalesce(vendor, F.lit("")))).alias("line_items")))


def order_notes(t) -> DataFrame:
    """Status notes: half of them as JSON arrays, half as bare text."""
    note = F.col("estado_de_pedido")
    wrapped = F.concat(F.lit('["'), note, F.lit('", "x"]'))
    return t.shopify_orders.select("id", F.when(F.col("id") % 2 == 0, wrapped).otherwise(note).alias("value"))


def products(t) -> DataFrame:
    p = t.shopify_products
    return as_payload(p.select(
        "id", "title", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("vendor")).alias("vendor"), "product_type",
        F.when(F.col("id") % 5 != 0, F.col("status")).alias("status"), "handle", iso("created_at").alias("created_at"),
        iso("created_at").alias("updated_at")))


def variants(t) -> DataFrame:
    """Product payloads with the table's variant and one without price, sku and stock."""
    full = F.struct("id", "title", F.col("price").cast("string").alias("price"), "sku", "inventory_quantity")
    bare = F.struct((-F.col("id")).alias("id"), "title", F.lit("n/a").alias("price"), F.lit("").alias("sku"),
                    F.lit(None).cast("bigint").alias("inventory_quantity"))
    listed = F.when(F.col("product_id") % 10 != 0, F.array(full, bare))
    return as_payload(t.shopify_product_variants.select(F.col("product_id").alias("id"), listed.alias("variants")))


def customers(t) -> DataFrame:
    key = F.col("id")
    return as_payload(t.shopify_customers.select(
        F.concat(F.lit("gid://shop/Customer/"), key).alias("id"), F.lit("2024-01-01T03:00:00+03:00").alias("createdAt"),
        F.lit("2024-01-02T00:00:00Z").alias("updatedAt"), F.when(key % 2 == 0, "ENABLED").alias("state"),
        F.when(F.col("orders_count") > 0, F.col("orders_count").cast("string")).alias("numberOfOrders"),
        F.when(F.col("orders_count") > 0, F.struct(
            F.col("total_spent").cast("string").alias("amount"), F.when(key % 3 == 0, "USD").alias("currencyCode"))).alias("amountSpent"),
        F.when(key % 7 != 0, F.struct("city", "province", "country")).alias("defaultAddress")))


def conversations(t) -> DataFrame:
    c = t.crisp_conversations
    code = F.when(F.col("status") == "resolved", 2).when(F.col("status") == "unresolved", 1).otherwise(0)
    odd = F.col("rating_value").isNull()
    origin = F.col("channel_origin")
    return as_payload(c.select(
        "session_id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("created_at"),
        F.unix_millis(F.col("updated_at").cast("timestamp")).alias("updated_at"),
        F.when(~odd, F.col("status")).alias("state"), F.when(odd, code).alias("status"), "people_id",
        F.struct(
            F.array(F.lit("web"), F.col("visitor_nickname")).alias("segments"),
            F.when(origin == "whatsapp", F.lit("urn:crisp.im:whatsapp:0")).otherwise(origin).alias("origin"),
            F.col("visitor_nickname").alias("nickname"), F.col("visitor_email").alias("email"), F.col("visitor_phone").alias("phone"),
            F.struct(F.when(~odd, F.struct(F.col("rating_value").alias("value"), F.lit("ok").alias("comment"))).alias("rating")).alias("data"),
        ).alias("meta")))


def messages(t) -> DataFrame:
    return as_payload(t.crisp_messages.select(
        "session_id", F.col("message_id").alias("fingerprint"),
        F.when(F.col("sender_type") == "system", "event").otherwise("text").alias("type"), F.col("sender_type").alias("from"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("timestamp"), "content",
        F.struct(F.coalesce("operator_name", F.lit("visitor")).alias("nickname")).alias("user")))


def audit(t) -> DataFrame:
    return as_payload(t.audit_raw.select(
        "id", iso("created_at").alias("createdAt"), "action", "message", F.col("app_title").alias("appTitle"),
        F.col("to_app").alias("attributeToApp"), F.col("to_user").alias("attributeToUser"), F.lit(False).alias("criticalAlert"),
        F.col("subject_type").alias("subjectType"), F.col("subject_id").alias("subjectId"),
        F.when(F.col("author_id").isNotNull(), F.struct(F.col("author_id").alias("id"), F.lit("x").alias("name"))).alias("author"),
        F.when(F.col("nested_type").isNotNull(), F.struct(F.col("nested_type").alias("__typename"), F.col("nested_id").alias("id"))).alias("subject")))


def ga4(t) -> DataFrame:
    dims = [F.date_format("date", "yyyyMMdd"), F.col("session_default_channel_group"), F.col("session_source_medium"), F.col("campaign_name")]
    nums = ["sessions", "total_users", "new_users", "engagement_rate", "average_session_duration", "conversions", "ecommerce_purchases", "purchase_revenue"]
    # Metrics of zero arrive as unreadable text.
    shown = [F.when(F.col(c) == 0, F.lit("n/a")).otherwise(F.col(c).cast("string")) for c in nums]
    return as_payload(t.raw_traffic_ga4.select(
        F.array(*[F.struct(d.cast("string").alias("value")) for d in dims]).alias("dimensionValues"),
        F.array(*[F.struct(s.alias("value")) for s in shown]).alias("metricValues")))


def gsc(t) -> DataFrame:
    return as_payload(t.gsc_metrics.select(
        "property", F.array(F.col("date").cast("string"), "page", "query").alias("keys"), "clicks", "impressions", "ctr", "position"))


def metric_series(t) -> DataFrame:
    """Parallel arrays of three days: the table's day, an empty day and one without a sum."""
    ids = F.array(F.when(F.col("campaign_name") == "", "").otherwise(F.concat(F.lit("m"), "campaign_name")),
                  F.when(F.col("flow_name") == "", "").otherwise(F.concat(F.lit("f"), "flow_name")))
    days = F.array(iso("date"), F.lit("2024-02-01T00:00:00Z"), F.lit("2024-02-02T00:00:00Z"))
    figures = F.struct(F.array("count", F.lit(0).cast("bigint"), F.lit(1).cast("bigint")).alias("count"),
                       F.array("sum_value", F.lit(0.0)).alias("sum_value"))
    return as_payload(t.klaviyo_metrics.select(
        "metric_name", days.alias("dates"), F.array(F.struct(ids.alias("dimensions"), figures.alias("measurements"))).alias("data")))


def reviews(t) -> DataFrame:
    r = t.raw_yotpo_reviews
    return as_payload(r.select(
        F.col("review_id").alias("id"), F.col("product_id").alias("sku"), "score", "votes_up", "votes_down",
        F.when(F.col("score") > 2, F.lit("good")).alias("content"), iso("created_at").alias("created_at"),
        F.when(F.col("verified_buyer"), F.lit(True)).alias("verified_buyer"), (F.col("status") == "pending").alias("deleted")))


def trends(t) -> DataFrame:
    """Weekly points with range labels, each beside one whose date cannot be read."""
    label = F.concat(F.date_format("trend_date", "MMM d"), F.lit(" – "), F.date_format(F.date_add("trend_date", 6), "MMM d, yyyy"))
    value = F.when(F.col("interest_value") > 0, F.col("interest_value"))
    values = F.array(F.struct(F.col("keyword").alias("query"), value.alias("extracted_value")))
    points = [F.struct(d.alias("date"), F.lit(False).alias("is_partial"), values.alias("values")) for d in (label, F.lit("next week"))]
    return as_payload(t.market_trends.select("keyword", F.array(*points).alias("timeline")))


def trends_alt(t) -> DataFrame:
    day = F.concat(F.col("trend_date").cast("string"), F.lit("T00:00:00+00:00"))
    points = [F.struct(d.alias("date_from"), F.array("interest_value").alias("values")) for d in (day, F.lit(""))]
    return as_payload(t.market_trends.select("keyword", F.array(*points).alias("points")))


# The stores of a result list; which one comes first depends on the product.
STORES = ("'Mi Tienda CL'", "''", "'Tienda Sur'", "competitor_name", "'MI TIENDA'", "'Norte'", "concat(competitor_name, ' Outlet')")


def listings(t) -> DataFrame:
    """Result lists of seven listings per competitor price."""
    stores = f"array({', '.join(STORES)})"
    source = [F.expr(f"{stores}[cast((product_id + {i}) % {len(STORES)} as int)]") for i in range(len(STORES))]
    items = [F.struct(
        F.concat(F.lit("Offer of "), s).alias("title"), s.alias("source"),
        F.concat(F.lit("$"), (F.col("competitor_price") + i).cast("bigint").cast("string"), F.lit(",50")).alias("price"),
        F.when(~F.col("has_stock"), F.lit("Producto AGOTADO hoy")).alias("tag")) for i, s in enumerate(source)]
    paid = [F.struct(s.alias("source"), F.lit("$1").alias("price")) for s in reversed(source[:3])]
    return as_payload(t.competitor_prices.select(
        F.concat(F.lit("kw "), "product_id").alias("keyword"), "product_id", F.array(*items).alias("shopping_results"), F.array(*paid).alias("ads_results")))


def volumes(t) -> DataFrame:
    months = F.array(F.struct(F.lit(5).alias("monthly_searches")), F.struct(F.col("last_month_searches").alias("monthly_searches")))
    return as_payload(t.keyword_volumes.select(
        F.concat(F.lit(" "), F.upper("keyword"), F.lit("  ")).alias("text"),
        F.struct("avg_monthly_searches", F.when(F.length("keyword") % 2 == 0, months).alias("monthly_search_volumes")).alias("keyword_idea_metrics")))


def staff(t) -> DataFrame:
    return as_payload(t.shopify_staff.select(
        F.concat(F.lit("gid://shop/StaffMember/"), "staff_id").alias("id"), "email", F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"), "active"))


def calls(t) -> DataFrame:
    """Pages of at most 200 records per extension, as the call log serves them."""
    record = F.struct(F.col("session_id").alias("sessionId"), "direction", "result", "duration", iso("start_time").alias("startTime"))
    pages = t.call_log.groupBy("extension_id", "extension_name", F.floor(F.col("seq") / 200).alias("page")).agg(
        F.collect_list(record).alias("records"))
    return as_payload(pages.select(
        F.col("extension_id").alias("ext_pos"), F.struct(F.col("extension_id").alias("id"), F.col("extension_name").alias("name")).alias("extension"),
        (F.col("extension_id") == 6).alias("failed"), "records"))
