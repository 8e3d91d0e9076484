"""Landed API payloads (parsed with their declared schema) to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.exprs import float_or_null, float_or_zero, int_or_zero, not_empty, price_dots, price_locale
from . import schemas


def parse(df: DataFrame, column: str, kind: str) -> DataFrame:
    """JSON text column to the payload's declared columns.

    The payload is a list of one to ``inline``, past which no condition on its fields moves: a text is read once, where
    conditions (those that exploding a list implies, too) would each read it again.
    """
    parsed = F.from_json(F.col(column), schemas.struct(schemas.PAYLOAD[kind]))
    return df.select(F.inline(F.array(parsed)))


def iso_time(c) -> Column:
    """ISO text to a UTC wall-clock time."""
    stamp = F.col(c) if isinstance(c, str) else c
    return F.to_utc_timestamp(F.try_to_timestamp(stamp), F.current_timezone()).cast("timestamp_ntz")


def millis_time(c) -> Column:
    stamp = F.timestamp_millis(F.col(c) if isinstance(c, str) else c)
    return F.to_utc_timestamp(stamp, F.current_timezone()).cast("timestamp_ntz")


def flatten_orders(raw: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Order payloads; ``notes`` (id, value) carries the status note of an order."""
    flat = raw.select(
        "id", "order_number",
        iso_time("created_at").alias("created_at"),
        iso_time("updated_at").alias("updated_at"),
        float_or_null("total_price").alias("total_price"),
        float_or_null("subtotal_price").alias("subtotal_price"),
        float_or_null("total_discounts").alias("total_discounts"),
        F.coalesce(not_empty("financial_status"), F.lit("unknown")).alias("financial_status"),
        F.coalesce(not_empty("fulfillment_status"), F.lit("unfulfilled")).alias("fulfillment_status"),
        "currency",
    )
    if notes is None:
        return flat.withColumn("estado_de_pedido", F.lit(None).cast("string"))
    parsed = notes.select("id", tx.parse_note("value").alias("estado_de_pedido"))
    return flat.join(parsed, "id", "left")


def flatten_order_lines(raw: DataFrame) -> DataFrame:
    line = F.col("line")
    return raw.select(F.col("id").alias("order_id"), F.explode("line_items").alias("line")).select(
        line["id"].alias("id"), "order_id",
        line["product_id"].alias("product_id"),
        line["variant_id"].alias("variant_id"),
        line["title"].alias("title"),
        not_empty(line["vendor"]).alias("vendor"),
        line["quantity"].alias("quantity"),
        float_or_null(line["price"]).alias("price"),
    )


def flatten_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id", "title",
        not_empty("vendor").alias("vendor"),
        not_empty("product_type").alias("product_type"),
        F.coalesce(not_empty("status"), F.lit("unknown")).alias("status"),
        not_empty("handle").alias("handle"),
        *[iso_time(c).alias(c) for c in ("created_at", "updated_at", "published_at")],
    )


def flatten_variants(raw: DataFrame) -> DataFrame:
    """One row per variant; products without variants give none."""
    v = F.col("variant")
    return raw.select(F.col("id").alias("product_id"), F.explode("variants").alias("variant")).select(
        v["id"].alias("id"), "product_id", v["title"].alias("title"),
        float_or_zero(v["price"]).alias("price"),
        not_empty(v["sku"]).alias("sku"),
        F.coalesce(v["inventory_quantity"], F.lit(0)).alias("inventory_quantity"),
        iso_time(v["created_at"]).alias("created_at"),
        iso_time(v["updated_at"]).alias("updated_at"),
    )


def flatten_customers(raw: DataFrame) -> DataFrame:
    where = F.col("defaultAddress")
    return raw.select(
        F.element_at(F.split("id", "/"), -1).try_cast("bigint").alias("id"),
        iso_time("createdAt").alias("created_at"),
        iso_time("updatedAt").alias("updated_at"),
        F.coalesce(not_empty("state"), F.lit("UNKNOWN")).alias("state"),
        *[not_empty(where[c]).alias(c) for c in ("city", "province", "country", "zip")],
        int_or_zero("numberOfOrders").alias("orders_count"),
        float_or_zero(F.col("amountSpent")["amount"]).alias("total_spent"),
        F.coalesce(not_empty(F.col("amountSpent")["currencyCode"]), F.lit("CLP")).alias("currency"),
    )


# Conversation states and their numeric codes.
STATES = ("resolved", "unresolved", "pending")
STATE_CODES = {2: "resolved", 1: "unresolved", 0: "pending"}


def conversation_status(state: Column, code: Column) -> Column:
    out = F.when(state.isin(*STATES), state)
    for number, name in STATE_CODES.items():
        out = out.when(code == number, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def flatten_conversations(raw: DataFrame) -> DataFrame:
    meta = F.col("meta")
    rating = meta["data"]["rating"]
    return raw.select(
        "session_id",
        millis_time("created_at").alias("created_at"),
        millis_time("updated_at").alias("updated_at"),
        conversation_status(F.col("state"), F.col("status")).alias("status"),
        F.array_join(meta["segments"], ",").alias("segments"),
        rating["value"].alias("rating_value"),
        rating["comment"].alias("rating_comment"),
        not_empty("people_id").alias("people_id"),
        tx.normalize_channel(meta["origin"]).alias("channel_origin"),
        not_empty(meta["nickname"]).alias("visitor_nickname"),
        not_empty(meta["email"]).alias("visitor_email"),
        not_empty(meta["phone"]).alias("visitor_phone"),
    )


def flatten_messages(raw: DataFrame) -> DataFrame:
    """Text messages. Content that is an object arrives as its JSON text, because the
    declared column is a string; a missing fingerprint becomes a hash of the message, the
    same whenever it is read."""
    own = F.sha2(F.to_json(F.struct("session_id", "timestamp", "from", "content")), 256)
    return raw.where(F.col("type") == "text").select(
        F.coalesce(not_empty("fingerprint"), own).alias("message_id"),
        "session_id",
        millis_time("timestamp").alias("created_at"),
        F.col("from").alias("sender_type"),
        F.when(F.col("from") == "operator", not_empty(F.col("user")["nickname"])).alias("operator_name"),
        "content",
    )


def flatten_audit(raw: DataFrame, staff_id: Column | None = None) -> DataFrame:
    """Events a person caused; the whole payload is kept as JSON."""
    subject = F.col("subject")
    return raw.where(F.col("attributeToUser")).select(
        tx.clean_gid("id").alias("audit_id"),
        iso_time("createdAt").alias("occurred_at"),
        (tx.clean_gid(F.col("author")["id"]) if staff_id is None else staff_id).alias("staff_id"),
        F.lit(None).cast("string").alias("staff_email"),
        "action",
        F.coalesce(not_empty("subjectType"), not_empty(subject["__typename"]), F.lit("N/A")).alias("subject_type"),
        F.coalesce(
            not_empty(tx.clean_gid("subjectId")), not_empty(tx.clean_gid(subject["id"])), F.lit("N/A")
        ).alias("subject_id"),
        F.to_json(F.struct(*[F.col(c) for c in schemas.struct(schemas.PAYLOAD["audit"]).fieldNames()])).alias(
            "raw_payload"
        ),
    )


# Order of the analytics dimensions and metrics.
GA4_DIMENSIONS = ("date", "session_default_channel_group", "session_source_medium", "campaign_name")
GA4_METRICS = (
    "sessions", "total_users", "new_users", "engagement_rate", "average_session_duration", "conversions",
    "ecommerce_purchases", "purchase_revenue",
)
GA4_FLOATS = ("engagement_rate", "average_session_duration", "purchase_revenue")


def flatten_ga4(raw: DataFrame) -> DataFrame:
    def at(array: str, i: int) -> Column:
        return F.get(F.col(array), F.lit(i))["value"]

    dims = [
        (F.try_to_date(at("dimensionValues", i), "yyyyMMdd") if name == "date" else at("dimensionValues", i)).alias(name)
        for i, name in enumerate(GA4_DIMENSIONS)
    ]
    nums = [
        (float_or_zero if name in GA4_FLOATS else int_or_zero)(at("metricValues", i)).alias(name)
        for i, name in enumerate(GA4_METRICS)
    ]
    return raw.select(*dims, *nums, F.lit(0).cast("bigint").alias("add_to_carts"))


def flatten_gsc(raw: DataFrame) -> DataFrame:
    day, page, query = (F.get(F.col("keys"), F.lit(i)) for i in range(3))
    return raw.select(
        F.md5(F.concat_ws("-", day, "property", page, query)).alias("id"),
        day.try_cast("date").alias("date"),
        "property", page.alias("page"), query.alias("query"),
        "clicks", "impressions", "ctr", "position",
    )


def flatten_metric_series(raw: DataFrame) -> DataFrame:
    """Parallel arrays per metric to one row per day, where something was counted."""
    agg = F.col("agg")
    counts, sums = agg["measurements"]["count"], agg["measurements"]["sum_value"]
    day = F.col("day")
    return (
        raw.select("metric_name", "dates", F.explode("data").alias("agg"))
        .select(
            "metric_name",
            F.coalesce(F.get(agg["dimensions"], F.lit(0)), F.lit("")).alias("message_id"),
            F.coalesce(F.get(agg["dimensions"], F.lit(1)), F.lit("")).alias("flow_id"),
            F.explode(
                F.arrays_zip(F.col("dates").alias("date"), counts.alias("count"), sums.alias("sum_value"))
            ).alias("day"),
        )
        .select(
            iso_time(day["date"]).alias("date"),
            "metric_name", "message_id", "flow_id",
            day["count"].alias("count"),
            F.coalesce(day["sum_value"], F.lit(0.0)).alias("sum_value"),
        )
        .where(F.col("date").isNotNull() & ((F.col("count") > 0) | (F.col("sum_value") > 0)))
    )


def flatten_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("review_id"),
        F.col("sku").cast("string").alias("product_id"),
        "score", "votes_up", "votes_down",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("title", F.lit("")).alias("title"),
        iso_time("created_at").alias("created_at"),
        F.coalesce("verified_buyer", F.lit(False)).alias("verified_buyer"),
        F.when(F.col("deleted"), F.lit("pending")).otherwise(F.lit("published")).alias("status"),
    )


def trend_date(c) -> Column:
    """'Dec 29 – Jan 4, 2020' -> first day of the range; 'Jan 2020' and ISO dates as they are."""
    label = F.col(c) if isinstance(c, str) else c
    pattern = r"^([A-Za-z]+ \d+).*?, (\d{4})"
    first = F.regexp_extract(label, pattern, 1)
    ranged = F.concat_ws(" ", F.substring(first, 1, 3), F.regexp_extract(first, r"(\d+)$", 1),
                         F.regexp_extract(label, pattern, 2))
    month = F.regexp_extract(label, r"^([A-Za-z]{3})[a-z]* (\d{4})$", 0)
    monthly = F.concat_ws(" ", F.substring(month, 1, 3), F.regexp_extract(month, r"(\d{4})$", 1))
    return F.when(first != "", F.try_to_date(ranged, "MMM d yyyy")).otherwise(
        F.coalesce(F.try_to_date(monthly, "MMM yyyy"), F.substring(label, 1, 10).try_cast("date"))
    )


def flatten_trend(raw: DataFrame) -> DataFrame:
    """Interest points with a readable date; a missing value counts 0."""
    p = F.col("point")
    return (
        raw.select("keyword", F.explode("timeline").alias("point"))
        .select(
            "keyword",
            trend_date(p["date"]).alias("trend_date"),
            F.coalesce(F.get(p["values"], F.lit(0))["extracted_value"], F.lit(0)).alias("interest_value"),
            F.coalesce(p["is_partial"], F.lit(False)).alias("is_partial"),
        )
        .where(F.col("trend_date").isNotNull())
    )


def flatten_trend_alt(raw: DataFrame) -> DataFrame:
    """The second provider's shape: ISO date and a plain value array."""
    p = F.col("point")
    return (
        raw.select("keyword", F.explode("points").alias("point"))
        .select(
            "keyword",
            F.substring_index(p["date_from"], "T", 1).try_cast("date").alias("trend_date"),
            F.coalesce(F.get(p["values"], F.lit(0)), F.lit(0)).alias("interest_value"),
            F.lit(False).alias("is_partial"),
        )
        .where(F.col("trend_date").isNotNull())
    )


# Tag texts that mean "not in stock".
OUT_OF_STOCK = ("agotado", "out of stock", "sin stock", "no disponible")


def flatten_listings(raw: DataFrame, k: int | None = None) -> DataFrame:
    """Listings by rank (with ``k`` the first so many), then those with a price and a store."""
    results = F.col("shopping_results") if k is None else F.slice("shopping_results", 1, k)
    item = F.col("item")
    tags = F.lower(F.concat_ws(" ", item["tag"], item["badge"], item["second_hand_condition"]))
    gone = F.lit(False)
    for word in OUT_OF_STOCK:
        gone = gone | tags.contains(word)
    price = F.when(not_empty(item["price"]).isNotNull(), price_dots(item["price"])).otherwise(
        F.coalesce(item["extracted_price"], F.lit(0.0))
    )
    return (
        raw.select("keyword", "product_id", F.posexplode(results).alias("pos", "item"))
        .select(
            "keyword", "product_id",
            (F.col("pos") + 1).cast("bigint").alias("rank"),
            F.coalesce(item["title"], F.lit("")).alias("competitor_title"),
            price.alias("competitor_price"),
            F.coalesce(not_empty(item["source"]), item["store"], F.lit("")).alias("competitor_name"),
            (~gone).alias("has_stock"),
            not_empty(item["link"]).alias("competitor_url"),
            not_empty(item["thumbnail"]).alias("thumbnail_url"),
        )
        .where((F.col("competitor_price") > 0) & (F.col("competitor_name") != ""))
    )


def shelf_position(raw: DataFrame, brand: str) -> DataFrame:
    """1-based place of the first listing whose store contains the brand, organic and paid,
    and the first other store with its price. One result list is one row's array."""
    mine = brand.lower()

    def place(array: str) -> Column:
        flags = F.transform(F.col(array), lambda r: F.coalesce(F.lower(r["source"]).contains(mine), F.lit(False)))
        at = F.array_position(flags, True)
        return F.when(at > 0, at)

    other = F.get(
        F.filter("shopping_results", lambda r: ~F.coalesce(F.lower(r["source"]).contains(mine), F.lit(False))), F.lit(0)
    )
    return raw.select(
        "keyword", "product_id",
        place("shopping_results").alias("organic_position"),
        place("ads_results").alias("paid_position"),
        other["source"].alias("top_competitor_name"),
        price_locale(other["price"]).alias("top_competitor_price"),
    )


def flatten_volumes(raw: DataFrame) -> DataFrame:
    """Search volumes per lower-cased keyword; the last month is the array's last element."""
    m = F.col("keyword_idea_metrics")
    months = m["monthly_search_volumes"]
    last = F.try_element_at(months, F.lit(-1))["monthly_searches"]
    return raw.select(
        tx.trim_space(F.lower("text")).alias("keyword"),
        F.coalesce(m["avg_monthly_searches"], F.lit(0)).alias("avg_monthly_searches"),
        F.coalesce(last, F.lit(0)).alias("last_month_searches"),
    ).where(F.col("keyword") != "")


def flatten_staff(raw: DataFrame) -> DataFrame:
    return raw.withColumn("staff_id", tx.staff_gid("id")).select(
        "staff_id", "email",
        F.col("firstName").alias("first_name"),
        F.col("lastName").alias("last_name"),
        tx.employee_code("email", "firstName", "lastName", "staff_id").alias("employee_code"),
        "active",
    )


def variant_titles(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Product title for the default variant, else 'product - variant'."""
    p = products.select(F.col("id").alias("product_id"), F.col("title").alias("product_title"))
    shown = F.when(F.col("title") == "Default Title", F.col("product_title")).otherwise(
        F.concat("product_title", F.lit(" - "), "title")
    )
    return variants.join(p, "product_id").select("id", shown.alias("title"), "price")


def flatten_calls(raw: DataFrame) -> DataFrame:
    """Call records per extension; failed extensions are skipped."""
    call = F.col("call")
    return (
        raw.where(~F.coalesce("failed", F.lit(False)))
        .select("ext_pos", "extension", F.posexplode("records").alias("seq", "call"))
        .select(
            call["sessionId"].alias("session_id"),
            F.col("extension")["id"].alias("extension_id"),
            F.col("extension")["name"].alias("extension_name"),
            "ext_pos",
            F.col("seq").cast("bigint").alias("seq"),
            call["direction"].alias("direction"),
            call["result"].alias("result"),
            call["duration"].alias("duration"),
            iso_time(call["startTime"]).alias("start_time"),
        )
    )


def fenced_rows(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per struct of fenced JSON replies."""
    keep = [c for c in raw.columns if c != column]
    return raw.select(*keep, F.explode(tx.parse_fenced_json(column, schema)).alias("_r")).select(*keep, "_r.*")
