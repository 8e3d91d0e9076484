"""Sales, purchasing and customer marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.dates import bounds, day, in_dates, in_range, range_days, since
from ..functions.exprs import (
    SOLD_NET, SOLD_PAID, SOLD_SCAN, count_where, div0, money_sum, safe_div, sold, sum_where,
)
from .joins import handle_positions, page_weights, sold_lines

# Fixed value: shown for lines without a vendor.
NO_VENDOR = "Desconocido"


def sales_kpis(orders: DataFrame, d0, d1, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Gross and net totals of the range, average order value and daily average."""
    lo, hi = bounds(d0, d1)
    is_sold = sold("financial_status", statuses)
    totals = in_range(orders, "created_at", d0, d1).agg(
        money_sum("total_price").alias("gross_sales"),
        sum_where(is_sold, "total_price").alias("net_sales"),
        F.count("id").alias("gross_order_count"),
        F.count(F.when(is_sold, F.col("id"))).alias("net_order_count"),
        money_sum("total_discounts").alias("total_discounts"),
        sum_where(is_sold, "total_discounts").alias("net_discounts"),
    )
    money = ["gross_sales", "net_sales", "total_discounts", "net_discounts"]
    return (
        totals.fillna(0.0, subset=money)
        .withColumn("aov", div0("net_sales", "net_order_count"))
        .withColumn("average_daily_sales", F.col("net_sales") / F.lit(float(range_days(lo, hi))))
    )


def sales_trend(orders: DataFrame, d0, d1, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    return in_range(orders, "created_at", d0, d1).groupBy(day("created_at").alias("date")).agg(
        sum_where(sold("financial_status", statuses), "total_price").alias("net_sales"),
        money_sum("total_price").alias("gross_sales"),
        F.count("id").alias("orders"),
    )


def status_mix(orders: DataFrame, d0, d1) -> DataFrame:
    return (
        in_range(orders, "created_at", d0, d1)
        .groupBy(F.coalesce("financial_status", F.lit("unknown")).alias("status"))
        .agg(F.count("id").alias("count"), money_sum("total_price").alias("value"))
        .orderBy(F.desc("count"), "status")
    )


# The states with a column of their own; null falls in none of the counts.
NAMED_STATES = ("paid", "pending", "refunded", "partially_refunded")


def sales_daily(orders: DataFrame, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Ten measures per day."""
    state = F.col("financial_status")
    is_sold = sold(state, statuses)
    return orders.groupBy(day("created_at").alias("sale_date")).agg(
        F.count("id").alias("gross_orders"),
        money_sum("total_price").alias("gross_sales"),
        money_sum("total_discounts").alias("total_discounts"),
        F.count(F.when(is_sold, F.col("id"))).alias("net_orders"),
        sum_where(is_sold, "total_price").alias("net_sales"),
        *[count_where(state == s).alias(f"{s}_count") for s in NAMED_STATES],
        count_where(~state.isin(*NAMED_STATES)).alias("other_count"),
    )


def sales_summary(daily: DataFrame, d0, d1) -> DataFrame:
    """Period totals from the daily mart."""
    lo, hi = bounds(d0, d1)
    counts = [f"{s}_count" for s in NAMED_STATES] + ["other_count"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["net_orders", "gross_orders", *counts]]
    money = [F.coalesce(money_sum(c), F.lit(0.0)).alias(c) for c in ("net_sales", "gross_sales", "total_discounts")]
    return (
        in_dates(daily, "sale_date", str(lo.date()), str(hi.date()))
        .agg(*money, *sums)
        .withColumn("aov", div0("net_sales", "net_orders"))
        .withColumn("avg_daily_sales", F.col("net_sales") / F.lit(float(range_days(lo, hi))))
    )


def summary_statuses(summary: DataFrame) -> DataFrame:
    """Status counts of the summary as rows, without empty ones."""
    labels = {"paid_count": "Paid", "pending_count": "Pending", "refunded_count": "Refunded",
              "partially_refunded_count": "Partially Refunded", "other_count": "Other"}
    pairs = ", ".join(f"'{label}', {c}" for c, label in labels.items())
    return summary.selectExpr(f"stack({len(labels)}, {pairs}) as (name, value)").where("value > 0")


def _revenue(lines: DataFrame, keys: Sequence) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity_sold"),
        money_sum(F.col("price") * F.col("quantity")).alias("gross_revenue"),
    )


def top_products(lines: DataFrame, orders: DataFrame, d0, d1, k: int = 5, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Best products by revenue; ties by product id, title and vendor."""
    return (
        _revenue(sold_lines(orders, lines, d0, d1, statuses), ["product_id", "title", "vendor"])
        .orderBy(F.desc("gross_revenue"), "product_id", "title", F.asc_nulls_first("vendor"))
        .limit(k)
        .select("product_id", F.col("title").alias("product_title"),
                F.coalesce("vendor", F.lit(NO_VENDOR)).alias("brand"), "quantity_sold", "gross_revenue")
    )


def top_brands(lines: DataFrame, orders: DataFrame, d0, d1, k: int = 5, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Best brands by revenue. Grouped by the raw vendor, so lines without a vendor and a
    vendor named like the placeholder stay two rows."""
    return (
        _revenue(sold_lines(orders, lines, d0, d1, statuses), ["vendor"])
        .orderBy(F.desc("gross_revenue"), F.asc_nulls_first("vendor"))
        .limit(k)
        .select(F.coalesce("vendor", F.lit(NO_VENDOR)).alias("brand"), "quantity_sold", "gross_revenue")
    )


def top_products_seo(lines: DataFrame, orders: DataFrame, products: DataFrame, gsc: DataFrame, d0, d1, k: int = 100) -> DataFrame:
    """Best ``k`` products with handle and search position; the limit comes before the lookups.

    Search rows are summed per page, reduced to the handles of those ``k`` products (at most
    ``k`` rows are broadcast), then summed per handle.
    """
    top = top_products(lines, orders, d0, d1, k).join(
        products.select(F.col("id").alias("product_id"), "handle"), "product_id", "left"
    )
    wanted = top.select("handle").where(F.col("handle").isNotNull()).distinct()
    weights = page_weights(in_dates(gsc, "date", str(d0)[:10], str(d1)[:10]))
    per_handle = handle_positions(weights.join(F.broadcast(wanted), "handle", "left_semi"))
    return top.join(per_handle, "handle", "left").select(
        "product_id", "product_title", "brand", "quantity_sold", "gross_revenue", "handle", "seo_position"
    )


def shop_kpis(orders: DataFrame, d0=None, d1=None) -> DataFrame:
    """Paid-only headline figures."""
    kept = in_range(orders, "created_at", d0, d1) if d0 and d1 else orders
    paid = sold("financial_status", SOLD_PAID)
    return (
        kept.agg(
            sum_where(paid, "total_price").alias("net_sales"), F.count("id").alias("total_orders"),
            count_where(paid).alias("paid_orders"), F.max("currency").alias("currency"),
        )
        .withColumn("net_sales", F.coalesce("net_sales", F.lit(0.0)))
        .withColumn("aov", div0("net_sales", "paid_orders"))
        .withColumn("currency", F.coalesce("currency", F.lit("USD")))
    )


def open_orders_pred():
    """Paid, not fulfilled (null counts as not), status note numbered 0 to 5."""
    return (
        (F.col("financial_status") == "paid")
        & (F.coalesce("fulfillment_status", F.lit("")) != "fulfilled")
        & F.col("estado_de_pedido").rlike(r"^[0-5]\. ")
    )


OPEN_KEYS = ["id", "order_number", "created_at", "total_price", "currency", "estado_de_pedido"]


def open_order_rows(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Open purchase orders beside their lines, one row per line."""
    l = lines.select(
        F.col("order_id").alias("_order"),
        F.struct(F.col("id").alias("line_id"), "title", "quantity", "price", "vendor").alias("line"),
    )
    open_ = orders.where(open_orders_pred()).select(*OPEN_KEYS)
    # Without lines the row carries one struct of nulls.
    blank = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
        ("line_id", "bigint"), ("title", "string"), ("quantity", "bigint"), ("price", "double"), ("vendor", "string"))])
    return open_.join(l, F.col("id") == F.col("_order"), "left").drop("_order").withColumn(
        "line", F.coalesce("line", blank)
    )


def open_orders(orders: DataFrame, lines: DataFrame, max_lines: int = 50_000) -> DataFrame:
    """Open orders with their lines as an array sorted by line id; orders beyond
    ``max_lines`` lines continue in further parts, in the same order."""
    rows = open_order_rows(orders, lines)
    return skew.collect_parts(rows, OPEN_KEYS, F.col("line"), "lines", max_lines)


def filter_open_orders(open_: DataFrame, q: str = "", status: str = "all") -> DataFrame:
    """Orders whose number or any line title contains ``q`` and whose note starts with ``status``, with all their parts."""
    in_lines = F.exists("lines", lambda l: F.coalesce(F.lower(l["title"]).contains(q.lower()), F.lit(False)))
    hit = F.col("order_number").cast("string").contains(q) | in_lines
    kept = open_ if status == "all" else open_.where(F.col("estado_de_pedido").startswith(status))
    if "part" not in open_.columns:
        return kept.where(hit)
    # A match in one part keeps the whole order. Orders of equal keys are one order; keys may be null.
    found = kept.where(hit).select(F.struct(*OPEN_KEYS).alias("_key")).distinct()
    return kept.withColumn("_key", F.struct(*OPEN_KEYS)).join(found, "_key", "left_semi").drop("_key").select(*open_.columns)


def search_open_orders(orders: DataFrame, lines: DataFrame, q: str = "", status: str = "all") -> DataFrame:
    """The same search on long rows, one row per order without its lines: a semi join whatever the size of an order."""
    open_ = orders.where(open_orders_pred()).select(*OPEN_KEYS)
    kept = open_ if status == "all" else open_.where(F.col("estado_de_pedido").startswith(status))
    titled = lines.where(F.lower("title").contains(q.lower())).select(F.col("order_id").alias("id")).distinct()
    numbered = F.col("order_number").cast("string").contains(q)
    hit = kept.join(titled.withColumn("_titled", F.lit(True)), "id", "left").where(numbered | F.col("_titled"))
    return hit.select(*OPEN_KEYS).distinct()


def open_orders_total(filtered: DataFrame) -> DataFrame:
    # No part is sure to be there: equal lines all fall into one, whichever that is.
    first = filtered.select(*OPEN_KEYS).distinct() if "part" in filtered.columns else filtered
    return first.agg(
        F.coalesce(money_sum("total_price"), F.lit(0.0)).alias("total_amount"), F.count(F.lit(1)).alias("orders")
    )


def scan_candidates(lines: DataFrame, orders: DataFrame, as_of, days: int = 30, k: int = 30) -> DataFrame:
    """Best sellers by units of the last days, for the shelf scan."""
    recent = since(orders, "created_at", days, as_of).where(sold("financial_status", SOLD_SCAN))
    return (
        lines.where(F.col("product_id").isNotNull())
        .join(recent.select(F.col("id").alias("order_id")), "order_id")
        .groupBy("product_id", "title")
        .agg(F.sum("quantity").alias("total_sold"))
        .orderBy(F.desc("total_sold"), "product_id", "title")
        .limit(k)
    )


def status_matrix(orders: DataFrame, notes: Sequence[str] = ("0. ", "1. ", "2. ")) -> DataFrame:
    """Orders by payment and fulfilment status, among the given status notes."""
    hit = F.lit(False)
    for prefix in notes:
        hit = hit | F.col("estado_de_pedido").startswith(prefix)
    return orders.where(hit).groupBy("financial_status", "fulfillment_status").agg(F.count(F.lit(1)).alias("count"))


def line_product_probe(lines: DataFrame, products: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Lines whose title contains a pattern, beside their product; unmatched ids show null."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("title").contains(p)
    p = products.select(F.col("id").alias("joined_id"), "handle")
    return lines.where(hit).select("product_id", "title").join(p, F.col("product_id") == F.col("joined_id"), "left")


def customer_kpis(customers: DataFrame) -> DataFrame:
    """Customers with orders: number, revenue, mean spend and mean orders."""
    return customers.where("orders_count > 0").agg(
        F.count("id").alias("total_customers"),
        money_sum("total_spent").alias("global_revenue"),
        safe_div(money_sum("total_spent"), F.count("total_spent")).alias("global_ltv"),
        F.avg("orders_count").alias("global_recurrence"),
    )


def customer_geo(customers: DataFrame, country: str = "Chile", k: int = 20) -> DataFrame:
    """Cities of a country by customers."""
    kept = customers.where((F.col("country") == country) & (F.col("city") != "") & (F.col("orders_count") > 0))
    return (
        kept.groupBy("city", "province")
        .agg(
            F.count("id").alias("total_customers"),
            money_sum("total_spent").alias("total_revenue"),
            safe_div(money_sum("total_spent"), F.count("total_spent")).alias("avg_ltv"),
            F.avg("orders_count").alias("avg_orders"),
        )
        .orderBy(F.desc("total_customers"), "city", F.asc_nulls_first("province"))
        .limit(k)
    )
