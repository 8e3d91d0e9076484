"""Market intelligence: sizes, competitor prices, interest signals, shelf positions, launches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as tx
from ..functions.dates import date_literal, since
from ..functions.exprs import (
    SOLD_PAID, count_where, exact_avg, int_or_zero, js_round, money_mean, money_sum, pct0, safe_div, sold,
)
from .joins import EXISTING, NEW_LAUNCH, attach_volumes, latest_signal


def active_products(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Active products with their mean variant price (to cents) and number of priced variants."""
    prices = variants.where("price > 0").groupBy("product_id").agg(
        money_mean("price").alias("avg_price"), F.count("id").alias("variant_count"))
    return (
        products.where("status = 'active'").select(F.col("id").alias("product_id"), "title", "vendor")
        .join(prices, "product_id").where("avg_price > 0")
    )


def top_stocked_brands(products: DataFrame, variants: DataFrame, own: str, n: int = 30, least: int = 3) -> DataFrame:
    """Brands other than ``own`` with at least ``least`` active products that have variants,
    and their mean stock per variant."""
    stock = variants.groupBy("product_id").agg(
        F.sum("inventory_quantity").alias("_stock"), F.count("inventory_quantity").alias("_n"))
    return (
        products.where((F.col("status") == "active") & ~F.col("vendor").isin(own, ""))
        .select(F.col("id").alias("product_id"), "vendor")
        .join(stock, "product_id")
        .groupBy(F.col("vendor").alias("keyword"))
        .agg(F.count_distinct("product_id").alias("vendor_products"),
             F.round(safe_div(F.sum("_stock"), F.sum("_n")), 0).alias("avg_stock"))
        .where(F.col("vendor_products") >= least)
        .orderBy(F.desc("vendor_products"), "keyword").limit(n)
    )


# Share of searches that buy, and share of the market counted as ours.
BUYER_RATE, SHARE_RATE = 0.01, 0.05


def market_size(products: DataFrame, volumes: DataFrame, keyword_version: str = "v1") -> DataFrame:
    """Buyers, market size and share per product; every figure is rounded to cents from the
    unrounded chain."""
    rows = attach_volumes(products.withColumn("keyword", tx.extract_keyword("title", keyword_version)), volumes)

    def chain(searches: str) -> tuple[Column, Column, Column]:
        buyers = F.col(searches) * F.lit(BUYER_RATE)
        size = buyers * F.col("avg_price")
        return js_round(buyers, 2), js_round(size, 2), js_round(size * F.lit(SHARE_RATE), 2)

    avg, last = chain("avg_monthly_searches"), chain("last_month_searches")
    return rows.select(
        "product_id", F.col("title").alias("product_title"), tx.not_empty("vendor").alias("vendor"), "keyword", "avg_price",
        "avg_monthly_searches", "last_month_searches",
        avg[0].alias("avg_potential_buyers"), last[0].alias("last_month_buyers"),
        avg[1].alias("market_size_avg"), last[1].alias("market_size_last"),
        avg[2].alias("market_share_avg"), last[2].alias("market_share_last"),
    )


def market_dimension(metrics: DataFrame, k: int = 200) -> DataFrame:
    """Products with a market, largest first; cut again for the charts with labels shortened."""
    return (
        metrics.where("market_size_avg > 0").orderBy(F.desc("market_size_avg"), "product_id").limit(k)
        .withColumn("label_50", tx.shorten("product_title", 30, 27))
        .withColumn("label_15", tx.shorten("product_title", 25, 22))
    )


def market_totals(metrics: DataFrame) -> DataFrame:
    """Rounded totals over all products with a market."""
    names = ("market_size_avg", "market_size_last", "market_share_avg", "market_share_last")
    return metrics.where("market_size_avg > 0").agg(
        *[js_round(F.coalesce(money_sum(c), F.lit(0.0))).alias(f"total_{c}") for c in names],
        F.count(F.lit(1)).alias("product_count"),
    )


def price_gap(df: DataFrame, ours: str = "our_price", theirs: str = "competitor_price") -> DataFrame:
    """Batch sign: ours minus theirs, in percent of theirs; competitive when not dearer."""
    o, t = F.col(ours), F.col(theirs)
    return (
        df.withColumn("price_diff_amount", js_round(o - t, 2))
        .withColumn("price_diff_pct", F.when(t > 0, js_round((o - t) / t * 100, 2)).otherwise(F.lit(0.0)))
        .withColumn("is_competitive", F.col("price_diff_amount") <= 0)
    )


def price_gap_live(df: DataFrame, ours: str = "our_price", theirs: str = "competitor_price") -> DataFrame:
    """Interactive sign: theirs minus ours, in percent of ours to 1 decimal; null without prices."""
    o, t = F.col(ours), F.coalesce(F.col(theirs), F.lit(0.0))
    both = (o > 0) & (t > 0)
    return (
        df.withColumn("diff_amount", F.when(o > 0, t - o))
        .withColumn("diff_pct", F.when(both, js_round((t - o) / o * 100, 1)))
        .withColumn("is_competitive_live", F.when(both, o <= t))
    )


def first_listings(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = None) -> DataFrame:
    """All listings, or with ``k`` the first so many per key."""
    return df if k is None else skew.top_per_key(df, keys, order, k).drop("rn")


def price_summary(live: DataFrame, keys: Sequence[str], ours: str = "our_price", theirs: str = "competitor_price") -> DataFrame:
    """Number of listings, least, greatest and mean competitor price and the share of competitive listings."""
    priced = (F.col(theirs) > 0) & (F.col(ours) > 0)
    p = F.when(priced, F.col(theirs))
    known = F.col("is_competitive_live").isNotNull()
    return live.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.min(p).alias("lowest"), F.max(p).alias("highest"),
        js_round(safe_div(money_sum(p), F.count(p)), 2).alias("average"),
        js_round(safe_div(count_where(F.col("is_competitive_live")), count_where(known)) * 100).alias("competitiveness_rate"),
    )


def top20_prices(lines: DataFrame, orders: DataFrame, prices: DataFrame, as_of, days: int = 30, k: int = 20,
                 statuses: Sequence[str] = SOLD_PAID) -> DataFrame:
    """Best sellers beside competitor price statistics.

    The statistics cover all history per product and own price, as in the report this
    reproduces, so a product whose price changed shows once per price.
    """
    recent = since(orders, "created_at", days, as_of).where(sold("financial_status", statuses))
    top = (
        lines.join(recent.select(F.col("id").alias("order_id")), "order_id")
        .groupBy("product_id", "title").agg(F.sum("quantity").alias("total_sold"))
        .orderBy(F.desc("total_sold"), F.asc_nulls_first("product_id"), "title").limit(k)
    )
    # At most k products are looked up, so only their price rows are summed.
    stats = (
        prices.join(F.broadcast(top.select("product_id").distinct()), "product_id", "left_semi")
        .groupBy("product_id", "our_price")
        .agg(exact_avg("competitor_price").alias("avg_competitor_price"),
             F.min("competitor_price").alias("min_competitor_price"))
    )
    mean = F.col("avg_competitor_price")
    gap = F.when((F.col("our_price") != 0) & (mean != 0), js_round((F.col("our_price") - mean) / mean * 100))
    return top.join(stats, "product_id", "left").withColumn("diff_pct", gap)


def price_banner(df: DataFrame, ours: str = "our_price", average: str = "average", lowest: str = "lowest") -> DataFrame:
    """Own price against the mean and the lowest competitor."""
    o, a = F.col(ours), F.col(average)
    return (
        df.withColumn("vs_avg_pct", F.when(a != 0, js_round((o - a) / a * 100)))
        .withColumn("cheaper", o < a)
        .withColumn("at_or_below_lowest", o <= F.col(lowest))
    )


# Signals from most to least urgent.
SEVERITY = ("breakout", "rising", "stable", "falling", "risk")


def severity(signal: str = "signal") -> Column:
    out = F.lit(len(SEVERITY) + 1)
    for place in range(len(SEVERITY), 0, -1):
        out = F.when(F.col(signal) == SEVERITY[place - 1], F.lit(place)).otherwise(out)
    return out


def signal_board(trends: DataFrame) -> DataFrame:
    """Latest signals by severity, then interest."""
    rows = latest_signal(trends)
    keep = [c for c in ("keyword", "signal", "signal_detail", "interest_value", "vendor_products", "avg_stock", "trend_date")
            if c in rows.columns]
    return rows.select(*keep).withColumn("severity", severity()).orderBy(
        "severity", F.desc_nulls_last("interest_value"), "keyword")


def signal_summary(board: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return board.agg(
        count_where(F.col("signal") == "breakout").alias("breakouts"),
        count_where(F.col("signal") == "rising").alias("rising"),
        count_where(F.col("signal") == "risk").alias("at_risk"),
        n.alias("total_brands"),
        F.when(n > 0, js_round(F.sum("interest_value") / n)).otherwise(F.lit(0.0)).alias("avg_index"),
    )


def trend_series(trends: DataFrame, today: date, days: int = 84) -> DataFrame:
    """Interest points per brand of the last days."""
    first = date_literal((today - timedelta(days=days)).isoformat())
    return trends.where((F.col("keyword_type") == "brand") & (F.col("trend_date") >= first)).select(
        "keyword", "trend_date", "interest_value")


def trend_wide(series: DataFrame, brands: Sequence[str]) -> DataFrame:
    """One row per date, one column per given brand (the chart shows up to ten)."""
    kept = series.where(F.col("keyword").isin(*brands))
    return kept.groupBy("trend_date").pivot("keyword", list(brands)).agg(F.max("interest_value"))


def position_kpis(report: DataFrame, kind: str = "organic") -> DataFrame:
    """Tracked keywords, share that appears, best and mean position."""
    p = F.col(f"{kind}_position")
    n = F.count(F.lit(1))
    return report.agg(
        n.alias("tracked"), F.count(p).alias("appeared"),
        js_round(pct0(F.count(p), n)).alias("visibility_pct"),
        F.min(p).alias("best_position"), js_round(F.avg(p), 1).alias("avg_position"),
    )


def launches(df: DataFrame, k: int = 200) -> DataFrame:
    """Launches by date, unknown dates last, newer scans first."""
    return df.orderBy(F.asc_nulls_last("fecha_lanzamiento"), F.desc("scan_day"), "id").limit(k)


def launch_search(df: DataFrame, scan, q: str = "") -> DataFrame:
    """Launches of one scan whose product or brand contains ``q``."""
    needle = q.lower()
    return df.where(F.col("scan_day") == date_literal(scan)).where(
        F.lower("producto").contains(needle) | F.lower("marca").contains(needle))


def launch_stats(df: DataFrame) -> DataFrame:
    """Per scan day: launches, new and existing, and whether it is the latest."""
    per = df.groupBy("scan_day").agg(
        F.count(F.lit(1)).alias("launches"),
        count_where(F.coalesce(F.col("estado_db") != EXISTING, F.lit(True))).alias("new_count"),
        count_where(F.col("estado_db") == EXISTING).alias("existing_count"),
    )
    return per.withColumn("is_latest", F.col("scan_day") == df.agg(F.max("scan_day")).scalar())


OTHER_CATEGORY = "Otro"


def launch_categories(df: DataFrame, scan) -> DataFrame:
    kept = df.where(F.col("scan_day") == date_literal(scan))
    return kept.groupBy(F.coalesce(tx.not_empty("categoria"), F.lit(OTHER_CATEGORY)).alias("category")).agg(
        F.count(F.lit(1)).alias("launches"))


def calendar_months(calendar: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Dated events grouped by month, each month's events in date order."""
    rows = calendar.where(F.col("event_date").isNotNull()).withColumn("month", F.trunc("event_date", "month"))
    event = F.struct("event_date", "event_name")
    return skew.collect_parts(rows, ["month"], event, "events", max_rows)


def upcoming(calendar: DataFrame, today, k: int = 100) -> DataFrame:
    """Events from ``today`` on, soonest first."""
    return calendar.where(F.col("event_date") >= date_literal(today)).orderBy("event_date", "event_name").limit(k)


def known_launches(df: DataFrame) -> DataFrame:
    """Launches whose state is known."""
    return df.where(F.col("estado_db").isin(NEW_LAUNCH, EXISTING))


def keyword_groups(items: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Product ids per keyword, so that each keyword is looked up once."""
    return skew.collect_parts(items, ["keyword"], F.col("product_id"), "product_ids", max_rows)


def unique_keywords(items: DataFrame) -> DataFrame:
    return items.select(F.lower("keyword").alias("keyword")).distinct()


def related_top(df: DataFrame, k: int = 10) -> DataFrame:
    """Top related queries per term by rank; the value is a whole number up to 100."""
    return skew.top_per_key(df, ["term"], [F.col("rank"), F.col("query")], k).select(
        "term", F.col("rn").cast("bigint").alias("place"), "query", F.least(F.lit(100), int_or_zero("value")).alias("pct"))


def related_rising(df: DataFrame, k: int = 12) -> DataFrame:
    """Rising related queries per term by rank, with the breakout flag."""
    return skew.top_per_key(df, ["term"], [F.col("rank"), F.col("query")], k).select(
        "term", F.col("rn").cast("bigint").alias("place"), "query", (F.col("value") == "Breakout").alias("is_breakout"))


def top_region(df: DataFrame) -> DataFrame:
    """First ranked region per term."""
    return df.groupBy("term").agg(F.min_by("region", F.struct("rank", "region")).alias("region"))
