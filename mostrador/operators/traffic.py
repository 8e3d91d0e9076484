"""Site traffic, search performance and paid ads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_dates
from ..functions.exprs import div0, exact_avg, js_round, money_sum, not_empty, pct0, safe_div, wavg
from .joins import product_pages, product_seo_card, traffic_with_orders

NOT_SET = "(Not Set)"


# --- shop traffic ---------------------------------------------------------------------

def traffic_daily(traffic: DataFrame, orders: DataFrame, d0, d1) -> DataFrame:
    return traffic_with_orders(traffic, orders, d0, d1).withColumn("conversion_rate", pct0("orders", "total_sessions"))


def traffic_kpis(daily: DataFrame) -> DataFrame:
    """Totals of daily rows. The bounce rate is the plain mean over days, a null day counting 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_sessions", "unique_visitors", "pageviews", "orders")]
    bounce = F.coalesce(F.sum(F.col("bounce_rate").cast("decimal(24,6)")).cast("double"), F.lit(0.0))
    return (
        daily.agg(*sums, (bounce / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_bounce_rate"))
        .withColumn("avg_conversion_rate", pct0("orders", "total_sessions"))
        .withColumn("pages_per_session", div0("pageviews", "total_sessions"))
    )


# --- web analytics --------------------------------------------------------------------

def ga_kpis(ga4: DataFrame, d0, d1) -> DataFrame:
    return in_dates(ga4, "date", d0, d1).agg(
        F.sum("sessions").alias("total_sessions"),
        F.sum("total_users").alias("total_users"),
        F.sum("new_users").alias("new_users"),
        F.sum("conversions").alias("conversions"),
        F.sum("ecommerce_purchases").alias("ecommerce_purchases"),
        money_sum("purchase_revenue").alias("purchase_revenue"),
        F.sum("add_to_carts").alias("add_to_carts"),
        F.round(exact_avg("engagement_rate"), 4).alias("avg_engagement_rate"),
        exact_avg("average_session_duration").alias("avg_session_duration"),
    )


def _ga_sums(users: bool = True) -> list[Column]:
    cols = [F.sum("sessions").alias("sessions")]
    if users:
        cols.append(F.sum("total_users").alias("users"))
    return [*cols, F.sum("conversions").alias("conversions"), money_sum("purchase_revenue").alias("revenue")]


def ga_trend(ga4: DataFrame, d0, d1) -> DataFrame:
    return in_dates(ga4, "date", d0, d1).groupBy("date").agg(*_ga_sums())


def ga_channels(ga4: DataFrame, d0, d1) -> DataFrame:
    return (
        in_dates(ga4, "date", d0, d1)
        .groupBy(F.col("session_default_channel_group").alias("channel"))
        .agg(*_ga_sums())
        .withColumn("channel", F.coalesce(not_empty("channel"), F.lit(NOT_SET)))
        .orderBy(F.desc("sessions"), "channel")
    )


def ga_sources(ga4: DataFrame, d0, d1, k: int = 15) -> DataFrame:
    return (
        in_dates(ga4, "date", d0, d1)
        .groupBy(F.col("session_source_medium").alias("source_medium"))
        .agg(*_ga_sums(users=False))
        .orderBy(F.desc("sessions"), F.asc_nulls_first("source_medium"))
        .limit(k)
        .withColumn("source_medium", F.coalesce(not_empty("source_medium"), F.lit(NOT_SET)))
    )


def funnel(kpis: DataFrame) -> DataFrame:
    """Cart share, cart abandonment and purchase share (at most 100), in percent."""
    users = F.greatest("total_users", F.lit(1))
    carts = F.greatest("add_to_carts", F.lit(1))
    return kpis.select(
        (F.col("add_to_carts") / users * 100).alias("cart_rate"),
        ((1 - F.col("ecommerce_purchases") / carts) * 100).alias("abandonment_rate"),
        F.least(F.col("ecommerce_purchases") / users * 100, F.lit(100.0)).alias("purchase_rate"),
    )


# --- search ---------------------------------------------------------------------------

def gsc_simple(gsc: DataFrame, d0=None, d1=None) -> DataFrame:
    """Daily trend with plain means of rate and position."""
    kept = in_dates(gsc, "date", d0, d1) if d0 and d1 else gsc
    return kept.groupBy("date").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        exact_avg("ctr", 12).alias("ctr"), exact_avg("position").alias("position"),
    )


def _search(rows: DataFrame, *keys: str) -> DataFrame:
    """Clicks, impressions, rate in percent and weighted position (0 without impressions)."""
    return (
        rows.groupBy(*keys)
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
             wavg("position", "impressions").alias("position"))
        .withColumn("ctr", pct0("clicks", "impressions"))
        .withColumn("position", F.coalesce("position", F.lit(0.0)))
    )


def gsc_trend(gsc: DataFrame, d0, d1) -> DataFrame:
    return _search(in_dates(gsc, "date", d0, d1), "date")


def gsc_kpis(trend: DataFrame) -> DataFrame:
    """Totals of the daily trend; a day without a position counts 0 in the weighted mean."""
    return (
        trend.agg(
            F.coalesce(F.sum("clicks"), F.lit(0)).alias("total_clicks"),
            F.coalesce(F.sum("impressions"), F.lit(0)).alias("total_impressions"),
            F.sum(F.col("position") * F.col("impressions")).alias("_w"),
        )
        .withColumn("ctr", pct0("total_clicks", "total_impressions"))
        .withColumn("avg_position", div0("_w", "total_impressions"))
        .drop("_w")
    )


def gsc_top(gsc: DataFrame, dim: str, d0, d1, k: int) -> DataFrame:
    """Top queries or pages by clicks."""
    return _search(in_dates(gsc, "date", d0, d1), dim).orderBy(F.desc("clicks"), dim).limit(k)


def product_seo_trend(gsc: DataFrame, products: DataFrame, product_id: int, d0, d1) -> DataFrame:
    return _search(product_pages(in_dates(gsc, "date", d0, d1), products, product_id), "date")


def product_seo_queries(gsc: DataFrame, products: DataFrame, product_id: int, d0, d1, k: int = 20) -> DataFrame:
    rows = product_pages(in_dates(gsc, "date", d0, d1), products, product_id)
    return _search(rows, "query").orderBy(F.desc("clicks"), F.desc("impressions"), "query").limit(k)


def site_benchmark(gsc: DataFrame, d0, d1) -> DataFrame:
    """Site-wide rate in percent and weighted position; null without impressions."""
    return in_dates(gsc, "date", d0, d1).agg(
        (safe_div(F.sum("clicks"), F.sum("impressions")) * 100).alias("site_ctr"),
        wavg("position", "impressions").alias("site_position"),
    )


def seo_record(gsc: DataFrame, products: DataFrame, product_id: int, d0, d1, site: str, k: int = 10) -> DataFrame:
    """Product card, its top ``k`` queries as an array and the site benchmark, in one row."""
    top = product_seo_queries(gsc, products, product_id, d0, d1, k)
    queries = top.agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("clicks")).alias("_c"), (-F.col("impressions")).alias("_i"), "query", "clicks", "impressions",
            "position", "ctr"))).alias("q")
    ).select(F.transform("q", lambda r: r.dropFields("_c", "_i"))).scalar()
    bench = site_benchmark(gsc, d0, d1).select(F.struct(
        F.coalesce("site_ctr", F.lit(0.0)).alias("site_ctr"),
        F.coalesce("site_position", F.lit(0.0)).alias("site_position"))).scalar()
    card = product_seo_card(products, gsc, product_id, d0, d1)
    return card.select(
        "title", "handle",
        F.concat(F.lit(f"https://{site}/products/"), "handle").alias("url"),
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
        pct0("clicks", "impressions").alias("ctr"),
        F.coalesce("avg_position", F.lit(0.0)).alias("position"),
        queries.alias("queries"), bench.alias("benchmark"),
    )


def product_urls(gsc: DataFrame, k: int = 5) -> DataFrame:
    """Product addresses by impressions."""
    return (
        gsc.where(F.col("page").contains("/products/")).groupBy("page").agg(F.sum("impressions").alias("imp"))
        .orderBy(F.desc("imp"), "page").limit(k)
    )


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("rows"))


# --- paid ads -------------------------------------------------------------------------

MICROS = 1_000_000.0
REMOVED = "REMOVED"


def is_purchase(category: str | Column) -> Column:
    """Purchase conversions carry category 4 or its name; all others are micro-conversions."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(c.cast("string").isin("4", "PURCHASE"), F.lit(False))


def _removed(ads: DataFrame) -> DataFrame:
    """Campaigns that are removed on their latest day."""
    gone = F.max(F.when(F.col("status") == REMOVED, F.col("date")))
    return ads.groupBy("campaign_id").agg(F.max("date").alias("last"), gone.alias("gone")).where("last = gone").select("campaign_id")


def _live(ads: DataFrame, d0, d1) -> DataFrame:
    """All days in the range of campaigns that are not removed."""
    return in_dates(ads, "date", d0, d1).join(_removed(ads), "campaign_id", "left_anti")


def _counted(conv: DataFrame, ads: DataFrame, d0, d1) -> DataFrame:
    """Conversions above 0 of campaigns that are not removed."""
    kept = in_dates(conv, "date", d0, d1).where(F.col("conversions") > 0)
    return kept.join(_removed(ads), "campaign_id", "left_anti").withColumn("purchase", is_purchase("category"))


def _split(prefix_value: bool = True) -> list[Column]:
    bought = F.col("purchase")
    out = [
        F.sum(F.when(bought, F.col("conversions").cast("decimal(24,6)"))).cast("double").alias("purchases"),
        F.sum(F.when(~bought, F.col("conversions").cast("decimal(24,6)"))).cast("double").alias("micro"),
    ]
    if prefix_value:
        out.append(money_sum(F.when(bought, F.col("conversions_value"))).alias("purchases_value"))
    return out


def ads_kpis(ads: DataFrame, conv: DataFrame, d0, d1) -> DataFrame:
    """Spend, clicks, conversions and their ratios, 0 on an empty denominator, money to cents."""
    spend = _live(ads, d0, d1).agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        (F.coalesce(F.sum("cost_micros"), F.lit(0)) / MICROS).alias("cost"),
    )
    won = _counted(conv, ads, d0, d1).agg(F.struct(
        *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(_split(), ("purchases", "micro", "value"))])).scalar()
    cents = lambda c: js_round(c, 2)
    return spend.withColumn("w", won).select(
        "impressions", "clicks",
        div0("clicks", "impressions").alias("ctr"),
        cents(div0("cost", "clicks")).alias("avg_cpc"),
        cents(F.col("cost")).alias("total_cost"),
        F.col("w.purchases").alias("conversions"),
        cents(div0("cost", F.col("w.purchases"))).alias("cost_per_purchase"),
        cents(div0("cost", F.col("w.micro"))).alias("cost_per_micro_conversion"),
        cents(F.col("w.value")).alias("conversions_value"),
        cents(div0(F.col("w.value"), "cost")).alias("roas"),
    )


def ads_trend(ads: DataFrame, conv: DataFrame, d0, d1) -> DataFrame:
    """Daily spend and purchases; days with only one of them are kept."""
    spend = _live(ads, d0, d1).groupBy("date").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("cost_micros").alias("micros"),
    )
    bought = _counted(conv, ads, d0, d1).where("purchase").groupBy("date").agg(
        F.sum(F.col("conversions").cast("decimal(24,6)")).cast("double").alias("conversions")
    )
    return spend.join(bought, "date", "full_outer").select(
        "date",
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
        js_round(F.coalesce("micros", F.lit(0)) / MICROS, 2).alias("cost"),
        F.coalesce("conversions", F.lit(0.0)).alias("conversions"),
    )


def ads_campaigns(ads: DataFrame, conv: DataFrame, d0, d1) -> DataFrame:
    """Spend and conversions per campaign, highest spend first."""
    spend = _live(ads, d0, d1).groupBy("campaign_id").agg(
        F.min("campaign_name").alias("campaign_name"), F.min("status").alias("status"),
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        (F.sum("cost_micros") / MICROS).alias("cost"),
    )
    won = _counted(conv, ads, d0, d1).groupBy("campaign_id").agg(*_split())
    return (
        spend.join(won, "campaign_id", "left")
        .fillna(0.0, subset=["purchases", "micro", "purchases_value"])
        .select(
            "campaign_id", "campaign_name", "status", "impressions", "clicks",
            div0("clicks", "impressions").alias("ctr"),
            div0("cost", "clicks").alias("avg_cpc"),
            "cost",
            F.col("purchases").alias("conversions"),
            div0("cost", "purchases").alias("cost_per_purchase"),
            div0("cost", "micro").alias("cost_per_micro_conversion"),
            div0("purchases_value", "cost").alias("roas"),
        )
        .orderBy(F.desc("cost"), "campaign_id")
    )


# Separator inside conversion action names, and the prefix left out.
ACTION_SEPARATOR = " || "
ACTION_PREFIX = "Google Ads || "


def action_label(name: str | Column, width: int | None = None) -> Column:
    """Readable part of a conversion action name."""
    c = F.col(name) if isinstance(name, str) else name
    at = F.instr(c, ACTION_PREFIX)
    rest = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(ACTION_PREFIX), F.length(c))))
    label = F.substring_index(rest.otherwise(c), ACTION_SEPARATOR, 1)
    return label if width is None else F.substring(label, 1, width)


def ads_breakdown(ads: DataFrame, conv: DataFrame, d0, d1, level: Sequence[str] = ()) -> DataFrame:
    """Conversions and value per action and kind, for the account or per ``level`` column."""
    name = F.coalesce("action_name", F.lit("Unknown")).alias("action_name")
    return (
        _counted(conv, ads, d0, d1)
        .groupBy(*level, "purchase", name)
        .agg(F.sum(F.col("conversions").cast("decimal(24,6)")).cast("double").alias("conversions"),
             money_sum("conversions_value").alias("value"))
        .where("conversions > 0")
        .withColumn("label", action_label("action_name"))
        .orderBy(F.desc("conversions"), *level, "purchase", "action_name")
    )


def conversions_by_action(conv: DataFrame, d0, d1) -> DataFrame:
    """Conversions per action name; the category is any one of the action's (the least)."""
    return (
        in_dates(conv, "date", d0, d1).where("conversions > 0").groupBy("action_name")
        .agg(F.min("category").alias("category"),
             F.sum(F.col("conversions").cast("decimal(24,6)")).cast("double").alias("conversions"))
    )
