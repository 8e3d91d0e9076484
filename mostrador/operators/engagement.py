"""E-mail marketing and product reviews."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bounds, day, in_range, ts_literal
from ..functions.exprs import count_where, div0, js_round, money_sum, non_blank, pct0, sum_where

# The metrics the reports read.
ORDERED, OPENED, CLICKED, RECEIVED = "Placed Order", "Opened Email", "Clicked Email", "Received Email"


def email_daily(metrics: DataFrame, d0, d1) -> DataFrame:
    return (
        in_range(metrics, "date", d0, d1)
        .groupBy(day("date").alias("day"), "metric_name")
        .agg(F.sum("count").alias("total_count"), money_sum("sum_value").alias("total_value"))
    )


def _count_of(metric: str):
    return F.sum(F.when(F.col("metric_name") == metric, F.col("count")).otherwise(F.lit(0)))


def _measures():
    return [
        sum_where(F.col("metric_name") == ORDERED, "sum_value").alias("revenue"),
        _count_of(ORDERED).alias("orders"), _count_of(OPENED).alias("opens"),
        _count_of(CLICKED).alias("clicks"), _count_of(RECEIVED).alias("received"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("cr", pct0("clicks", "received"))
        .withColumn("ctor", pct0("clicks", "opens"))
        .withColumn("order_rate", pct0("orders", "clicks"))
        .withColumn("aov", div0("revenue", "orders"))
    )


def email_trend(metrics: DataFrame, d0, d1) -> DataFrame:
    """Revenue, opens and clicks per day; days with none of them show zeros. Like the period
    figures, a row belongs to the range by its day."""
    lo, hi = bounds(d0, d1)
    rows = in_range(metrics, "date", d0, d1).where(_midnight().between(ts_literal(lo), ts_literal(hi)))
    return (
        rows.groupBy(day("date").alias("date"))
        .agg(*_measures()).select("date", "revenue", "opens", "clicks")
    )


def _midnight():
    return day("date").cast("timestamp_ntz")


def previous_range(d0, d1):
    """The range shifted back by its duration plus one millisecond."""
    lo, hi = bounds(d0, d1)
    shift = (hi - lo) + timedelta(milliseconds=1)
    return lo - shift, hi - shift


def email_periods(metrics: DataFrame, d0, d1) -> DataFrame:
    """Measures and rates of the current and the previous period, one row each.

    A row belongs to a period by its day, as in the report this reproduces.
    """
    p0, p1 = previous_range(d0, d1)
    lo, hi = bounds(d0, d1)
    at = _midnight()
    period = F.when(at.between(ts_literal(lo), ts_literal(hi)), F.lit("current")).when(
        at.between(ts_literal(p0), ts_literal(p1)), F.lit("previous")
    )
    rows = in_range(metrics, "date", p0, hi).withColumn("period", period).where(F.col("period").isNotNull())
    both = rows.groupBy().pivot("period", ["current", "previous"]).agg(*_measures())
    names = ["revenue", "orders", "opens", "clicks", "received"]
    # A period without rows counts zero.
    pairs = ", ".join(
        f"'{p}', " + ", ".join(f"coalesce({p}_{n}, 0{'D' if n == 'revenue' else 'L'})" for n in names)
        for p in ("current", "previous")
    )
    return _rates(both.selectExpr(f"stack(2, {pairs}) as (period, {', '.join(names)})"))


def email_deltas(periods: DataFrame) -> DataFrame:
    """Percent change of amounts, point difference of rates."""

    def value(name, period):
        return F.max(F.when(F.col("period") == period, F.col(name)))

    names = ["revenue", "cr", "ctor", "order_rate", "aov"]
    wide = periods.agg(*[value(n, p).alias(f"{n}_{p}") for n in names for p in ("current", "previous")])

    def change(n):
        cur, prev = F.col(f"{n}_current"), F.col(f"{n}_previous")
        return F.when(prev == 0, F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise((cur - prev) / prev * 100)

    def points(n):
        return F.col(f"{n}_current") - F.col(f"{n}_previous")

    return wide.select(
        change("revenue").alias("revenue"), points("cr").alias("cr"), points("ctor").alias("ctor"),
        points("order_rate").alias("order_rate"), change("aov").alias("aov"),
    )


def email_attribution(metrics: DataFrame, d0, d1, scope: str = "current") -> DataFrame:
    """Measures per flow or campaign; a flow name wins over a campaign name.

    ``scope='both'`` sums the previous period in as well, as the report this reproduces
    does; ``'current'`` keeps to the range.
    """
    start = previous_range(d0, d1)[0] if scope == "both" else d0
    kind = F.when(non_blank("flow_name"), F.lit("flow")).when(non_blank("campaign_name"), F.lit("campaign"))
    rows = (
        in_range(metrics, "date", start, d1)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("name", F.when(F.col("kind") == "flow", F.col("flow_name")).otherwise(F.col("campaign_name")))
    )
    items = _rates(rows.groupBy("kind", "name").agg(*_measures()))
    best = items.groupBy("kind").agg(F.max("revenue").alias("_best"))
    return (
        items.join(best, "kind").withColumn("revenue_share", pct0("revenue", "_best")).drop("_best")
        .orderBy("kind", F.desc("revenue"), "name")
    )


def campaign_totals(metrics: DataFrame) -> DataFrame:
    return (
        metrics.where(F.col("campaign_name") != "").groupBy("campaign_name", "metric_name")
        .agg(F.sum("count").alias("total"))
    )


def email_headline(metrics: DataFrame, d0, d1, metric: str = ORDERED) -> DataFrame:
    return in_range(metrics, "date", d0, d1).where(F.col("metric_name") == metric).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_orders"),
        F.coalesce(money_sum("sum_value"), F.lit(0.0)).alias("total_revenue"),
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    """Totals by state, mean of published scores, star counts and share of 4 and 5 stars."""
    published = F.col("status") == "published"
    return (
        reviews.agg(
            F.count("review_id").alias("total_reviews"),
            count_where(published).alias("published_reviews"),
            count_where(F.col("status") == "pending").alias("pending_reviews"),
            F.avg(F.when(published, F.col("score"))).alias("average_rating"),
            *[count_where(published & (F.col("score") == s)).alias(f"stars_{s}") for s in (5, 4, 3, 2, 1)],
        )
        .withColumn("average_rating", F.coalesce("average_rating", F.lit(0.0)))
        .withColumn("sentiment_score", js_round(pct0(F.col("stars_5") + F.col("stars_4"), "published_reviews")))
    )


def star_histogram(summary: DataFrame) -> DataFrame:
    return summary.selectExpr("stack(5, " + ", ".join(f"{s}, stars_{s}" for s in (5, 4, 3, 2, 1)) + ") as (stars, reviews)")


def product_sentiment(lines: DataFrame, variants: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Units and revenue per sku beside its reviews.

    Lines carry no sku, so it is taken from the variant; lines are summed per variant and
    product before that lookup. Without reviews the counts are 0 and the votes null.
    """
    scored = reviews.groupBy(F.col("product_id").alias("sku")).agg(
        F.count("review_id").alias("total_reviews"), F.avg("score").alias("average_score"),
        F.sum("votes_up").alias("total_helpful_votes"),
    )
    per_variant = lines.groupBy("variant_id", "product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum((F.col("price") * F.col("quantity")).cast("decimal(18,2)")).alias("revenue"),
    )
    sales = (
        per_variant.join(variants.select(F.col("id").alias("variant_id"), "sku"), "variant_id", "left")
        .join(products.select(F.col("id").alias("product_id"), F.col("title").alias("product_name")), "product_id", "left")
        .groupBy("sku", "product_name")
        .agg(F.sum("units").alias("total_units_sold"), F.sum("revenue").cast("double").alias("gross_revenue"))
    )
    return (
        sales.join(scored, "sku", "left")
        .withColumn("total_reviews", F.coalesce("total_reviews", F.lit(0)))
        .withColumn("average_score", F.coalesce("average_score", F.lit(0.0)))
        .orderBy(F.desc("gross_revenue"), F.asc_nulls_first("sku"), F.asc_nulls_first("product_name"))
    )
