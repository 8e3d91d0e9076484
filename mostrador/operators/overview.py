"""The shop overview across domains, as metric rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engagement, sales, support, traffic


def _rows(domain: str, one: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = ", ".join(f"'{metric}', cast({column} as double)" for column, metric in names.items())
    return one.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)").select(
        F.lit(domain).alias("domain"), "metric", "value")


def overview_metrics(orders: DataFrame, daily_traffic: DataFrame, email: DataFrame, conversations: DataFrame,
                     reviews: DataFrame, d0, d1, day0, day1) -> DataFrame:
    """Headline figures of sales, traffic, e-mail, support and reviews.

    Every domain is one aggregate row over its own table, so the union is as wide as the
    list of metrics and nothing is joined. Reviews cover all time.
    """
    days = traffic.traffic_daily(daily_traffic, orders, day0, day1)
    parts = [
        _rows("sales", sales.sales_kpis(orders, day0, day1), {"net_sales": "net_sales", "gross_order_count": "total_orders"}),
        _rows("traffic", traffic.traffic_kpis(days),
              {"total_sessions": "total_sessions", "avg_conversion_rate": "avg_conversion_rate"}),
        _rows("email", engagement.email_headline(email, d0, d1),
              {"total_orders": "total_orders", "total_revenue": "total_revenue"}),
        _rows("support", support.support_kpis(conversations, d0, d1),
              {c: c for c in ("total_conversations", "resolved_conversations", "avg_csat", "resolution_rate")}),
        _rows("reviews", engagement.review_summary(reviews),
              {c: c for c in ("total_reviews", "average_rating", "sentiment_score")}),
    ]
    return reduce(DataFrame.unionAll, parts)


def overview(orders: DataFrame, daily_traffic: DataFrame, email: DataFrame, conversations: DataFrame, reviews: DataFrame,
             audit: DataFrame, staff: DataFrame, d0, d1) -> dict[str, DataFrame]:
    """The overview's parts as independent plans."""
    from . import team

    return {
        "metrics": overview_metrics(orders, daily_traffic, email, conversations, reviews, d0, d1, d0, d1),
        "sales_trend": sales.sales_trend(orders, d0, d1).select("date", "net_sales"),
        "traffic_trend": traffic.traffic_daily(daily_traffic, orders, d0, d1).select("date", "total_sessions", "unique_visitors", "orders"),
        "top_staff": team.staff_totals(team.activity_daily(audit, staff, d0, d1), 5),
    }
