"""The places where a plausible reading of a report gives a wrong number."""

from datetime import date, datetime

from pyspark.sql import functions as F

from mostrador.functions.exprs import SOLD_NET, SOLD_PAID, SOLD_SCAN, sold
from mostrador.operators import engagement, joins, market, sales, series, support, traffic

T = datetime


def test_sold_sets_differ(spark):
    df = spark.createDataFrame([("paid",), ("partially_refunded",), ("partially_paid",), (None,)], "s string")
    for statuses, n in ((SOLD_NET, 2), (SOLD_PAID, 1), (SOLD_SCAN, 2)):
        assert df.where(sold("s", statuses)).count() == n


def test_null_status_is_in_no_bucket(spark):
    df = spark.createDataFrame([(1, T(2024, 1, 1), 5.0, 0.0, None), (2, T(2024, 1, 1), 5.0, 0.0, "voided")],
                               "id long, created_at timestamp_ntz, total_price double, total_discounts double, financial_status string")
    row = sales.sales_daily(df).first()
    assert (row.gross_orders, row.other_count, row.paid_count, row.net_sales) == (2, 1, 0, 0.0)


def test_price_gap_signs(spark):
    df = spark.createDataFrame([(100.0, 80.0), (100.0, 120.0), (0.0, 50.0), (100.0, 0.0)], "our_price double, competitor_price double")
    batch = [(r.price_diff_amount, r.price_diff_pct, r.is_competitive) for r in market.price_gap(df).collect()]
    assert batch == [(20.0, 25.0, False), (-20.0, -16.67, True), (-50.0, -100.0, True), (100.0, 0.0, False)]
    live = [(r.diff_amount, r.diff_pct, r.is_competitive_live) for r in market.price_gap_live(df).collect()]
    assert live == [(-20.0, -20.0, False), (20.0, 20.0, True), (None, None, None), (-100.0, None, None)]


def test_attribution_scope(spark):
    rows = [(T(2024, 1, 2), "Placed Order", "C", "", 1, 10.0), (T(2024, 1, 9), "Placed Order", "C", " ", 2, 30.0)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, metric_name string, campaign_name string, flow_name string, count long, sum_value double")
    assert engagement.email_attribution(df, "2024-01-08", "2024-01-14").first().revenue == 30.0
    assert engagement.email_attribution(df, "2024-01-08", "2024-01-14", "both").first().revenue == 40.0


def test_price_stats_fan_out(spark):
    lines = spark.createDataFrame([(1, 1, 7, "t", 2)], "id long, order_id long, product_id long, title string, quantity long")
    orders = spark.createDataFrame([(1, T(2024, 1, 1), "paid")], "id long, created_at timestamp_ntz, financial_status string")
    prices = spark.createDataFrame([(7, 10.0, 8.0), (7, 11.0, 9.0), (7, 11.0, 13.0)], "product_id long, our_price double, competitor_price double")
    rows = market.top20_prices(lines, orders, prices, "2024-01-20").orderBy("our_price").collect()
    assert [(r.our_price, r.avg_competitor_price, r.diff_pct) for r in rows] == [(10.0, 8.0, 25.0), (11.0, 11.0, 0.0)]


def test_latest_signal_keeps_ties_and_other_types(spark):
    rows = [("a", "brand", date(2024, 1, 1)), ("a", "brand", date(2024, 1, 8)), ("a", "brand", date(2024, 1, 8)),
            ("a", "product", date(2024, 1, 8)), ("a", "product", date(2024, 1, 15))]
    df = spark.createDataFrame(rows, "keyword string, keyword_type string, trend_date date")
    assert sorted(r.keyword_type for r in joins.latest_signal(df).collect()) == ["brand", "brand", "product"]


def test_contacts_follow_session_order(spark):
    # The smaller session id is the later conversation.
    rows = [("s1", T(2024, 1, 2), "chat", "p"), ("s2", T(2024, 1, 1), "email", "p")]
    df = spark.createDataFrame([(*r, "n", None, None) for r in rows],
                               "session_id string, created_at timestamp_ntz, channel_origin string, people_id string, visitor_nickname string, visitor_email string, visitor_phone string")
    r = support.omnichannel_duplicates(df).first()
    assert (r.first_contact, r.last_contact, r.latest_session_id) == (T(2024, 1, 2), T(2024, 1, 1), "s1")


def test_missing_vendor_and_placeholder_stay_apart(spark):
    lines = spark.createDataFrame([(1, 1, 1, "t", None, 1, 5.0), (2, 1, 2, "t", "Desconocido", 1, 4.0)],
                                  "id long, order_id long, product_id long, title string, vendor string, quantity long, price double")
    orders = spark.createDataFrame([(1, T(2024, 1, 1), "paid")], "id long, created_at timestamp_ntz, financial_status string")
    rows = sales.top_brands(lines, orders, "2024-01-01", "2024-01-02").collect()
    assert [(r.brand, r.gross_revenue) for r in rows] == [("Desconocido", 5.0), ("Desconocido", 4.0)]


def test_prefix_handles(spark):
    pages = ["https://s/products/mini", "https://s/products/mini-pro", "https://s/products/mini?x=1", "https://s/products/mini/reviews",
             "https://s/products/mini#a", "https://s/c/products/other/products/mini"]
    gsc = spark.createDataFrame([(date(2024, 1, 1), p, "q", 1, 10, float(i + 1)) for i, p in enumerate(pages)],
                                "date date, page string, query string, clicks long, impressions long, position double")
    products = spark.createDataFrame([(1, "mini", "t", "v"), (2, "none", "t", "v")], "id long, handle string, title string, vendor string")
    exact = {r.id: r.seo_position for r in joins.seo_position(products, gsc, "2024-01-01", "2024-01-01").collect()}
    assert exact == {1: (1 + 3 + 4 + 6) / 4, 2: None}
    assert joins.product_pages(gsc, products, 1).count() == 6
    assert joins.product_pages_all(gsc, products).count() == 6


def test_zero_denominators(spark):
    daily = spark.createDataFrame([], "date date, total_sessions long, unique_visitors long, pageviews long, bounce_rate double, orders long")
    r = traffic.traffic_kpis(daily).first()
    assert (r.total_sessions, r.avg_bounce_rate, r.avg_conversion_rate, r.pages_per_session) == (0, 0.0, 0.0, 0.0)
    kpis = spark.createDataFrame([(0, 0, 3)], "total_users long, add_to_carts long, ecommerce_purchases long")
    f = traffic.funnel(kpis).first()
    assert (f.cart_rate, f.abandonment_rate, f.purchase_rate) == (0.0, -200.0, 100.0)


def test_sku_comes_from_the_variant(spark):
    lines = spark.createDataFrame([(10, 1, 2, 5.0)], "variant_id long, product_id long, quantity long, price double")
    variants = spark.createDataFrame([(10, "SKU")], "id long, sku string")
    products = spark.createDataFrame([(1, "name")], "id long, title string")
    reviews = spark.createDataFrame([(1, "SKU", 4, 1), (2, "SKU", 5, 2)], "review_id long, product_id string, score long, votes_up long")
    r = engagement.product_sentiment(lines, variants, products, reviews).first()
    assert (r.sku, r.gross_revenue, r.total_reviews, r.average_score, r.total_helpful_votes) == ("SKU", 10.0, 2, 4.5, 3)


SIGNALS = {
    "short": ([1, 2, 3], "stable", "Datos insuficientes para calcular señal."),
    "breakout": ([10, 10, 10, 10, 60, 80, 90, 95], "breakout", "Demanda explosiva: índice 95/100. Considera restock urgente o campaña de Ads."),
    "risk": ([5, 5, 5, 5, 6, 6, 6, 6], "risk", "Demanda muy baja (6/100 promedio). Riesgo de inventario muerto."),
    "rising": ([20, 20, 20, 20, 30, 30, 28, 40], "rising", "Tendencia al alza: +60% en últimas 4 semanas."),
    "not_rising": ([20, 20, 20, 20, 40, 20, 30, 38], "stable", "Demanda estable. Índice promedio: 32/100."),
    "falling": ([50, 50, 50, 50, 30, 32, 30, 28], "falling", "Tendencia a la baja: -40% en últimas 4 semanas."),
    "no_earlier": ([50, 50, 50, 50], "stable", "Demanda estable. Índice promedio: 50/100."),
    "short_earlier": ([20, 40, 40, 40, 40], "rising", "Tendencia al alza: +100% en últimas 4 semanas."),
    "zero_earlier": ([0, 0, 0, 0, 30, 30, 30, 30], "stable", "Demanda estable. Índice promedio: 30/100."),
}


def test_signals(spark):
    rows = [(k, i, v) for k, (vals, _, _) in SIGNALS.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k string, at int, v long")
    got = {r.k: (r.signal, r.signal_detail) for r in series.trend_signal(df, ["k"], "at", "v").collect()}
    assert got == {k: (s, d) for k, (_, s, d) in SIGNALS.items()}


def test_momentum_peak_and_season(spark):
    rows = [("a", date(2022 + y, m, 1), 10 + (50 if m == 12 else m)) for y in range(2) for m in range(1, 13)] + [("b", date(2022, 1, 1), 0)]
    df = spark.createDataFrame(rows, "term string, date date, value long")
    out = {r.term: r for r in series.compare_terms(df).collect()}
    assert (out["a"].peak_value, out["a"].peak_date) == (60, "2022-12-01")
    assert out["a"].months == "Sep, Oct, Nov, Dec"
    assert (out["b"].peak_value, out["b"].peak_date, out["b"].direction, out["b"].months) == (0, "", "neutral", "—")
    w = series.winner(spark.createDataFrame([("x", 1.0, 0), ("y", 2.0, 1), ("z", 2.0, 2)], "term string, value double, pos int")).first()
    assert w.winner == "y"
    assert series.winner(spark.createDataFrame([("x", 1.0, 0)], "term string, value double, pos int")).first().winner is None


def test_hours_in_a_zone(spark):
    calls = spark.createDataFrame([(T(2024, 1, 1, 2),)], "start_time timestamp_ntz")
    got = {r.hour: r.calls for r in support.call_hours(calls, "America/Santiago").where("calls > 0").collect()}
    assert got == {23: 1}


def test_totals_equal_their_trend(spark):
    from mostrador.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    kpi = sales.sales_kpis(t.shopify_orders, "1990-01-01", "2010-12-31").first()
    trend = sales.sales_trend(t.shopify_orders, "1990-01-01", "2010-12-31").agg(
        F.sum(F.col("net_sales").cast("decimal(18,2)")).cast("double").alias("net"), F.sum("orders").alias("n")).first()
    assert (kpi.net_sales, kpi.gross_order_count) == (trend.net, trend.n)
