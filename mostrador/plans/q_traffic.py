"""Traffic, search, ads, e-mail and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engagement as eng
from ..operators import joins
from ..operators import traffic as trf
from .registry import D0, D1, E0, E1, NET, count_if, div0, js, money, money_if, pct0, query, safe, total, wavg

DAY = f"date BETWEEN DATE '{D0}' AND DATE '{D1}'"
EDAY = f"date BETWEEN DATE '{E0}' AND DATE '{E1}'"
PRODUCT = 17
HANDLE = f"(SELECT handle FROM shopify_products WHERE id = {PRODUCT})"
ITS_PAGES = f"contains(page, concat('/products/', {HANDLE})) AND {DAY}"

TRAFFIC = f"""SELECT t.date, t.total_sessions, t.unique_visitors, t.pageviews, t.bounce_rate, COUNT(o.id) AS orders,
  {pct0('COUNT(o.id)', 't.total_sessions')} AS conversion_rate
FROM shopify_traffic_daily t LEFT JOIN shopify_orders o ON CAST(o.created_at AS DATE) = t.date AND o.{NET}
WHERE t.{DAY} GROUP BY t.date, t.total_sessions, t.unique_visitors, t.pageviews, t.bounce_rate"""


@query("trf_01_traffic_daily", TRAFFIC, ["date"])
def _(t):
    return trf.traffic_daily(t.shopify_traffic_daily, t.shopify_orders, D0, D1)


@query("trf_02_traffic_kpis", f"""
WITH d AS ({TRAFFIC}), s AS (SELECT {total('total_sessions')} AS total_sessions, {total('unique_visitors')} AS unique_visitors,
  {total('pageviews')} AS pageviews, {total('orders')} AS orders, CAST(SUM(CAST(bounce_rate AS DECIMAL(24,6))) AS DOUBLE) / COUNT(*) AS avg_bounce_rate FROM d)
SELECT *, {pct0('orders', 'total_sessions')} AS avg_conversion_rate, {div0('pageviews', 'total_sessions')} AS pages_per_session FROM s""")
def _(t):
    return trf.traffic_kpis(trf.traffic_daily(t.shopify_traffic_daily, t.shopify_orders, D0, D1))


GA_KPIS = f"""SELECT {total('sessions')} AS total_sessions, {total('total_users')} AS total_users, {total('new_users')} AS new_users,
  {total('conversions')} AS conversions, {total('ecommerce_purchases')} AS ecommerce_purchases, {money('purchase_revenue')} AS purchase_revenue,
  {total('add_to_carts')} AS add_to_carts, round(AVG(engagement_rate), 4) AS avg_engagement_rate, AVG(average_session_duration) AS avg_session_duration
FROM raw_traffic_ga4 WHERE {EDAY}"""


@query("trf_03_ga_kpis", GA_KPIS)
def _(t):
    return trf.ga_kpis(t.raw_traffic_ga4, E0, E1)


GA_SUMS = f"{total('sessions')} AS sessions, {total('conversions')} AS conversions, {money('purchase_revenue')} AS revenue"


@query("trf_04_ga_trend", f"SELECT date, {total('total_users')} AS users, {GA_SUMS} FROM raw_traffic_ga4 WHERE {EDAY} GROUP BY date", ["date"])
def _(t):
    return trf.ga_trend(t.raw_traffic_ga4, E0, E1)


@query("trf_05_ga_channels", f"""
SELECT COALESCE(NULLIF(session_default_channel_group, ''), '(Not Set)') AS channel, {total('total_users')} AS users, {GA_SUMS}
FROM raw_traffic_ga4 WHERE {EDAY} GROUP BY session_default_channel_group""")
def _(t):
    return trf.ga_channels(t.raw_traffic_ga4, E0, E1)


@query("trf_06_ga_sources", f"""
SELECT session_source_medium AS source_medium, {GA_SUMS} FROM raw_traffic_ga4 WHERE {EDAY} GROUP BY 1
ORDER BY sessions DESC, source_medium NULLS FIRST LIMIT 15""")
def _(t):
    return trf.ga_sources(t.raw_traffic_ga4, E0, E1)


@query("trf_07_funnel", f"""
WITH k AS ({GA_KPIS}) SELECT CAST(add_to_carts AS DOUBLE) / greatest(total_users, 1) * 100e0 AS cart_rate,
 (1e0 - CAST(ecommerce_purchases AS DOUBLE) / greatest(add_to_carts, 1)) * 100e0 AS abandonment_rate,
 least(CAST(ecommerce_purchases AS DOUBLE) / greatest(total_users, 1) * 100e0, 100e0) AS purchase_rate FROM k""")
def _(t):
    return trf.funnel(trf.ga_kpis(t.raw_traffic_ga4, E0, E1))


MARKETING = f"""
WITH g AS (SELECT date, session_default_channel_group AS channel, session_source_medium AS source_medium, campaign_name,
  {total('sessions')} AS sessions, {total('conversions')} AS conversions, {money('purchase_revenue')} AS ga4_revenue FROM raw_traffic_ga4 GROUP BY 1, 2, 3, 4),
e AS (SELECT CAST(date AS DATE) AS date, {total("CASE WHEN metric_name = 'Opened Email' THEN count ELSE 0 END")} AS related_emails_opened,
  {total("CASE WHEN metric_name = 'Clicked Email' THEN count ELSE 0 END")} AS related_emails_clicked,
  {money_if("metric_name = 'Placed Order'", 'sum_value')} AS related_klaviyo_revenue FROM klaviyo_metrics GROUP BY 1)
SELECT g.*, e.related_emails_opened, e.related_emails_clicked, e.related_klaviyo_revenue FROM g LEFT JOIN e ON g.date = e.date AND g.channel = 'Email'"""


@query("trf_08_marketing_mart", MARKETING, ["date"])
def _(t):
    return joins.marketing_traffic(t.raw_traffic_ga4, t.klaviyo_metrics)


# --- search ---------------------------------------------------------------------------

@query("seo_01_gsc_simple", f"""
SELECT date, {total('clicks')} AS clicks, {total('impressions')} AS impressions, round(AVG(ctr), 8) AS ctr, AVG(position) AS position
FROM gsc_metrics GROUP BY date""", ["date"])
def _(t):
    return trf.gsc_simple(t.gsc_metrics).withColumn("ctr", F.round("ctr", 8))


def search_sql(dim, where=DAY, tail=""):
    return f"""SELECT {dim}, {total('clicks')} AS clicks, {total('impressions')} AS impressions, COALESCE({wavg('position', 'impressions')}, 0e0) AS position,
  {pct0('SUM(clicks)', 'SUM(impressions)')} AS ctr FROM gsc_metrics WHERE {where} GROUP BY {dim} {tail}"""


@query("seo_02_gsc_trend", search_sql("date"), ["date"])
def _(t):
    return trf.gsc_trend(t.gsc_metrics, D0, D1)


@query("seo_03_gsc_kpis", f"""
WITH d AS ({search_sql('date')}), s AS (SELECT {total('clicks')} AS total_clicks, {total('impressions')} AS total_impressions, SUM(position * impressions) AS w FROM d)
SELECT total_clicks, total_impressions, {pct0('total_clicks', 'total_impressions')} AS ctr, round({div0('w', 'total_impressions')}, 9) AS avg_position FROM s""")
def _(t):
    return trf.gsc_kpis(trf.gsc_trend(t.gsc_metrics, D0, D1)).withColumn("avg_position", F.round("avg_position", 9))


@query("seo_04_top_queries", search_sql("query", tail="ORDER BY clicks DESC, query LIMIT 100"))
def _(t):
    return trf.gsc_top(t.gsc_metrics, "query", D0, D1, 100)


@query("seo_04_top_pages", search_sql("page", tail="ORDER BY clicks DESC, page LIMIT 50"))
def _(t):
    return trf.gsc_top(t.gsc_metrics, "page", D0, D1, 50)


@query("seo_05_product_trend", search_sql("date", ITS_PAGES), ["date"])
def _(t):
    return trf.product_seo_trend(t.gsc_metrics, t.shopify_products, PRODUCT, D0, D1)


@query("seo_05_product_kpis", f"""
WITH d AS ({search_sql('date', ITS_PAGES)}), s AS (SELECT {total('clicks')} AS total_clicks, {total('impressions')} AS total_impressions, SUM(position * impressions) AS w FROM d)
SELECT total_clicks, total_impressions, {pct0('total_clicks', 'total_impressions')} AS ctr, round({div0('w', 'total_impressions')}, 9) AS avg_position FROM s""")
def _(t):
    daily = trf.product_seo_trend(t.gsc_metrics, t.shopify_products, PRODUCT, D0, D1)
    return trf.gsc_kpis(daily).withColumn("avg_position", F.round("avg_position", 9))


@query("seo_06_product_queries", search_sql("query", ITS_PAGES, "ORDER BY clicks DESC, impressions DESC, query LIMIT 20"))
def _(t):
    return trf.product_seo_queries(t.gsc_metrics, t.shopify_products, PRODUCT, D0, D1)


BENCH = f"""SELECT {safe('SUM(clicks)', 'SUM(impressions)')} * 100e0 AS site_ctr, {wavg('position', 'impressions')} AS site_position FROM gsc_metrics WHERE {DAY}"""


@query("seo_07_site_benchmark", BENCH)
def _(t):
    return trf.site_benchmark(t.gsc_metrics, D0, D1)


CARD = f"""SELECT p.title, p.handle, p.vendor, {total('clicks')} AS clicks, {total('impressions')} AS impressions, {wavg('position', 'impressions')} AS avg_position
FROM (SELECT * FROM shopify_products WHERE id = {PRODUCT}) p, (SELECT * FROM gsc_metrics WHERE {ITS_PAGES}) g GROUP BY p.title, p.handle, p.vendor"""


@query("seo_08_seo_record", f"""
WITH c AS ({CARD}), b AS ({BENCH}), q AS ({search_sql('query', ITS_PAGES, 'ORDER BY clicks DESC, impressions DESC, query LIMIT 10')})
SELECT c.title, c.handle, concat('https://shop.example/products/', c.handle) AS url, c.clicks, c.impressions, {pct0('c.clicks', 'c.impressions')} AS ctr,
  COALESCE(c.avg_position, 0e0) AS position, (SELECT string_agg(concat(query, ':', CAST(clicks AS VARCHAR), ':', CAST(impressions AS VARCHAR)), '|' ORDER BY clicks DESC, impressions DESC, query) FROM q) AS queries,
  b.site_ctr, b.site_position FROM c, b""")
def _(t):
    rec = trf.seo_record(t.gsc_metrics, t.shopify_products, PRODUCT, D0, D1, "shop.example")
    shown = F.transform("queries", lambda r: F.concat_ws(":", r["query"], r["clicks"], r["impressions"]))
    return rec.withColumn("queries", F.array_join(shown, "|")).select("*", "benchmark.*").drop("benchmark")


@query("seo_09_product_urls", f"SELECT page, {total('impressions')} AS imp FROM gsc_metrics WHERE page LIKE '%/products/%' GROUP BY page ORDER BY imp DESC, page LIMIT 5")
def _(t):
    return trf.product_urls(t.gsc_metrics)


@query("seo_09_coverage", "SELECT MIN(date) AS first, MAX(date) AS last, COUNT(*) AS rows FROM gsc_metrics", ["first", "last"])
def _(t):
    return trf.coverage(t.gsc_metrics, "date")


# --- ads ------------------------------------------------------------------------------

GONE = """(SELECT campaign_id FROM ads_campaign_daily GROUP BY campaign_id
  HAVING MAX(date) = MAX(CASE WHEN status = 'REMOVED' THEN date END))"""
ADS = f"(SELECT * FROM ads_campaign_daily WHERE {DAY} AND campaign_id NOT IN {GONE})"
CONV = f"""(SELECT *, category IN ('4', 'PURCHASE') AS purchase FROM ads_conversions WHERE {DAY} AND conversions > 0
  AND campaign_id NOT IN {GONE})"""
WON = """SUM(CASE WHEN purchase THEN conversions END) AS purchases, SUM(CASE WHEN NOT purchase THEN conversions END) AS micro,
  SUM(CASE WHEN purchase THEN conversions_value END) AS value"""


@query("ads_01_kpis", f"""
WITH s AS (SELECT {total('impressions')} AS impressions, {total('clicks')} AS clicks, CAST(SUM(cost_micros) AS DOUBLE) / 1e6 AS cost FROM {ADS} a),
w AS (SELECT {WON} FROM {CONV} c)
SELECT impressions, clicks, {div0('clicks', 'impressions')} AS ctr, {js(div0('cost', 'clicks'), 2)} AS avg_cpc, {js('cost', 2)} AS total_cost,
  purchases AS conversions, {js(div0('cost', 'purchases'), 2)} AS cost_per_purchase, {js(div0('cost', 'micro'), 2)} AS cost_per_micro_conversion,
  {js('value', 2)} AS conversions_value, {js(div0('value', 'cost'), 2)} AS roas FROM s, w""")
def _(t):
    return trf.ads_kpis(t.ads_campaign_daily, t.ads_conversions, D0, D1)


@query("ads_02_purchase_split", f"""
SELECT category, category IN ('4', 'PURCHASE') AS purchase, SUM(conversions) AS conversions FROM ads_conversions GROUP BY 1, 2""")
def _(t):
    return t.ads_conversions.groupBy("category", trf.is_purchase("category").alias("purchase")).agg(
        F.sum("conversions").alias("conversions"))


@query("ads_03_trend", f"""
WITH s AS (SELECT date, {total('impressions')} AS impressions, {total('clicks')} AS clicks, SUM(cost_micros) AS micros FROM {ADS} a GROUP BY date),
c AS (SELECT date, SUM(conversions) AS conversions FROM {CONV} c WHERE purchase GROUP BY date)
SELECT COALESCE(s.date, c.date) AS date, COALESCE(impressions, 0) AS impressions, COALESCE(clicks, 0) AS clicks,
  {js('COALESCE(CAST(micros AS DOUBLE), 0e0) / 1e6', 2)} AS cost, COALESCE(conversions, 0e0) AS conversions FROM s FULL OUTER JOIN c ON s.date = c.date""", ["date"])
def _(t):
    return trf.ads_trend(t.ads_campaign_daily, t.ads_conversions, D0, D1)


@query("ads_04_campaigns", f"""
WITH s AS (SELECT campaign_id, MIN(campaign_name) AS campaign_name, MIN(status) AS status, {total('impressions')} AS impressions, {total('clicks')} AS clicks,
  CAST(SUM(cost_micros) AS DOUBLE) / 1e6 AS cost FROM {ADS} a GROUP BY campaign_id), w AS (SELECT campaign_id, {WON} FROM {CONV} c GROUP BY campaign_id)
SELECT s.*, {div0('clicks', 'impressions')} AS ctr, {div0('cost', 'clicks')} AS avg_cpc, COALESCE(purchases, 0e0) AS conversions,
  {div0('cost', 'COALESCE(purchases, 0e0)')} AS cost_per_purchase, {div0('cost', 'COALESCE(micro, 0e0)')} AS cost_per_micro_conversion,
  {div0('COALESCE(value, 0e0)', 'cost')} AS roas FROM s LEFT JOIN w ON s.campaign_id = w.campaign_id""")
def _(t):
    return trf.ads_campaigns(t.ads_campaign_daily, t.ads_conversions, D0, D1)


def breakdown_sql(level):
    lead = "".join(f"{c}, " for c in level)
    return f"""SELECT {lead}purchase, action_name, SUM(conversions) AS conversions, {money('conversions_value')} AS value,
  split_part(replace(action_name, 'Google Ads || ', ''), ' || ', 1) AS label FROM {CONV} c GROUP BY {lead}purchase, action_name HAVING SUM(conversions) > 0"""


@query("ads_05_breakdown", breakdown_sql([]))
def _(t):
    return trf.ads_breakdown(t.ads_campaign_daily, t.ads_conversions, D0, D1)


@query("ads_05_breakdown_campaign", breakdown_sql(["campaign_id"]))
def _(t):
    return trf.ads_breakdown(t.ads_campaign_daily, t.ads_conversions, D0, D1, ["campaign_id"])


@query("ads_06_by_action", f"""
SELECT action_name, MIN(category) AS category, SUM(conversions) AS conversions FROM ads_conversions
WHERE date BETWEEN DATE '1997-04-01' AND DATE '1997-04-30' AND conversions > 0 GROUP BY action_name""")
def _(t):
    return trf.conversions_by_action(t.ads_conversions, "1997-04-01", "1997-04-30")


# --- e-mail ---------------------------------------------------------------------------

M0, M1 = "2024-01-16", "2024-01-31"
SINCE = "2023-12-31 23:59:59.999"
ALL_MAIL = f"FROM klaviyo_metrics WHERE date >= TIMESTAMP '{E0}' AND date <= TIMESTAMP '{E1}'"


@query("eml_01_email_daily", f"SELECT CAST(date AS DATE) AS day, metric_name, {total('count')} AS total_count, {money('sum_value')} AS total_value {ALL_MAIL} GROUP BY 1, 2", ["day"])
def _(t):
    return eng.email_daily(t.klaviyo_metrics, E0, E1)


def metric(name):
    return total(f"CASE WHEN metric_name = '{name}' THEN count ELSE 0 END")


MEASURES = f"""{money_if("metric_name = 'Placed Order'", 'sum_value')} AS revenue, {metric('Placed Order')} AS orders,
  {metric('Opened Email')} AS opens, {metric('Clicked Email')} AS clicks, {metric('Received Email')} AS received"""
RATES = f"""{pct0('clicks', 'received')} AS cr, {pct0('clicks', 'opens')} AS ctor, {pct0('orders', 'clicks')} AS order_rate, {div0('revenue', 'orders')} AS aov"""


@query("eml_02_email_trend", f"WITH m AS (SELECT CAST(date AS DATE) AS date, {MEASURES} {ALL_MAIL} GROUP BY 1) SELECT date, revenue, opens, clicks FROM m", ["date"])
def _(t):
    return eng.email_trend(t.klaviyo_metrics, E0, E1)


PERIODS = f"""SELECT period, revenue, orders, opens, clicks, received, {RATES} FROM (
 SELECT 'current' AS period, {MEASURES} FROM klaviyo_metrics WHERE date >= TIMESTAMP '{M0}' AND date <= TIMESTAMP '{M1}'
 UNION ALL SELECT 'previous', {MEASURES} FROM klaviyo_metrics WHERE date >= TIMESTAMP '{SINCE}' AND date <= TIMESTAMP '2024-01-15 23:59:59.999') p"""


@query("eml_03_email_periods", PERIODS)
def _(t):
    return eng.email_periods(t.klaviyo_metrics, M0, M1)


def change(c):
    return f"CASE WHEN p.{c} = 0 THEN CASE WHEN c.{c} > 0 THEN 100e0 ELSE 0e0 END ELSE (c.{c} - p.{c}) / p.{c} * 100e0 END AS {c}"


@query("eml_04_email_deltas", f"""
WITH x AS ({PERIODS}) SELECT {change('revenue')}, c.cr - p.cr AS cr, c.ctor - p.ctor AS ctor, c.order_rate - p.order_rate AS order_rate, {change('aov')}
FROM (SELECT * FROM x WHERE period = 'current') c, (SELECT * FROM x WHERE period = 'previous') p""")
def _(t):
    return eng.email_deltas(eng.email_periods(t.klaviyo_metrics, M0, M1))


def attribution_sql(start):
    return f"""WITH r AS (SELECT *, CASE WHEN trim(flow_name) <> '' THEN 'flow' WHEN trim(campaign_name) <> '' THEN 'campaign' END AS kind
  FROM klaviyo_metrics WHERE date >= TIMESTAMP '{start}' AND date <= TIMESTAMP '{M1}'),
i AS (SELECT kind, CASE WHEN kind = 'flow' THEN flow_name ELSE campaign_name END AS name, {MEASURES} FROM r WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT *, {RATES}, {pct0('revenue', 'MAX(revenue) OVER (PARTITION BY kind)')} AS revenue_share FROM i"""


@query("eml_05_attribution_current", attribution_sql(M0))
def _(t):
    return eng.email_attribution(t.klaviyo_metrics, M0, M1)


@query("eml_05_attribution_both", attribution_sql(SINCE))
def _(t):
    return eng.email_attribution(t.klaviyo_metrics, M0, M1, "both")


@query("eml_06_campaign_totals", f"SELECT campaign_name, metric_name, {total('count')} AS total FROM klaviyo_metrics WHERE campaign_name IS NOT NULL AND campaign_name <> '' GROUP BY 1, 2")
def _(t):
    return eng.campaign_totals(t.klaviyo_metrics)


@query("eml_07_headline", f"SELECT {total('count')} AS total_orders, {money('sum_value')} AS total_revenue {ALL_MAIL} AND metric_name = 'Placed Order'")
def _(t):
    return eng.email_headline(t.klaviyo_metrics, E0, E1)


# --- reviews --------------------------------------------------------------------------

STARS = ", ".join(count_if(f"status = 'published' AND score = {s}") + f" AS stars_{s}" for s in (5, 4, 3, 2, 1))
REVIEWS = f"""SELECT *, {js(pct0('stars_5 + stars_4', 'published_reviews'))} AS sentiment_score FROM (
SELECT COUNT(review_id) AS total_reviews, {count_if("status = 'published'")} AS published_reviews, {count_if("status = 'pending'")} AS pending_reviews,
  COALESCE(AVG(CASE WHEN status = 'published' THEN score END), 0e0) AS average_rating, {STARS} FROM raw_yotpo_reviews) r"""


@query("rev_01_review_summary", REVIEWS)
def _(t):
    return eng.review_summary(t.raw_yotpo_reviews)


@query("rev_01_star_histogram", "SELECT CAST(score AS INT) AS stars, COUNT(*) AS reviews FROM raw_yotpo_reviews WHERE status = 'published' GROUP BY score")
def _(t):
    return eng.star_histogram(eng.review_summary(t.raw_yotpo_reviews))


@query("rev_02_product_sentiment", f"""
WITH y AS (SELECT product_id AS sku, COUNT(review_id) AS total_reviews, AVG(score) AS average_score, {total('votes_up')} AS total_helpful_votes FROM raw_yotpo_reviews GROUP BY 1),
s AS (SELECT v.sku, p.title AS product_name, {total('l.quantity')} AS total_units_sold, {money('l.price * l.quantity')} AS gross_revenue
  FROM shopify_order_lines l LEFT JOIN shopify_product_variants v ON l.variant_id = v.id LEFT JOIN shopify_products p ON l.product_id = p.id GROUP BY 1, 2)
SELECT s.*, COALESCE(total_reviews, 0) AS total_reviews, COALESCE(average_score, 0e0) AS average_score, total_helpful_votes FROM s LEFT JOIN y ON s.sku = y.sku""")
def _(t):
    return eng.product_sentiment(t.shopify_order_lines, t.shopify_product_variants, t.shopify_products, t.raw_yotpo_reviews)
