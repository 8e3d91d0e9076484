"""Ordered series: latest and previous rows, histories, momentum, seasons, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import date_label
from ..operators import series
from .q_market import TAIL
from .registry import js, query

ORDER = "scan_date DESC, scraped_at DESC, product_id"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY {ORDER}) AS rn FROM shopping_position)"
COLS = ["keyword", "product_id", "scan_date", "organic_position", "paid_position"]


def newest():
    return [F.desc("scan_date"), F.desc("scraped_at"), F.asc("product_id")]


@query("win_01_latest_per_key", f"SELECT {', '.join(COLS)} FROM {RANKED} r WHERE rn = 1", ["scan_date"])
def _(t):
    return series.latest_per(t.shopping_position, ["keyword"], newest()).select(*COLS)


@query("win_01_latest_per_product", f"SELECT {', '.join(COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scan_date DESC, keyword) AS rn FROM shopping_position) r WHERE rn = 1", ["scan_date"])
def _(t):
    return series.latest_per(t.shopping_position, ["product_id"], [F.desc("scan_date"), F.asc("keyword")]).select(*COLS)


@query("win_02_previous_per_key", f"SELECT {', '.join(COLS)} FROM {RANKED} r WHERE rn = 2", ["scan_date"])
def _(t):
    return series.previous_per(t.shopping_position, ["keyword"], newest()).select(*COLS)


@query("win_02_latest_and_previous", f"""
SELECT keyword, MAX(CASE WHEN rn = 1 THEN product_id END) AS product_id, MAX(CASE WHEN rn = 1 THEN organic_position END) AS organic_position,
  MAX(CASE WHEN rn = 2 THEN organic_position END) AS prev_organic_position, MAX(CASE WHEN rn = 2 THEN paid_position END) AS prev_paid_position
FROM {RANKED} r WHERE rn <= 2 GROUP BY keyword""")
def _(t):
    return series.latest_and_previous(t.shopping_position).select(
        "keyword", "product_id", "organic_position", "prev_organic_position", "prev_paid_position")


@query("win_03_history", """
SELECT keyword, string_agg(concat(CAST(scan_date AS VARCHAR), '/', COALESCE(CAST(organic_position AS VARCHAR), '-'), '/', COALESCE(CAST(paid_position AS VARCHAR), '-'), 'x', CAST(n AS VARCHAR)), '|'
  ORDER BY scan_date, organic_position NULLS FIRST, paid_position NULLS FIRST) AS history
FROM (SELECT keyword, scan_date, organic_position, paid_position, COUNT(*) AS n FROM shopping_position WHERE scan_date >= DATE '2001-10-01' - 60 GROUP BY 1, 2, 3, 4) h GROUP BY keyword""")
def _(t):
    dash = F.lit("-")
    shown = F.transform("history", lambda h: F.concat(
        h["scan_date"].cast("string"), F.lit("/"), F.coalesce(h["organic_position"].cast("string"), dash), F.lit("/"),
        F.coalesce(h["paid_position"].cast("string"), dash), F.lit("x"), h["scans"].cast("string")))
    return series.history_array(t.shopping_position, "2001-10-01").withColumn("history", F.array_join(shown, "|"))


@query("win_04_dedupe_first", """
SELECT order_id, id, title FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY id, product_id, quantity, price) AS rn FROM shopify_order_lines) x WHERE rn = 1""")
def _(t):
    first = series.dedupe_first(t.shopify_order_lines, ["order_id"], [F.col(c) for c in ("id", "product_id", "quantity", "price")])
    return first.select("order_id", "id", "title")


@query("win_05_out_of_order", """
SELECT extension_id AS source, CAST(SUM(CASE WHEN duration > prev THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order
FROM (SELECT *, lag(duration) OVER (PARTITION BY extension_id ORDER BY seq) AS prev FROM call_log) x GROUP BY 1""")
def _(t):
    return series.out_of_order(t.call_log, "extension_id", "seq", "duration", chunk=1000)


@query("win_06_latest_in_group", """
SELECT extension_id, session_id AS latest_session_id FROM (SELECT *, row_number() OVER (PARTITION BY extension_id ORDER BY start_time DESC, session_id DESC) AS rn FROM call_log) x WHERE rn = 1""")
def _(t):
    return series.latest_in_group(t.call_log, ["extension_id"], "start_time", "session_id")


@query("win_07_tail_stats", f"WITH {TAIL} SELECT keyword, n AS points, last AS last_value, mean AS recent_avg, earlier AS previous_avg FROM tails")
def _(t):
    return series.tail_stats(t.market_trends, ["keyword"], "trend_date", "interest_value")


PEAK = """peaks AS (SELECT keyword, COALESCE(MAX(CASE WHEN interest_value > 0 THEN interest_value END), 0) AS peak_value,
  COALESCE(CAST(min_by(trend_date, (-interest_value) * 1000000 + datediff('day', DATE '1970-01-01', trend_date)) FILTER (WHERE interest_value > 0) AS VARCHAR), '') AS peak_date
 FROM market_trends GROUP BY keyword)"""


@query("win_08_series_peak", f"WITH {PEAK} SELECT * FROM peaks")
def _(t):
    return series.series_peak(t.market_trends, ["keyword"], "trend_date", "interest_value")


MOMENTUM = f"""{TAIL}, raw_pct AS (SELECT keyword, CASE WHEN n >= 8 AND earlier <> 0 THEN (mean - earlier) / earlier * 100 ELSE 0e0 END AS pct FROM tails),
mom AS (SELECT keyword, {js('pct', 1)} AS percentage, CASE WHEN pct > 5 THEN 'rising' WHEN pct < -5 THEN 'declining' ELSE 'neutral' END AS direction FROM raw_pct)"""


@query("alg_05_momentum", f"WITH {MOMENTUM} SELECT * FROM mom")
def _(t):
    return series.momentum(t.market_trends, ["keyword"], "trend_date", "interest_value")


SEASON = """months AS (SELECT keyword, strftime(trend_date, '%m') AS month, AVG(interest_value) AS avg FROM market_trends GROUP BY 1, 2 HAVING COUNT(DISTINCT year(trend_date)) >= 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY avg, month) AS place, COUNT(*) OVER (PARTITION BY keyword) AS n FROM months),
limits AS (SELECT keyword, MAX(CASE WHEN place = CAST(floor(n * 0.7e0) AS BIGINT) + 1 THEN avg END) AS t FROM placed GROUP BY 1),
season AS (SELECT m.keyword, m.month, m.avg AS month_avg FROM months m JOIN limits l ON m.keyword = l.keyword WHERE m.avg >= COALESCE(l.t, 0))"""


@query("alg_06_seasonal_months", f"WITH {SEASON} SELECT * FROM season")
def _(t):
    return series.seasonal_months(t.market_trends, ["keyword"], "trend_date", "interest_value")


@query("alg_07_winner", """
SELECT keyword AS winner FROM (SELECT keyword, AVG(interest_value) AS v FROM market_trends GROUP BY 1) x ORDER BY v DESC, keyword LIMIT 1""")
def _(t):
    avgs = t.market_trends.groupBy("keyword").agg(F.avg("interest_value").alias("value"))
    return series.winner(avgs, "keyword", "value", "keyword")


@query("alg_08_series_wide", f"""
WITH {SEASON}, w AS (SELECT trend_date AS date, COALESCE(MAX(CASE WHEN keyword = 'Brand#2' THEN interest_value END), 0) AS "Brand#2", COALESCE(MAX(CASE WHEN keyword = 'Brand#4' THEN interest_value END), 0) AS "Brand#4"
  FROM market_trends WHERE keyword IN ('Brand#2', 'Brand#4') GROUP BY 1)
SELECT w.*, CASE WHEN s.month IS NOT NULL THEN 100 ELSE 0 END AS seasonal_band FROM w LEFT JOIN season s ON s.keyword = 'Brand#2' AND s.month = strftime(w.date, '%m')""", ["date"])
def _(t):
    rows = t.market_trends.select(F.col("keyword").alias("term"), F.col("trend_date").alias("date"), F.col("interest_value").alias("value"))
    months = series.seasonal_months(rows, ["term"], "date", "value")
    return series.series_wide(rows, ["Brand#2", "Brand#4"], months)


@query("alg_09_compare_terms", f"""
WITH {MOMENTUM}, {PEAK}, {SEASON}, names AS (SELECT keyword, string_agg(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(month AS INT)], ', ' ORDER BY month) AS months FROM season GROUP BY 1),
a AS (SELECT keyword, {js('AVG(interest_value)')} AS avg FROM market_trends GROUP BY 1)
SELECT a.keyword AS term, a.avg, p.peak_value, p.peak_date, m.percentage, m.direction, COALESCE(n.months, '—') AS months
FROM a JOIN peaks p ON a.keyword = p.keyword JOIN mom m ON a.keyword = m.keyword LEFT JOIN names n ON a.keyword = n.keyword""")
def _(t):
    rows = t.market_trends.select(F.col("keyword").alias("term"), F.col("trend_date").alias("date"), F.col("interest_value").alias("value"))
    return series.compare_terms(rows)


@query("alg_08_date_labels", """
SELECT DISTINCT strftime(trend_date, '%b %-d') AS label FROM market_trends""")
def _(t):
    raw = F.concat(F.date_format("trend_date", "MMM d"), F.lit(" – "), F.date_format(F.date_add("trend_date", 6), "MMM d, yyyy"))
    return t.market_trends.select(date_label(raw).alias("label")).distinct()
