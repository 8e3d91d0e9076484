"""Market intelligence."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import market as mkt
from ..operators import series
from .registry import count_if, js, money, pct0, query, safe, total

# The keyword rules as the SQL engine's own regular expressions (its \b is ASCII).
UNITS = r"\b\d+\s*(GB|TB|MB|mAh|W|Hz|K|MP|mm)\b"
COLOURS = r"\b(" + "|".join(tx.COLOURS.split()) + r")\b"
FILLERS = r"\b(" + "|".join(tx.FILLERS.split()) + r")\b"
FILLERS_V2 = r"\b(" + "|".join(w for w in tx.FILLERS.split() if w not in tx.FILLERS_KEPT_BY_PRICES) + r")\b"


def keyword_sql(title: str, version: str) -> str:
    if version == "v3":
        kw = f"regexp_replace({title}, '[:|\\-–—].*', '')"
        kw = f"regexp_replace({kw}, '[\\[\\(].*?[\\]\\)]', '', 'g')"
        kw = f"regexp_replace({kw}, '{UNITS}', '', 'gi')"
    else:
        kw = f"regexp_replace({title}, ':\\s.*', '')"
        for pattern in (UNITS, COLOURS, FILLERS if version == "v1" else FILLERS_V2):
            kw = f"regexp_replace({kw}, '{pattern}', '', 'gi')"
        kw = f"regexp_replace({kw}, '[–—\\-]+$', '')"
    kw = f"trim(regexp_replace({kw}, '\\s{{2,}}', ' ', 'g'))"
    return f"array_to_string(list_slice(list_filter(string_split({kw}, ' '), lambda w: w <> ''), 1, 5), ' ')"


# Titles with everything the rules look for, derived from the parts.
TITLES = """titles AS (SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 7 WHEN 0 THEN concat(' ', CAST(p_size AS VARCHAR), 'GB Pro') WHEN 1 THEN ' Azul portátil - ' WHEN 2 THEN ': edición para casa'
  WHEN 3 THEN ' (caja nueva) 64 mm | oferta' WHEN 4 THEN ' Portatil BÁSICO mini Educativa uno dos tres cuatro' WHEN 5 THEN '   plus  — x' ELSE ' [v2] autos 5000mAh' END, ' ', p_type) AS title FROM part)"""


def titles(t):
    p = t.base("part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    tail = (
        F.when(key == 0, F.concat(F.lit(" "), size, F.lit("GB Pro"))).when(key == 1, " Azul portátil - ")
        .when(key == 2, ": edición para casa").when(key == 3, " (caja nueva) 64 mm | oferta")
        .when(key == 4, " Portatil BÁSICO mini Educativa uno dos tres cuatro").when(key == 5, "   plus  — x")
        .otherwise(" [v2] autos 5000mAh")
    )
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", tail, F.lit(" "), "p_type").alias("title"))


for _id, _version in (("alg_01_keyword_v1", "v1"), ("alg_02_keyword_v2", "v2"), ("alg_03_keyword_v3", "v3")):
    @query(_id, f"WITH {TITLES} SELECT id, title, {keyword_sql('title', _version)} AS keyword FROM titles")
    def _(t, _version=_version):
        return titles(t).withColumn("keyword", tx.extract_keyword("title", _version))


# The mean in whole cents, rounded half up.
CENTS = "(2 * SUM(CAST(round(v.price * 100) AS BIGINT)) + COUNT(v.price)) // (2 * COUNT(v.price))"
PRICED = f"""SELECT p.id AS product_id, p.title, p.vendor, CAST({CENTS} AS DOUBLE) / 100 AS avg_price, COUNT(v.id) AS variant_count
FROM shopify_products p JOIN shopify_product_variants v ON v.product_id = p.id WHERE p.status = 'active' AND v.price > 0 GROUP BY 1, 2, 3 HAVING {CENTS} > 0"""


def priced(t):
    return mkt.active_products(t.shopify_products, t.shopify_product_variants)


@query("mkt_01_active_products", PRICED)
def _(t):
    return priced(t)


@query("mkt_02_top_stocked_brands", """
SELECT p.vendor AS keyword, COUNT(DISTINCT p.id) AS vendor_products, round(AVG(v.inventory_quantity), 0) AS avg_stock
FROM shopify_products p JOIN shopify_product_variants v ON v.product_id = p.id
WHERE p.status = 'active' AND p.vendor IS NOT NULL AND p.vendor NOT IN ('Brand#3', '') GROUP BY 1 HAVING COUNT(DISTINCT p.id) >= 3
ORDER BY vendor_products DESC, keyword LIMIT 30""")
def _(t):
    return mkt.top_stocked_brands(t.shopify_products, t.shopify_product_variants, "Brand#3")


def size_parts(searches):
    buyers = f"CAST({searches} AS DOUBLE) * 0.01e0"
    size = f"({buyers}) * avg_price"
    return js(buyers, 2), js(size, 2), js(f"({size}) * 0.05e0", 2)


A, L = size_parts("avg_monthly_searches"), size_parts("last_month_searches")
SIZE = f"""SELECT product_id, title AS product_title, vendor, keyword, avg_price, avg_monthly_searches, last_month_searches,
  {A[0]} AS avg_potential_buyers, {L[0]} AS last_month_buyers, {A[1]} AS market_size_avg, {L[1]} AS market_size_last, {A[2]} AS market_share_avg, {L[2]} AS market_share_last
FROM (SELECT k.*, COALESCE(v.avg_monthly_searches, 0) AS avg_monthly_searches, COALESCE(v.last_month_searches, 0) AS last_month_searches
  FROM (SELECT *, {keyword_sql('title', 'v1')} AS keyword FROM ({PRICED}) p) k LEFT JOIN keyword_volumes v ON lower(k.keyword) = v.keyword) x"""


def sized(t):
    return mkt.market_size(priced(t), t.keyword_volumes)


@query("mkt_03_market_size", SIZE)
def _(t):
    return sized(t)


DIMENSION = f"SELECT * FROM ({SIZE}) s WHERE market_size_avg > 0 ORDER BY market_size_avg DESC, product_id LIMIT 200"


@query("mkt_04_dimension", f"""
SELECT product_id, product_title, market_size_avg, CASE WHEN length(product_title) > 30 THEN concat(substr(product_title, 1, 27), '...') ELSE product_title END AS label_50,
  CASE WHEN length(product_title) > 25 THEN concat(substr(product_title, 1, 22), '...') ELSE product_title END AS label_15 FROM ({DIMENSION}) d""")
def _(t):
    return mkt.market_dimension(sized(t)).select("product_id", "product_title", "market_size_avg", "label_50", "label_15")


@query("mkt_04_totals", "SELECT " + ", ".join(
    f"{js(money(c))} AS total_{c}" for c in ("market_size_avg", "market_size_last", "market_share_avg", "market_share_last"))
    + f", COUNT(*) AS product_count FROM ({SIZE}) s WHERE market_size_avg > 0")
def _(t):
    return mkt.market_totals(sized(t))


@query("mkt_05_price_gap", f"""
SELECT product_id, competitor_name, our_price, competitor_price, {js('our_price - competitor_price', 2)} AS price_diff_amount,
  CASE WHEN competitor_price > 0 THEN {js('(our_price - competitor_price) / competitor_price * 100', 2)} ELSE 0e0 END AS price_diff_pct,
  {js('our_price - competitor_price', 2)} <= 0 AS is_competitive FROM competitor_prices""")
def _(t):
    return mkt.price_gap(t.competitor_prices).select("product_id", "competitor_name", "our_price", "competitor_price",
                                                    "price_diff_amount", "price_diff_pct", "is_competitive")


BOTH = "our_price > 0 AND competitor_price > 0"
LIVE = f"""SELECT product_id, competitor_name, our_price, competitor_price, CASE WHEN our_price > 0 THEN competitor_price - our_price END AS diff_amount,
  CASE WHEN {BOTH} THEN {js('(competitor_price - our_price) / our_price * 100', 1)} END AS diff_pct, CASE WHEN {BOTH} THEN our_price <= competitor_price END AS is_competitive_live
FROM competitor_prices"""


def live(t):
    first = mkt.first_listings(t.competitor_prices, ["product_id"], [F.desc("synced_at"), F.asc("competitor_name"), F.asc("competitor_price")])
    return mkt.price_gap_live(first).select("product_id", "competitor_name", "our_price", "competitor_price", "diff_amount", "diff_pct", "is_competitive_live")


@query("mkt_06_price_gap_live", LIVE)
def _(t):
    return live(t)


PRICE_SUMMARY = f"""SELECT product_id, our_price, COUNT(*) AS total, MIN(CASE WHEN {BOTH} THEN competitor_price END) AS lowest, MAX(CASE WHEN {BOTH} THEN competitor_price END) AS highest,
  {js(safe(money(f'CASE WHEN {BOTH} THEN competitor_price END'), f'COUNT(CASE WHEN {BOTH} THEN 1 END)'), 2)} AS average,
  {js('(' + safe(count_if('is_competitive_live'), count_if('is_competitive_live IS NOT NULL')) + ') * 100')} AS competitiveness_rate FROM ({LIVE}) l GROUP BY 1, 2"""


@query("mkt_06_price_summary", PRICE_SUMMARY)
def _(t):
    return mkt.price_summary(live(t), ["product_id", "our_price"])


@query("mkt_07_top20_prices", f"""
WITH top AS (SELECT l.product_id, l.title, {total('l.quantity')} AS total_sold FROM shopify_order_lines l JOIN shopify_orders o ON l.order_id = o.id
  WHERE o.created_at >= TIMESTAMP '1998-05-01' - INTERVAL 30 DAY AND o.financial_status = 'paid' GROUP BY 1, 2 ORDER BY total_sold DESC, product_id, title LIMIT 20),
p AS (SELECT product_id, our_price, AVG(competitor_price) AS avg_competitor_price, MIN(competitor_price) AS min_competitor_price FROM competitor_prices GROUP BY 1, 2)
SELECT top.*, p.our_price, p.avg_competitor_price, p.min_competitor_price,
  CASE WHEN our_price <> 0 AND avg_competitor_price <> 0 THEN {js('(our_price - avg_competitor_price) / avg_competitor_price * 100')} END AS diff_pct
FROM top LEFT JOIN p ON top.product_id = p.product_id""")
def _(t):
    return mkt.top20_prices(t.shopify_order_lines, t.shopify_orders, t.competitor_prices, "1998-05-01")


@query("mkt_08_price_banner", f"""
SELECT product_id, our_price, average, lowest, CASE WHEN average <> 0 THEN {js('(our_price - average) / average * 100')} END AS vs_avg_pct,
  our_price < average AS cheaper, our_price <= lowest AS at_or_below_lowest FROM ({PRICE_SUMMARY}) s""")
def _(t):
    banner = mkt.price_banner(mkt.price_summary(live(t), ["product_id", "our_price"]))
    return banner.select("product_id", "our_price", "average", "lowest", "vs_avg_pct", "cheaper", "at_or_below_lowest")


# --- signals --------------------------------------------------------------------------

TAIL = """ranked AS (SELECT keyword, CAST(interest_value AS DOUBLE) AS v, row_number() OVER (PARTITION BY keyword ORDER BY trend_date DESC) AS rn FROM market_trends),
tails AS (SELECT keyword, COUNT(*) AS n, MAX(CASE WHEN rn = 1 THEN v END) AS last, AVG(CASE WHEN rn <= 4 THEN v END) AS mean, AVG(CASE WHEN rn > 4 THEN v END) AS earlier,
  MAX(CASE WHEN rn = 1 THEN v END) AS v1, MAX(CASE WHEN rn = 2 THEN v END) AS v2, MAX(CASE WHEN rn = 3 THEN v END) AS v3, MAX(CASE WHEN rn = 4 THEN v END) AS v4
  FROM ranked WHERE rn <= 8 GROUP BY keyword),
grown AS (SELECT *, CASE WHEN COALESCE(earlier, mean) > 0 THEN (mean - COALESCE(earlier, mean)) / COALESCE(earlier, mean) * 100 ELSE 0e0 END AS growth FROM tails)"""
WHOLE = "CAST(CAST(round({}, 0) AS BIGINT) AS VARCHAR)"
KIND = """CASE WHEN n < 4 THEN 'short' WHEN last >= 90 AND growth > 50 THEN 'breakout' WHEN mean < 15 THEN 'risk'
 WHEN growth > 20 AND v3 >= v4 * 0.9e0 AND v2 >= v3 * 0.9e0 AND v1 >= v2 * 0.9e0 THEN 'rising'
 WHEN growth < -20 AND v3 <= v4 * 1.1e0 AND v2 <= v3 * 1.1e0 AND v1 <= v2 * 1.1e0 THEN 'falling' ELSE 'stable' END"""
SIGNAL = f"""signals AS (SELECT keyword, CASE kind WHEN 'short' THEN 'stable' ELSE kind END AS signal,
 CASE kind WHEN 'short' THEN 'Datos insuficientes para calcular señal.'
  WHEN 'breakout' THEN concat('Demanda explosiva: índice ', CAST(CAST(last AS BIGINT) AS VARCHAR), '/100. Considera restock urgente o campaña de Ads.')
  WHEN 'risk' THEN concat('Demanda muy baja (', {WHOLE.format('mean')}, '/100 promedio). Riesgo de inventario muerto.')
  WHEN 'rising' THEN concat('Tendencia al alza: +', {WHOLE.format('growth')}, '% en últimas 4 semanas.')
  WHEN 'falling' THEN concat('Tendencia a la baja: ', {WHOLE.format('growth')}, '% en últimas 4 semanas.')
  ELSE concat('Demanda estable. Índice promedio: ', {WHOLE.format('mean')}, '/100.') END AS signal_detail FROM (SELECT *, {KIND} AS kind FROM grown) g)"""


def signals(t):
    return series.trend_signal(t.market_trends, ["keyword"], "trend_date", "interest_value")


@query("alg_04_trend_signal", f"WITH {TAIL}, {SIGNAL} SELECT * FROM signals")
def _(t):
    return signals(t)


# A shorter key, so that all signals and short series occur.
@query("alg_04_trend_signal_daily", f"WITH {TAIL.replace('market_trends', 'per_page')}, {SIGNAL} SELECT * FROM signals".replace(
    "WITH ranked", """WITH per_page AS (SELECT concat(page, '#', property) AS keyword, date AS trend_date, CAST(SUM(impressions) AS BIGINT) % 101 AS interest_value FROM gsc_metrics GROUP BY 1, 2),
ranked"""))
def _(t):
    key = F.concat("page", F.lit("#"), "property").alias("keyword")
    per = t.gsc_metrics.groupBy(key, F.col("date").alias("trend_date")).agg((F.sum("impressions") % 101).alias("interest_value"))
    return series.trend_signal(per, ["keyword"], "trend_date", "interest_value")


BOARD = f"""{TAIL}, {SIGNAL}, latest AS (SELECT keyword, MAX(trend_date) AS d FROM market_trends WHERE keyword_type = 'brand' GROUP BY 1),
board AS (SELECT t.keyword, s.signal, s.signal_detail, t.interest_value, t.trend_date,
  CASE s.signal WHEN 'breakout' THEN 1 WHEN 'rising' THEN 2 WHEN 'stable' THEN 3 WHEN 'falling' THEN 4 WHEN 'risk' THEN 5 ELSE 6 END AS severity
FROM market_trends t JOIN latest l ON t.keyword = l.keyword AND t.trend_date = l.d JOIN signals s ON s.keyword = t.keyword)"""


def board(t):
    return mkt.signal_board(t.market_trends.join(signals(t), "keyword"))


@query("mkt_09_signal_board", f"WITH {BOARD} SELECT * FROM board", ["trend_date"])
def _(t):
    return board(t)


@query("mkt_10_signal_summary", f"""
WITH {BOARD} SELECT {count_if("signal = 'breakout'")} AS breakouts, {count_if("signal = 'rising'")} AS rising, {count_if("signal = 'risk'")} AS at_risk,
 COUNT(*) AS total_brands, {js('SUM(interest_value) / COUNT(*)')} AS avg_index FROM board""")
def _(t):
    return mkt.signal_summary(board(t))


SERIES = "SELECT keyword, trend_date, interest_value FROM market_trends WHERE keyword_type = 'brand' AND trend_date >= DATE '2001-08-01' - 84"


@query("mkt_11_trend_series", SERIES, ["trend_date"])
def _(t):
    return mkt.trend_series(t.market_trends, date(2001, 8, 1))


@query("mkt_11_trend_wide", f"""
SELECT trend_date, MAX(CASE WHEN keyword = 'Brand#2' THEN interest_value END) AS "Brand#2", MAX(CASE WHEN keyword = 'Brand#17' THEN interest_value END) AS "Brand#17"
FROM ({SERIES}) s WHERE keyword IN ('Brand#2', 'Brand#17') GROUP BY trend_date""", ["trend_date"])
def _(t):
    return mkt.trend_wide(mkt.trend_series(t.market_trends, date(2001, 8, 1)), ["Brand#2", "Brand#17"])


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY scan_date DESC, scraped_at DESC, product_id) AS rn FROM shopping_position) r WHERE rn = 1)"
for _kind in ("organic", "paid"):
    _p = f"{_kind}_position"

    @query(f"mkt_12_position_kpis_{_kind}", f"""
SELECT COUNT(*) AS tracked, COUNT({_p}) AS appeared, {js(pct0(f'COUNT({_p})', 'COUNT(*)'))} AS visibility_pct, MIN({_p}) AS best_position,
  {js(f'AVG({_p})', 1)} AS avg_position FROM {LATEST} l""")
    def _(t, _kind=_kind):
        return mkt.position_kpis(series.latest_and_previous(t.shopping_position), _kind)


@query("mkt_13_launches", "SELECT id, producto, scan_day, fecha_lanzamiento FROM launches ORDER BY fecha_lanzamiento ASC NULLS LAST, scan_day DESC, id LIMIT 200",
       ["scan_day", "fecha_lanzamiento"])
def _(t):
    return mkt.launches(t.launches).select("id", "producto", "scan_day", "fecha_lanzamiento")


STATES = "(SELECT *, CASE id % 4 WHEN 0 THEN 'EXISTENTE' WHEN 1 THEN 'NUEVO LANZAMIENTO' WHEN 2 THEN 'ERROR DB' END AS estado_db FROM launches)"


def with_states(t):
    state = F.expr("case id % 4 when 0 then 'EXISTENTE' when 1 then 'NUEVO LANZAMIENTO' when 2 then 'ERROR DB' end")
    return t.launches.withColumn("estado_db", state)


@query("mkt_14_launch_stats", f"""
SELECT scan_day, COUNT(*) AS launches, {count_if("estado_db IS DISTINCT FROM 'EXISTENTE'")} AS new_count, {count_if("estado_db = 'EXISTENTE'")} AS existing_count,
  scan_day = (SELECT MAX(scan_day) FROM launches) AS is_latest FROM {STATES} l GROUP BY scan_day""", ["scan_day"])
def _(t):
    return mkt.launch_stats(with_states(t))


@query("mkt_14_launch_categories", "SELECT COALESCE(NULLIF(categoria, ''), 'Otro') AS category, COUNT(*) AS launches FROM launches WHERE scan_day = DATE '2024-01-04' GROUP BY 1")
def _(t):
    return mkt.launch_categories(t.launches, "2024-01-04")


@query("mkt_15_calendar_months", """
SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, COUNT(*) AS n,
  string_agg(concat(CAST(event_date AS VARCHAR), ' ', event_name), '|' ORDER BY event_date, event_name) AS events
FROM commercial_calendar WHERE event_date IS NOT NULL GROUP BY 1""", ["month"])
def _(t):
    shown = F.transform("events", lambda e: F.concat_ws(" ", e["event_date"].cast("string"), e["event_name"]))
    return mkt.calendar_months(t.commercial_calendar).withColumn("n", F.size("events").cast("bigint")).withColumn(
        "events", F.array_join(shown, "|"))


@query("mkt_15_known_launches", f"SELECT id, estado_db FROM {STATES} l WHERE estado_db IN ('NUEVO LANZAMIENTO', 'EXISTENTE')")
def _(t):
    return mkt.known_launches(with_states(t)).select("id", "estado_db")


@query("mkt_16_keyword_groups", """
SELECT title AS keyword, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS product_ids FROM shopify_products GROUP BY 1""")
def _(t):
    items = t.shopify_products.select(F.col("title").alias("keyword"), F.col("id").alias("product_id"))
    return mkt.keyword_groups(items).withColumn("product_ids", F.array_join("product_ids", ","))


@query("mkt_16_unique_keywords", f"WITH {TITLES} SELECT DISTINCT lower({keyword_sql('title', 'v1')}) AS keyword FROM titles")
def _(t):
    return mkt.unique_keywords(titles(t).select(tx.extract_keyword("title").alias("keyword")))


RELATED = """rel AS (SELECT p_brand AS term, p_name AS query, CASE WHEN p_partkey % 5 = 0 THEN 'Breakout' ELSE concat(CAST(p_size * 3 AS VARCHAR), '%') END AS value,
  p_partkey AS rank FROM part)"""


def related(t):
    p = t.base("part")
    value = F.when(F.col("p_partkey") % 5 == 0, "Breakout").otherwise(F.concat((F.col("p_size") * 3).cast("string"), F.lit("%")))
    return p.select(F.col("p_brand").alias("term"), F.col("p_name").alias("query"), value.alias("value"), F.col("p_partkey").alias("rank"))


@query("mkt_17_related_top", f"""
WITH {RELATED}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, query) AS place FROM rel)
SELECT term, place, query, least(100, COALESCE(TRY_CAST(NULLIF(regexp_extract(value, '^\\d+'), '') AS BIGINT), 0)) AS pct FROM r WHERE place <= 10""")
def _(t):
    return mkt.related_top(related(t))


@query("mkt_17_related_rising", f"""
WITH {RELATED}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, query) AS place FROM rel)
SELECT term, place, query, value = 'Breakout' AS is_breakout FROM r WHERE place <= 12""")
def _(t):
    return mkt.related_rising(related(t))


@query("mkt_18_terms", r"""
SELECT id, unnest(list_filter(list_transform(string_split(concat(' ', title, ' ,, ', vendor, ',  '), ','), lambda x: trim(x)), lambda x: x <> '')) AS term FROM shopify_products""")
def _(t):
    raw = F.concat(F.lit(" "), "title", F.lit(" ,, "), "vendor", F.lit(",  "))
    return t.shopify_products.select("id", F.explode(tx.terms(raw)).alias("term"))


@query("mkt_18_top_region", """
SELECT term, region FROM (SELECT p_brand AS term, p_type AS region, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type) AS rn FROM part) x WHERE rn = 1""")
def _(t):
    return mkt.top_region(t.base("part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("region"), F.col("p_size").alias("rank")))


