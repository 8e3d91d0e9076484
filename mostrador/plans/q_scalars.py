"""Scalar function families over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..functions import text as tx
from .registry import count_if, js, query, safe


@query("scl_01_null_handling", """
SELECT id, COALESCE(vendor, 'Desconocido') AS brand, NULLIF(vendor, 'Desconocido') AS real_vendor, COALESCE(NULLIF(quantity, 1), -1) AS many FROM shopify_order_lines""")
def _(t):
    return t.shopify_order_lines.select(
        "id", F.coalesce("vendor", F.lit("Desconocido")).alias("brand"), F.nullif("vendor", F.lit("Desconocido")).alias("real_vendor"),
        F.coalesce(F.nullif("quantity", F.lit(1)), F.lit(-1)).alias("many"))


@query("scl_02_division", f"""
SELECT page, {safe('SUM(clicks)', 'SUM(impressions)')} AS safe_rate, CASE WHEN SUM(impressions) > 0 THEN CAST(SUM(clicks) AS DOUBLE) / SUM(impressions) ELSE 0e0 END AS zero_rate
FROM gsc_metrics GROUP BY page""")
def _(t):
    c, i = F.sum("clicks"), F.sum("impressions")
    return t.gsc_metrics.groupBy("page").agg(ex.safe_div(c, i).alias("safe_rate"), ex.div0(c, i).alias("zero_rate"))


@query("scl_03_conditional_aggregates", f"""
SELECT fulfillment_status, {count_if("financial_status = 'paid'")} AS paid, SUM(CASE WHEN financial_status = 'paid' THEN 1 ELSE 0 END) AS paid_sum,
  AVG(CASE WHEN financial_status = 'paid' THEN id END) AS mean_id, COUNT(CASE WHEN financial_status = 'paid' THEN customer_id END) AS buyers FROM shopify_orders GROUP BY 1""")
def _(t):
    paid = F.col("financial_status") == "paid"
    return t.shopify_orders.groupBy("fulfillment_status").agg(
        F.count_if(paid).alias("paid"), F.sum(F.when(paid, 1).otherwise(0)).alias("paid_sum"),
        F.avg(F.when(paid, F.col("id"))).alias("mean_id"), F.count(F.when(paid, F.col("customer_id"))).alias("buyers"))


@query("scl_04_casts", r"""
SELECT event_id, CAST(value AS VARCHAR) IS NOT NULL AS has_text, CAST(floor(value) AS BIGINT) AS whole, COALESCE(TRY_CAST(NULLIF(regexp_extract(props, '\d+'), '') AS BIGINT), 0) AS k,
  COALESCE(TRY_CAST(event_type AS DOUBLE), 0e0) AS bad_number, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""")
def _(t):
    return t.base("events").select(
        "event_id", F.col("value").cast("string").isNotNull().alias("has_text"), F.floor("value").cast("bigint").alias("whole"),
        ex.int_or_zero(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), ex.float_or_zero("event_type").alias("bad_number"),
        F.to_date("ts").cast("string").alias("day"))


@query("scl_05_date_parts", """
SELECT event_id, CAST(ts AS DATE) AS day, extract('hour' FROM ts) AS hour, strftime(ts, '%Y-%m-%d') AS label, split_part(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS prefix FROM events""", ["day"])
def _(t):
    return t.base("events").select(
        "event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("label"),
        F.split_part(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("T"), F.lit(1)).alias("prefix"))


@query("scl_06_date_arithmetic", """
SELECT id, CAST(created_at AS DATE) - 60 AS back, created_at - INTERVAL 30 DAY AS month_ago, created_at >= TIMESTAMP '1998-01-01' - INTERVAL 84 DAY AS recent FROM shopify_orders""", ["back", "month_ago"])
def _(t):
    return t.shopify_orders.select(
        "id", F.date_sub(F.to_date("created_at"), 60).alias("back"), (F.col("created_at") - F.expr("interval 30 days")).alias("month_ago"),
        (F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz") - F.expr("interval 84 days")).alias("recent"))


@query("scl_07_time_differences", """
SELECT session_id, datesub('minute', created_at, updated_at) AS minutes, datesub('hour', created_at, updated_at) AS hours, abs(datesub('hour', updated_at, created_at)) AS apart,
  CAST(ceil(CAST(epoch_us(updated_at) - epoch_us(created_at) AS DOUBLE) / 86400e6) AS BIGINT) AS days FROM crisp_conversations""")
def _(t):
    a, b = F.col("created_at"), F.col("updated_at")
    return t.crisp_conversations.select(
        "session_id", F.timestamp_diff("MINUTE", a, b).alias("minutes"), F.timestamp_diff("HOUR", a, b).alias("hours"),
        ex.whole_hours_apart(b, a).alias("apart"), F.ceil((ex.micros(b) - ex.micros(a)) / 86_400_000_000.0).cast("bigint").alias("days"))


@query("scl_08_epoch", """
SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back FROM events""", ["back"])
def _(t):
    from ..sources.payloads import millis_time

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.base("events").select("event_id", ms.alias("ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), millis_time(ms).alias("back"))


@query("scl_09_text", """
SELECT p_partkey, concat(p_name, ' - ', p_type) AS joined, lower(p_brand) AS low, trim(concat('  ', p_name, ' ')) AS trimmed, split_part(p_name, ' ', 2) AS second, substr(p_name, 1, 4) AS head,
  array_to_string(string_split(p_name, ' '), ',') AS listed, length(p_name) AS n, CASE WHEN length(p_name) > 9 THEN concat(substr(p_name, 1, 6), '...') ELSE p_name END AS short FROM part""")
def _(t):
    return t.base("part").select(
        "p_partkey", F.concat("p_name", F.lit(" - "), "p_type").alias("joined"), F.lower("p_brand").alias("low"),
        tx.trim_space(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        F.substring("p_name", 1, 4).alias("head"), F.array_join(F.split("p_name", " "), ",").alias("listed"),
        F.length("p_name").alias("n"), tx.shorten("p_name", 9, 6).alias("short"))


@query("scl_10_like", """
SELECT p_partkey, p_name LIKE '%ring%' AS anywhere, p_name LIKE 'blue%' AS prefix, concat(p_name, '/', p_type) LIKE '%g/S%' AS across FROM part""")
def _(t):
    return t.base("part").select(
        "p_partkey", F.col("p_name").contains("ring").alias("anywhere"), F.col("p_name").like("blue%").alias("prefix"),
        F.concat("p_name", F.lit("/"), "p_type").contains("g/S").alias("across"))


@query("scl_11_regex", r"""
SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has_number, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS letters, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word,
  len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents""")
def _(t):
    return t.base("documents").select(
        "doc_id", F.col("text").rlike("[0-9]{3}").alias("has_number"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("letters"),
        F.regexp_extract("text", "([A-Za-z]+)", 1).alias("first_word"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"))


@query("scl_12_rounding", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 1) AS sql_round, {js('l_extendedprice * l_discount', 2)} AS js_two, {js('-l_quantity / 4')} AS js_negative,
  CAST(ceil(l_tax * 10) AS BIGINT) AS up, CAST(floor(l_discount * 100) AS BIGINT) AS down, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo, abs(l_tax - l_discount) AS gap FROM lineitem""")
def _(t):
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 1).alias("sql_round"),
        ex.js_round(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("js_two"), ex.js_round(-F.col("l_quantity") / 4).alias("js_negative"),
        F.ceil(F.col("l_tax") * 10).cast("bigint").alias("up"), F.floor(F.col("l_discount") * 100).cast("bigint").alias("down"),
        F.greatest("l_tax", "l_discount").alias("hi"), F.least("l_tax", "l_discount").alias("lo"), F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"))


@query("scl_13_array_aggregates", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, COUNT(DISTINCT c_mktsegment) AS n, max_by(c_custkey, c_custkey) AS newest FROM customer GROUP BY 1""")
def _(t):
    return t.base("customer").groupBy("c_nationkey").agg(
        F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"), F.count_distinct("c_mktsegment").alias("n"),
        F.max_by("c_custkey", "c_custkey").alias("newest"))


@query("scl_14_structs", """
SELECT id, unnest(['price', 'subtotal', 'discount']) AS name, unnest([total_price, subtotal_price, total_discounts]) AS amount FROM shopify_orders""")
def _(t):
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("amount")) for n, c in
                      (("price", "total_price"), ("subtotal", "subtotal_price"), ("discount", "total_discounts"))])
    return t.shopify_orders.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


@query("scl_15_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{"id":', CAST(event_id AS VARCHAR), ',"type":"', event_type, '"}') AS payload FROM events""")
def _(t):
    return t.base("events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("payload"))


@query("scl_16_surrogate_key", """
SELECT md5(concat(CAST(date AS VARCHAR), '-', property, '-', page, '-', query)) AS id, COUNT(*) AS rows FROM gsc_metrics GROUP BY 1""")
def _(t):
    key = F.md5(F.concat_ws("-", F.col("date").cast("string"), "property", "page", "query"))
    return t.gsc_metrics.groupBy(key.alias("id")).agg(F.count("*").alias("rows"))


@query("scl_17_extremes", """
SELECT session_id, MIN(operator_name) AS any_operator, MAX(content) AS last_text, MIN(created_at) AS first_at, MAX(created_at) AS last_at, COUNT(DISTINCT sender_type) AS senders FROM crisp_messages GROUP BY 1""",
       ["first_at", "last_at"])
def _(t):
    return t.crisp_messages.groupBy("session_id").agg(
        F.min("operator_name").alias("any_operator"), F.max("content").alias("last_text"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"), F.count_distinct("sender_type").alias("senders"))


NORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("scl_18_accent_folding", f"SELECT doc_id, {NORM} AS plain FROM documents")
def _(t):
    return t.base("documents").select("doc_id", tx.normalize_text("text").alias("plain"))


@query("alg_10_normalize_text", f"SELECT conv_id, turn, {NORM} AS plain FROM conversations")
def _(t):
    return t.base("conversations").select("conv_id", "turn", tx.normalize_text("text").alias("plain"))


@query("scl_19_locale_prices", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS w, CAST(floor(l_extendedprice * 100) AS BIGINT) % 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(concat(CAST(w // 1000 AS VARCHAR), '.', lpad(CAST(w % 1000 AS VARCHAR), 3, '0')) AS DOUBLE) AS dots,
  w + c / 100e0 AS locale FROM p""")
def _(t):
    w, c = F.floor("l_extendedprice").cast("bigint"), F.floor(F.col("l_extendedprice") * 100).cast("bigint") % 100
    grouped = F.concat(F.floor(w / 1000).cast("string"), F.lit("."), F.lpad((w % 1000).cast("string"), 3, "0"))
    shown = F.concat(F.lit("CLP $"), grouped)
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ex.price_dots(shown).alias("dots"),
                                     ex.price_locale(F.concat(shown, F.lit(","), F.lpad(c.cast("string"), 2, "0"))).alias("locale"))


@query("alg_11_employee_code", """
SELECT staff_id, CASE WHEN COALESCE(first_name, '') <> '' AND COALESCE(last_name, '') <> '' THEN concat(replace(strip_accents(lower(first_name)), ' ', ''), '.', replace(strip_accents(lower(last_name)), ' ', ''))
  WHEN staff_id LIKE 'x%' THEN concat('unknown.', staff_id) ELSE lower(split_part(email, '@', 1)) END AS code FROM shopify_staff""")
def _(t):
    mail = F.when(~F.col("staff_id").startswith("x"), F.col("email"))
    return t.shopify_staff.select("staff_id", tx.employee_code(mail, "first_name", "last_name", "staff_id").alias("code"))
