"""Ordered series per key.

Only a bounded tail of each series is ever gathered (the last 8 points, 12 months); it is
cut in the map tasks before the shuffle, so a very long series costs no more than a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..functions.dates import date_literal
from ..functions.exprs import js_round, safe_div


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``."""
    return skew.top_per_key(df, keys, order, 1).drop("rn")


def previous_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Second row per key in ``order``."""
    return skew.top_per_key(df, keys, order, 2).where("rn = 2").drop("rn")


SCAN_ORDER = ("scan_date", "scraped_at")


def _newest_scan() -> list[Column]:
    return [F.desc(c) for c in SCAN_ORDER] + [F.asc("product_id")]


def latest_and_previous(pos: DataFrame) -> DataFrame:
    """Latest shelf scan per keyword beside the positions of the one before: one pass that
    keeps two rows per keyword."""
    two = skew.top_per_key(pos, ["keyword"], _newest_scan(), 2)
    row = F.struct(*[c for c in pos.columns if c != "keyword"])
    both = two.groupBy("keyword").agg(
        F.max(F.when(F.col("rn") == 1, row)).alias("now"), F.max(F.when(F.col("rn") == 2, row)).alias("prev"))
    return both.select(
        "keyword", "now.*",
        F.col("prev.organic_position").alias("prev_organic_position"),
        F.col("prev.paid_position").alias("prev_paid_position"),
    )


def history_array(pos: DataFrame, today, days: int = 60) -> DataFrame:
    """Dated positions per keyword as a sorted array.

    Equal (date, organic, paid) entries are counted before they are gathered and carry the
    count in ``scans``: nothing is lost, and the array is bounded by days and ranks.
    """
    recent = pos.where(F.col("scan_date") >= F.date_sub(date_literal(today), days))
    counted = recent.groupBy("keyword", "scan_date", "organic_position", "paid_position").agg(
        F.count(F.lit(1)).alias("scans"))
    entry = F.struct("scan_date", "organic_position", "paid_position", "scans")
    return counted.groupBy("keyword").agg(F.sort_array(F.collect_list(entry)).alias("history"))


def shopping_position_report(pos: DataFrame, today, days: int = 60) -> DataFrame:
    """Latest scan, previous positions and history per keyword."""
    return latest_and_previous(pos).join(history_array(pos, today, days), "keyword", "left")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First-seen row per key; the order is explicit, unlike ``dropDuplicates``."""
    return latest_per(df, keys, order)


def out_of_order(df: DataFrame, source: str, seq: str, value: str, chunk: int = 1_000_000) -> DataFrame:
    """Rows per source whose value is greater than the one before in list order.

    The list is cut into chunks of ``chunk`` positions, each compared on its own; the seams
    are compared between the last row of a chunk and the first of the next one, so a source
    of any length is spread over tasks.
    """
    rows = (
        df.select(F.col(source).alias("source"), F.col(seq).alias("seq"), F.col(value).alias("value"))
        .withColumn("chunk", F.floor(F.col("seq") / chunk))
        .repartition("source", "chunk")
    )
    w = Window.partitionBy("source", "chunk").orderBy("seq")
    inside = (
        rows.withColumn("_prev", F.lag("value").over(w)).groupBy("source", "chunk")
        .agg(F.count(F.when(F.col("value") > F.col("_prev"), 1)).alias("n"),
             F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"))
    )
    seam = Window.partitionBy("source").orderBy("chunk")
    return (
        inside.withColumn("_before", F.lag("last").over(seam)).groupBy("source")
        .agg((F.sum("n") + F.count(F.when(F.col("first") > F.col("_before"), 1))).alias("out_of_order"))
    )


def latest_in_group(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(ts), F.col(value)))[value].alias(f"latest_{value}"))


def tail(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 8) -> DataFrame:
    """The last ``n`` values per key, oldest first, as array ``vals``."""
    last = skew.top_per_key(df.select(*keys, order, value), keys, [F.desc(order), F.desc(value)], n)
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("pos"), F.col(value).cast("double").alias("v"))))
    return last.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("vals"))


def _mean(values: Column) -> Column:
    return safe_div(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _halves(vals: Column) -> tuple[Column, Column]:
    """Last four values, and up to four before them."""
    n = F.size(vals)
    recent = F.slice(vals, F.greatest(n - 3, F.lit(1)), F.lit(4))
    earlier = F.slice(vals, F.lit(1), F.greatest(n - 4, F.lit(0)))
    return recent, earlier


def tail_stats(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Last value and the means of the last four and the four before."""
    t = tail(df, keys, order, value)
    recent, earlier = _halves(F.col("vals"))
    return t.select(
        *keys, F.size("vals").alias("points"), F.element_at("vals", -1).alias("last_value"),
        _mean(recent).alias("recent_avg"), _mean(earlier).alias("previous_avg"),
    )


# Thresholds of the demand signal and its texts.
BREAKOUT_LEVEL, BREAKOUT_GROWTH, RISK_LEVEL, GROWTH = 90, 50, 15, 20
RISE_SLACK, FALL_SLACK = 0.9, 1.1
TOO_SHORT = "Datos insuficientes para calcular señal."
BREAKOUT_TEXT = "Demanda explosiva: índice %s/100. Considera restock urgente o campaña de Ads."
RISK_TEXT = "Demanda muy baja (%s/100 promedio). Riesgo de inventario muerto."
RISING_TEXT = "Tendencia al alza: +%s%% en últimas 4 semanas."
FALLING_TEXT = "Tendencia a la baja: %s%% en últimas 4 semanas."
STABLE_TEXT = "Demanda estable. Índice promedio: %s/100."


def _whole(c: Column) -> Column:
    """Rounded to a whole number as text."""
    return F.round(c, 0).cast("bigint").cast("string")


def trend_signal(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Demand signal of each series and its explanation, from the last eight points."""
    t = tail(df, keys, order, value)
    recent, earlier = _halves(F.col("vals"))

    def steps(test):
        pairs = F.arrays_zip(
            F.slice(F.col("recent"), 1, 3).alias("before"), F.slice(F.col("recent"), 2, 3).alias("after"))
        return F.forall(pairs, lambda p: test(p["before"], p["after"]))

    full = t.withColumn("recent", recent).withColumn("earlier", earlier).withColumn("last", F.element_at("vals", -1))
    full = full.withColumn("mean", _mean(F.col("recent"))).withColumn(
        "prev", F.when(F.size("earlier") > 0, _mean(F.col("earlier"))).otherwise(F.col("mean")))
    full = full.withColumn(
        "growth", F.when(F.col("prev") > 0, (F.col("mean") - F.col("prev")) / F.col("prev") * 100).otherwise(F.lit(0.0)))
    enough = F.size("vals") >= 4
    cases = [
        (~enough, "stable", F.lit(TOO_SHORT)),
        ((F.col("last") >= BREAKOUT_LEVEL) & (F.col("growth") > BREAKOUT_GROWTH), "breakout",
         F.format_string(BREAKOUT_TEXT, F.col("last").cast("bigint").cast("string"))),
        (F.col("mean") < RISK_LEVEL, "risk", F.format_string(RISK_TEXT, _whole(F.col("mean")))),
        ((F.col("growth") > GROWTH) & steps(lambda a, b: b >= a * RISE_SLACK), "rising",
         F.format_string(RISING_TEXT, _whole(F.col("growth")))),
        ((F.col("growth") < -GROWTH) & steps(lambda a, b: b <= a * FALL_SLACK), "falling",
         F.format_string(FALLING_TEXT, _whole(F.col("growth")))),
    ]
    signal, detail = F.when(cases[0][0], F.lit(cases[0][1])), F.when(cases[0][0], cases[0][2])
    for cond, name, words in cases[1:]:
        signal, detail = signal.when(cond, F.lit(name)), detail.when(cond, words)
    return full.select(
        *keys, signal.otherwise(F.lit("stable")).alias("signal"),
        detail.otherwise(F.format_string(STABLE_TEXT, _whole(F.col("mean")))).alias("signal_detail"),
    )


MOMENTUM_BAND = 5


def momentum(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean of the last four points against the four before, in percent to 1 decimal; the
    direction follows the unrounded percentage. Fewer than 8 points or a zero base is neutral."""
    t = tail_stats(df, keys, order, value)
    usable = (F.col("points") >= 8) & (F.col("previous_avg") != 0)
    pct = F.when(usable, (F.col("recent_avg") - F.col("previous_avg")) / F.col("previous_avg") * 100).otherwise(F.lit(0.0))
    t = t.withColumn("_pct", pct)
    return t.select(
        *keys, js_round("_pct", 1).alias("percentage"),
        F.when(F.col("_pct") > MOMENTUM_BAND, "rising").when(F.col("_pct") < -MOMENTUM_BAND, "declining")
        .otherwise("neutral").alias("direction"),
    )


def series_peak(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Highest value above 0 and its first date; 0 and '' when there is none."""
    best = F.min(F.when(F.col(value) > 0, F.struct((-F.col(value)).alias("neg"), F.col(order).alias("at"))))
    return df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.coalesce(-F.col("_b.neg"), F.lit(0)).alias("peak_value"),
        F.coalesce(F.col("_b.at").cast("string"), F.lit("")).alias("peak_date"))


SEASON_SHARE = 0.7


def seasonal_months(df: DataFrame, keys: Sequence[str], date_col: str, value: str) -> DataFrame:
    """Months seen in two or more years whose mean reaches the 70 % place of all such means."""
    months = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.month(date_col).alias("month"))
        .agg(safe_div(F.sum(value), F.count(value)).alias("avg"), F.count_distinct(F.year(date_col)).alias("years"))
        .where("years >= 2")
    )
    # At most twelve rows per key.
    ranked = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("avg", "month"))).alias("m"))
    threshold = F.get(F.col("m"), F.floor(F.size("m") * F.lit(SEASON_SHARE)).cast("int"))["avg"]
    kept = F.filter("m", lambda x: x["avg"] >= F.col("_t"))
    return (
        ranked.withColumn("_t", F.coalesce(threshold, F.lit(0.0)))
        .select(*keys, F.explode(kept).alias("x"))
        .select(*keys, F.format_string("%02d", F.col("x.month")).alias("month"), F.col("x.avg").alias("month_avg"))
    )


def winner(avgs: DataFrame, term: str = "term", value: str = "value", pos: str = "pos") -> DataFrame:
    """Term with the highest mean, the first of equals; null with fewer than two terms."""
    best = F.min_by(term, F.struct((-F.col(value)).alias("v"), F.col(pos)))
    return avgs.agg(F.when(F.count(F.lit(1)) >= 2, best).alias("winner"))


def series_wide(df: DataFrame, terms: Sequence[str], months: DataFrame, key: str = "term", date_col: str = "date",
                value: str = "value", band_term: str | None = None) -> DataFrame:
    """One row per date with a column per term (missing is 0) and the seasonal band 0 or 100."""
    wide = df.where(F.col(key).isin(*terms)).groupBy(date_col).pivot(key, list(terms)).agg(F.max(value))
    band = months.where(F.col(key) == (band_term or terms[0])).select("month", F.lit(100).alias("seasonal_band"))
    return (
        wide.withColumn("month", F.date_format(date_col, "MM")).join(band, "month", "left").drop("month")
        .fillna(0, subset=[*terms, "seasonal_band"])
    )


# Month names of the comparison table.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def compare_terms(df: DataFrame, key: str = "term", date_col: str = "date", value: str = "value") -> DataFrame:
    """Mean, peak, momentum and seasonal months per term."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    avgs = df.groupBy(key).agg(js_round(safe_div(F.sum(value), F.count(value))).alias("avg"))
    season = seasonal_months(df, [key], date_col, value).groupBy(key).agg(F.sort_array(F.collect_set("month")).alias("_m"))
    text = F.array_join(F.transform("_m", lambda m: F.get(names, m.cast("int") - 1)), ", ")
    return (
        avgs.join(series_peak(df, [key], date_col, value), key)
        .join(momentum(df, [key], date_col, value), key)
        .join(season, key, "left")
        .withColumn("months", F.coalesce(F.when(F.size("_m") > 0, text), F.lit("—")))
        .drop("_m")
    )

