"""Small column expressions shared by the marts and KPIs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three status sets that count as "sold" in different reports.
SOLD_NET = ("paid", "partially_refunded")
SOLD_PAID = ("paid",)
SOLD_SCAN = ("paid", "partially_paid")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: str | Column, digits: int = 0) -> Column:
    """Math.round semantics: halves go up (floor(x + 0.5)), not away from zero."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def div0(num: str | Column, den: str | Column) -> Column:
    """num / den, and 0 unless the denominator is positive."""
    d = col(den)
    return F.when(d > 0, col(num).cast("double") / d).otherwise(F.lit(0.0))


def pct0(num: str | Column, den: str | Column) -> Column:
    return div0(num, den) * F.lit(100.0)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, and null on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def money_sum(c: str | Column) -> Column:
    """Sum of money in exact decimals, so the total does not depend on row order."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def exact_sum(c: str | Column, scale: int = 6) -> Column:
    """Order-independent sum of fractional measures."""
    return F.sum(col(c).cast(f"decimal(24,{scale})")).cast("double")


def exact_avg(c: str | Column, scale: int = 6) -> Column:
    """Order-independent mean; null over no values."""
    return safe_div(exact_sum(c, scale), F.count(col(c)))


def money_mean(c: str | Column, digits: int = 2) -> Column:
    """Mean of money, rounded half up in decimals, so halves do not depend on binary fractions."""
    return F.round(F.sum(col(c).cast("decimal(18,2)")) / F.count(col(c)), digits).cast("double")


def wavg(value: str | Column, weight: str | Column) -> Column:
    """SUM(value * weight) / NULLIF(SUM(weight), 0), in decimals, so that the mean does not depend on row order."""
    return safe_div(weighted_sum(value, weight), F.sum(col(weight).cast("decimal(17,2)")))


def weighted_sum(value: str | Column, weight: str | Column) -> Column:
    """Order-independent SUM(value * weight), with ten digits of the value's fraction."""
    return F.sum(col(value).cast("decimal(20,10)") * col(weight).cast("decimal(17,2)"))


def sold(c: str | Column, statuses: Iterable[str] = SOLD_NET) -> Column:
    """Status set test; the set differs per report, so it is a parameter."""
    return col(c).isin(*statuses)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_where(cond: Column, value: str | Column) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END), in exact decimals."""
    return F.sum(
        F.when(cond, col(value).cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    ).cast("double")


def int_or_zero(c: str | Column) -> Column:
    """Leading integer of a text, 0 when there is none."""
    digits = F.regexp_extract(col(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def float_or_null(c: str | Column) -> Column:
    """Leading decimal number of a text, null when there is none."""
    number = F.regexp_extract(col(c), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return number.try_cast("double")


def float_or_zero(c: str | Column) -> Column:
    return F.coalesce(float_or_null(c), F.lit(0.0))


def price_dots(c: str | Column) -> Column:
    """Keep digits and dots, read the leading number; '129.990' reads as 129.99."""
    return float_or_zero(F.regexp_replace(col(c), r"[^0-9.]", ""))


def price_locale(c: str | Column) -> Column:
    """Dots group thousands, a comma starts the decimals; null when unreadable."""
    kept = F.regexp_replace(col(c), r"[^\d.,]", "")
    plain = F.translate(F.regexp_replace(kept, r"\.", ""), ",", ".")
    return float_or_null(plain)


def non_blank(c: str | Column) -> Column:
    """True for text that is neither null nor only spaces."""
    return F.coalesce(F.trim(col(c)) != "", F.lit(False))


def not_empty(c: str | Column) -> Column:
    """The text, with '' read as null."""
    return F.nullif(col(c), F.lit(""))


def whole_hours_apart(a: str | Column, b: str | Column) -> Column:
    """Whole hours between two times, truncated toward zero, without sign."""
    return F.abs(F.timestamp_diff("HOUR", col(a), col(b)))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; wall-clock times are read as UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))
