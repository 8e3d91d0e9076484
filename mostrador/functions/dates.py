"""Date ranges: bounds are resolved to literals on the driver, rows are filtered on the
bare column so that the scan can prune partitions and row groups."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import col


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _parse(text, fallback: datetime) -> datetime:
    if isinstance(text, datetime):
        return text
    if isinstance(text, date):
        return datetime.combine(text, time.min)
    try:
        parsed = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
        return parsed.replace(tzinfo=None)
    except (TypeError, ValueError):
        return fallback


def default_start(default: str, now: datetime) -> datetime:
    """Start of the default range: month to date, year to date or the last 30 days."""
    if default == "mtd":
        return datetime(now.year, now.month, 1)
    if default == "ytd":
        return datetime(now.year, 1, 1)
    if default == "30d":
        return now - timedelta(days=30)
    raise ValueError(f"unknown default range {default!r}")


def bounds(start, end, default: str = "mtd", now: datetime | None = None) -> tuple[datetime, datetime]:
    """Unreadable or missing bounds fall back to the default range up to ``now``."""
    now = now or _now()
    return _parse(start, default_start(default, now)), _parse(end, now)


def range_days(start: datetime, end: datetime) -> int:
    """Whole days of a range, rounded up, at least 1."""
    seconds = abs((end - start).total_seconds())
    return max(1, int(-(-seconds // 86400)))


def _literal(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def in_range(df: DataFrame, ts: str, start, end, default: str = "mtd", now: datetime | None = None) -> DataFrame:
    """Rows with ``start <= ts <= end`` (both closed)."""
    lo, hi = bounds(start, end, default, now)
    return df.where(F.col(ts).between(_literal(lo), _literal(hi)))


def in_dates(df: DataFrame, column: str, d0, d1) -> DataFrame:
    """Inclusive date range on a date column."""
    return df.where(F.col(column).between(F.lit(str(d0)).cast("date"), F.lit(str(d1)).cast("date")))


def maybe_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Filter only if both bounds are given."""
    return in_range(df, ts, start, end) if start and end else df


# Preset names and where each starts, relative to a day.
def preset_dates(name: str, today: date) -> tuple[date, date]:
    starts = {
        "today": today,
        "yesterday": today - timedelta(days=1),
        "3d": today - timedelta(days=3),
        "7d": today - timedelta(days=7),
        "month": today.replace(day=1),
        "quarter": date(today.year, 3 * ((today.month - 1) // 3) + 1, 1),
        "year": date(today.year, 1, 1),
    }
    return starts[name], (starts[name] if name == "yesterday" else today)


def in_preset(df: DataFrame, ts: str, name: str, today: date) -> DataFrame:
    """Rows whose day lies in a preset range."""
    lo, hi = preset_dates(name, today)
    first = datetime.combine(lo, time.min)
    after = datetime.combine(hi + timedelta(days=1), time.min)
    return df.where((F.col(ts) >= _literal(first)) & (F.col(ts) < _literal(after)))


def since(df: DataFrame, column: str, days: int, as_of) -> DataFrame:
    """Rows at or after ``as_of`` minus ``days`` (timestamps)."""
    return df.where(F.col(column) >= _literal(_parse(as_of, _now()) - timedelta(days=days)))


def ts_literal(value) -> Column:
    return _literal(_parse(value, None))


def date_literal(value) -> Column:
    return F.lit(str(value)[:10]).cast("date")


def day(c: str | Column) -> Column:
    return F.to_date(col(c))
