"""Staff activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day, in_range, ts_literal
from ..sources.tables import read_page, write_pages
from .joins import full_name


def filter_activity(audit: DataFrame, staff: Sequence[str] = (), actions: Sequence[str] = ()) -> DataFrame:
    """Events with a staff id, of the given staff and actions; an empty list keeps all."""
    kept = audit.where(F.col("staff_id").isNotNull())
    if staff:
        kept = kept.where(F.col("staff_id").isin(*staff))
    return kept.where(F.col("action").isin(*actions)) if actions else kept


def named(summary: DataFrame, staff: DataFrame) -> DataFrame:
    """Add staff names to rows already summed per staff id."""
    who = staff.select("staff_id", full_name().alias("full_name"))
    return summary.join(who, "staff_id", "left").withColumn("full_name", F.coalesce("full_name", F.lit(" ")))


def activity_summary(audit: DataFrame, staff: DataFrame, d0, d1, ids: Sequence[str] = (), actions: Sequence[str] = ()) -> DataFrame:
    """Events and last activity per staff and action; summed before the name lookup."""
    kept = filter_activity(in_range(audit, "occurred_at", d0, d1), ids, actions)
    counts = kept.groupBy("staff_id", "action").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("occurred_at").alias("last_activity")
    )
    return (
        named(counts, staff).groupBy("staff_id", "full_name", "action")
        .agg(F.sum("event_count").alias("event_count"), F.max("last_activity").alias("last_activity"))
        .orderBy(F.desc("event_count"), "staff_id", "action")
    )


def activity_daily(audit: DataFrame, staff: DataFrame, d0, d1, ids: Sequence[str] = (), actions: Sequence[str] = ()) -> DataFrame:
    kept = filter_activity(in_range(audit, "occurred_at", d0, d1), ids, actions)
    counts = kept.groupBy(day("occurred_at").alias("date"), "staff_id").agg(F.count(F.lit(1)).alias("events"))
    return named(counts, staff).groupBy("date", "staff_id", "full_name").agg(F.sum("events").alias("events"))


def _days(spark, d0, d1) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(str(d0)[:10]).cast("date"), F.lit(str(d1)[:10]).cast("date"))).alias("date"))


def activity_spine(daily: DataFrame, d0, d1) -> DataFrame:
    """Events of all staff for every day of the range, zero filled."""
    totals = daily.groupBy("date").agg(F.sum("events").alias("total"))
    return _days(daily.sparkSession, d0, d1).join(totals, "date", "full_outer").fillna(0, subset=["total"])


def activity_spine_by_staff(daily: DataFrame, d0, d1) -> DataFrame:
    """One row per day and staff name, zero filled: every name generates its own days."""
    per = daily.groupBy("date", F.coalesce("full_name", F.lit("Unknown")).alias("full_name")).agg(
        F.sum("events").alias("events"))
    spine = per.select("full_name").distinct().select("full_name", F.explode(F.sequence(
        F.lit(str(d0)[:10]).cast("date"), F.lit(str(d1)[:10]).cast("date"))).alias("date"))
    return spine.join(per, ["full_name", "date"], "full_outer").fillna(0, subset=["events"])


def activity_spine_wide(daily: DataFrame, d0, d1, names: Sequence[str]) -> DataFrame:
    """One column per given staff name."""
    wide = daily.where(F.col("full_name").isin(*names)).groupBy("date").pivot("full_name", list(names)).agg(F.sum("events"))
    return _days(daily.sparkSession, d0, d1).join(wide, "date", "full_outer").fillna(0, subset=list(names))


EVENT_COLUMNS = ["audit_id", "occurred_at", "staff_id", "action", "subject_type", "subject_id"]


def activity_page(audit: DataFrame, staff: DataFrame, d0, d1, page: int = 1, limit: int = 50, ids: Sequence[str] = (),
                  actions: Sequence[str] = (), after: tuple | None = None) -> DataFrame:
    """One page of events, newest first (ties by id), with names looked up for that page only.

    ``after=(occurred_at, audit_id)`` continues behind the last row of the page before: deep
    pages then cost the same as the first, while ``page`` has to keep all rows before it.
    """
    kept = filter_activity(in_range(audit, "occurred_at", d0, d1), ids, actions).select(*EVENT_COLUMNS)
    if after:
        at, last = ts_literal(after[0]), after[1]
        kept = kept.where((F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("audit_id") > last)))
    ordered = kept.orderBy(F.desc("occurred_at"), "audit_id")
    rows = ordered.limit(limit) if after else ordered.offset((max(1, page) - 1) * limit).limit(limit)
    return named(rows, staff)


NEWEST_FIRST = (F.desc, "occurred_at"), (F.asc, "audit_id")


def index_activity(audit: DataFrame, path: str, d0, d1, ids: Sequence[str] = (), actions: Sequence[str] = ()) -> None:
    """Store the events of a filter for ``indexed_page``, for readers who jump to any page of a long list."""
    kept = filter_activity(in_range(audit, "occurred_at", d0, d1), ids, actions).select(*EVENT_COLUMNS)
    write_pages(kept, path, [by(c) for by, c in NEWEST_FIRST])


def indexed_page(audit: DataFrame, staff: DataFrame, path: str, page: int = 1, limit: int = 50) -> DataFrame:
    """``activity_page`` by number over stored events: reads the ranges of that page only. ``audit`` lends its schema."""
    schema = audit.select(*EVENT_COLUMNS).schema
    return named(read_page(audit.sparkSession, path, schema, [by(c) for by, c in NEWEST_FIRST], page, limit), staff)


def activity_meta(audit: DataFrame, d0, d1, limit: int = 50, ids: Sequence[str] = (), actions: Sequence[str] = ()) -> DataFrame:
    kept = filter_activity(in_range(audit, "occurred_at", d0, d1), ids, actions)
    return kept.agg(F.count(F.lit(1)).alias("total_events")).withColumn(
        "total_pages", F.ceil(F.col("total_events") / limit).cast("bigint"))


def staff_totals(daily: DataFrame, k: int | None = None) -> DataFrame:
    """Events per staff name, most first."""
    totals = (
        daily.groupBy(F.coalesce("full_name", F.lit("Unknown")).alias("name")).agg(F.sum("events").alias("total"))
        .orderBy(F.desc("total"), "name")
    )
    return totals if k is None else totals.limit(k)


def staff_list(staff: DataFrame) -> DataFrame:
    return staff.where(F.col("staff_id").isNotNull()).select("staff_id", full_name().alias("full_name")).orderBy(
        "full_name", "staff_id")


def action_list(audit: DataFrame) -> DataFrame:
    return audit.select("action").where(F.col("action").isNotNull()).distinct().orderBy("action")


def activity_report(audit: DataFrame, staff: DataFrame, kind: str, action: str = "comment") -> DataFrame:
    """Structural reports: ``actions``, ``staff_actions`` or ``comments`` (events of one action
    per staff). Staff without a first name show their id; ids are compared as text."""
    if kind == "actions":
        return audit.groupBy("action").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "action")
    who = staff.select(F.col("staff_id").cast("string").alias("staff_id"), "first_name")
    kept = audit.withColumn("staff_id", F.col("staff_id").cast("string"))
    person = F.coalesce("first_name", "staff_id").alias("employee")
    if kind == "comments":
        per_id = kept.where(F.col("action") == action).groupBy("staff_id").agg(F.count(F.lit(1)).alias("n"))
        return per_id.join(who, "staff_id", "left").groupBy(person).agg(F.sum("n").alias("events"))
    if kind == "staff_actions":
        per_id = kept.groupBy("staff_id", "action").agg(F.count(F.lit(1)).alias("n"))
        return per_id.join(who, "staff_id", "left").groupBy(person, "action").agg(F.sum("n").alias("events"))
    raise ValueError(f"unknown report {kind!r}")


def attribution_coverage(audit: DataFrame, staff: DataFrame) -> DataFrame:
    """Events per staff id and whether the id is a known, named staff member."""
    per_id = audit.where(F.col("staff_id").isNotNull()).groupBy("staff_id").agg(F.count("audit_id").alias("event_count"))
    who = staff.groupBy("staff_id").agg(F.max("first_name").alias("first_name"), F.max("last_name").alias("last_name"))
    return per_id.join(who, "staff_id", "left").withColumn("matched", F.col("first_name").isNotNull())


def unknown_staff(audit: DataFrame, staff: DataFrame) -> DataFrame:
    ids = audit.where(F.col("staff_id").isNotNull()).select("staff_id").distinct()
    return ids.join(staff.where(F.col("first_name").isNotNull()), "staff_id", "left_anti")


def event_profile(raw: DataFrame) -> DataFrame:
    """Counts of raw events along six dimensions at once, in long form."""
    human = F.coalesce("attributeToUser", F.lit(False))
    app = ~human & F.coalesce("attributeToApp", F.lit(False))

    def empty_as(c, label):
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(label)).otherwise(F.col(c))

    suffix = F.concat(F.lit("?"), F.split("id", r"\?").getItem(1))
    dims = [
        ("subject_type", empty_as("subjectType", "UNKNOWN")),
        ("action", empty_as("action", "UNKNOWN")),
        ("attribution", F.when(human, F.lit("human")).when(app, F.lit("app")).otherwise(F.lit("none"))),
        ("app", F.when(app, empty_as("appTitle", "Unknown App"))),
        ("human_day", F.when(human, F.substring_index("createdAt", "T", 1))),
        ("id_suffix", F.when(F.col("id").contains("?"), suffix)),
    ]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in dims])).alias("d")
    return raw.select(pairs).select("d.*").where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("events"))


def event_sample(raw: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """A random sample of human events, the same for a seed however the rows are dealt out."""
    return raw.where("attributeToUser").orderBy(F.md5(F.concat("id", F.lit(str(seed)))), "id").limit(n).select("id", "createdAt", "action", "message")


def assignments(assign: DataFrame, staff_code: str | None = None, include_expired: bool = False) -> DataFrame:
    kept = assign if include_expired else assign.where(F.col("valid_to").isNull())
    if staff_code:
        kept = kept.where(F.col("employee_code") == staff_code)
    return kept.select("employee_code", "team", "role", "valid_from", "valid_to", "is_primary", "allocation_pct").orderBy(
        "employee_code", F.desc("valid_from"), "role")
