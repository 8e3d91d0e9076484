"""Checks of hand-filled staff files: an error list per row, and a gate on the whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import not_empty

# Accepted teams and patterns.
TEAMS = ("management", "support_ecommerce", "operations", "customer_service", "executive")
CODE_PATTERN = r"\A[a-z0-9._-]+\z"
DATE_PATTERN = r"\A\d{4}-\d{2}-\d{2}\z"


def _errors(checks: list[tuple[Column, str]]) -> Column:
    found = [F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for cond, name in checks]
    return F.array_compact(F.array(*found))


def _bad_date(c: str) -> Column:
    return ~F.col(c).rlike(DATE_PATTERN) | F.col(c).try_cast("date").isNull()


def _repeated(df: DataFrame, key: str, valid: Column, flag: str) -> DataFrame:
    """Mark rows after the first (by ``line``) of a repeated valid key."""
    firsts = df.where(valid).groupBy(key).agg(F.min("line").alias("_first"))
    again = F.coalesce(valid & (F.col("line") > F.col("_first")), F.lit(False))
    return df.join(firsts, key, "left").withColumn(flag, again).drop("_first")


def validate_staff(df: DataFrame) -> DataFrame:
    """Rows of a staff file with ``line`` (its order) and an ``errors`` array."""
    rows = df.withColumn("_active", F.upper(F.coalesce(not_empty("active"), F.lit("TRUE"))))
    id_ok = F.coalesce(F.col("staff_id").rlike(r"\A\d+\z"), F.lit(False))
    code_ok = F.coalesce(F.col("employee_code").rlike(CODE_PATTERN), F.lit(False))
    rows = _repeated(rows, "staff_id", id_ok, "_id_again")
    rows = _repeated(rows, "employee_code", code_ok, "_code_again")
    errors = _errors([
        (~id_ok, "staff_id"),
        (F.col("_id_again"), "staff_id duplicate"),
        (~F.coalesce(F.col("email").contains("@"), F.lit(False)), "email"),
        (~code_ok, "employee_code"),
        (F.col("_code_again"), "employee_code duplicate"),
        (~F.col("_active").isin("TRUE", "FALSE"), "active"),
        (not_empty("joined_at").isNotNull() & _bad_date("joined_at"), "joined_at"),
    ])
    return rows.select(
        "line", "staff_id", "email", not_empty("first_name").alias("first_name"), not_empty("last_name").alias("last_name"),
        "employee_code", (F.col("_active") == "TRUE").alias("active"),
        not_empty("joined_at").try_cast("date").alias("joined_at"), errors.alias("errors"))


def validate_assignments(df: DataFrame, staff: DataFrame) -> DataFrame:
    """Rows of an assignment file that name a new team, with an ``errors`` array."""
    known = staff.select("employee_code").distinct().withColumn("_known", F.lit(True))
    pct = F.coalesce(not_empty("allocation_pct"), F.lit("100"))
    share = F.regexp_extract(pct, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    rows = df.where(not_empty("new_team").isNotNull()).join(known, "employee_code", "left")
    errors = _errors([
        (~F.col("new_team").isin(*TEAMS), "team"),
        (F.col("_known").isNull(), "employee_code"),
        (_bad_date("valid_from"), "valid_from"),
        (~share.between(1, 100), "allocation_pct"),
    ])
    primary = F.when(not_empty("is_primary").isNull(), F.lit(True)).otherwise(F.upper("is_primary") == "TRUE")
    return rows.select(
        "line", "employee_code", F.col("new_team").alias("team"), F.coalesce("new_role", F.lit("")).alias("role"),
        F.col("valid_from").try_cast("date").alias("valid_from"), share.alias("allocation_pct"),
        primary.alias("is_primary"), F.coalesce("notes", F.lit("")).alias("notes"), errors.alias("errors"))


def accept_file(checked: DataFrame) -> DataFrame:
    """All rows when none has an error, otherwise none: any error rejects the file."""
    bad = checked.agg(F.count(F.when(F.size("errors") > 0, 1))).scalar()
    return checked.where(bad == 0).drop("errors")
