"""Query registration and the SQL fragments the counterparts share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Ranges that hold all rows of the order tables and of the event tables.
D0, D1 = "1990-01-01", "2010-12-31"
E0, E1 = "2023-12-31", "2024-02-01"


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    used = [n for n in VIEWS if n in _closure(used)]
    if not used:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def _closure(names: Sequence[str]) -> set[str]:
    seen: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]
    return seen


def query(key: str, sql: str | None = None, text: Sequence[str] = ()):
    """Register a query. ``text`` names date, time and array columns that are compared as text."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = build(Tables(spark, sf_dir))
            for c in text:
                df = df.withColumn(c, F.col(c).cast("string"))
            return df

        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql is not None:
            body = with_views(sql)
            if text:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
                body = f"SELECT * REPLACE ({casts}) FROM (\n{body}\n) q"
            ORACLES[key] = body
        return build

    return register


# --- SQL fragments --------------------------------------------------------------------

NET = "financial_status IN ('paid', 'partially_refunded')"


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def money_if(cond: str, x: str) -> str:
    zero = "CAST(0 AS DECIMAL(18,2))"
    return f"CAST(SUM(CASE WHEN {cond} THEN CAST({x} AS DECIMAL(18,2)) ELSE {zero} END) AS DOUBLE)"


def total(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def count_if(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def div0(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0e0 END"


def pct0(n: str, d: str) -> str:
    return f"({div0(n, d)}) * 100e0"


def safe(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0e0)"


def js(x: str, n: int = 0) -> str:
    return f"floor(({x}) * 1e{n} + 0.5e0) / 1e{n}"


def wavg(v: str, w: str) -> str:
    return f"SUM({v} * {w}) / NULLIF(SUM({w}), 0)"
