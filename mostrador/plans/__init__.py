"""Registered queries: each names an operator, runs it over whole tables and, where SQL can
say the same, carries that SQL."""

from . import registry


def load_all() -> None:
    from . import (  # noqa: F401
        q_joins, q_market, q_payloads, q_sales, q_scalars, q_series, q_sources, q_streaming, q_support, q_team,
        q_traffic, q_upsert,
    )


def queries():
    load_all()
    return dict(registry.QUERIES)


def oracle_sql():
    load_all()
    return dict(registry.ORACLES)
