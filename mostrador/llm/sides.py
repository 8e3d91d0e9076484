"""Sides of a join that may be sent to every task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hashed_in

# Rows up to which a side is sent; at some tens of bytes a row that is some tens of MB. Beyond, both sides are shuffled.
SENT = 500_000


def few(df: DataFrame, limit: int | None = None) -> bool:
    """``df``, a stored table, was counted to be within the limit."""
    limit = SENT if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Marked for sending if it was counted to be within the limit. ``df`` is a stored table, so that counting is cheap."""
    return F.broadcast(df) if few(df, limit) else df


def meeting(wide: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``wide`` joined with the stored table ``rows``. Too many rows to send are shuffled, and with them only such wide rows
    whose key is one of theirs by a hash."""
    if few(rows):
        return wide.join(F.broadcast(rows), key)
    return wide.filter(hashed_in(rows.select(key))(F.col(key))).join(rows, key)


def file_of() -> Column:
    """Names the file of a stored table that a row is read from."""
    return F.xxhash64("_metadata.file_name")


def meeting_by_file(wide: DataFrame, rows: DataFrame, keys: Sequence[str]) -> Iterator[DataFrame]:
    """The stored table ``wide`` joined with the stored table ``rows``, which says in ``file`` where its keys are to be found.

    Each DataFrame holds some of the files and sends what rows name them, as many as a side may have; so wide rows are read
    once and never shuffled, however many rows there are.
    """
    parts: list[tuple[list[int], int]] = [([], 0)]
    for file, n in sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()):
        files, have = parts[-1]
        if files and have + n > SENT:
            parts.append(([file], n))
        else:
            parts[-1] = ([*files, file], have + n)
    for files, n in parts:
        # One file may hold more than is sent.
        pieces = max(1, -(-n // SENT))
        for i in range(pieces):
            mine = F.pmod(F.xxhash64(*keys), F.lit(pieces)) == i if pieces > 1 else F.lit(True)
            sent = rows.filter(F.col("file").isin(files)).filter(mine).drop("file")
            yield wide.filter(file_of().isin(files)).filter(mine).join(F.broadcast(sent), list(keys))
