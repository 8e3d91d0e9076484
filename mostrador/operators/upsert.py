"""Keyed merges over DataFrames, staff assignments over time, incremental windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import skew
from ..functions.dates import ts_literal
from ..sources.tables import by_partition


@dataclass(frozen=True)
class MergeSpec:
    """How a batch enters a table.

    ``update_cols`` are overwritten on matched rows (None: all but the keys; (): none).
    ``clauses`` replaces that by an ordered list of (condition, columns): the first
    condition that holds for a matched row decides which columns it takes. Conditions see
    both rows as the structs ``t`` and ``s``. ``defaults`` fills inserted rows.
    """

    keys: tuple[str, ...]
    update_cols: tuple[str, ...] | None = None
    clauses: tuple[tuple[Column, tuple[str, ...]], ...] = ()
    defaults: Mapping[str, Column] = field(default_factory=dict)


def unique_source(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One struct ``s`` per key; a key that comes twice fails the job. Rows with a null in their key equal nothing, not even
    each other, so each stays a row of its own."""
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    row = F.struct(*source.columns)
    per_key = source.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("s"))
    twice = F.raise_error(F.concat_ws(" ", F.lit("several source rows for key"), *[F.col(k).cast("string") for k in keys]))
    checked = per_key.select(*keys, F.when(F.col("_n") > 1, twice.cast(per_key.schema["s"].dataType)).otherwise(F.col("s")).alias("s"))
    return checked.unionByName(source.where(~whole).select(*keys, row.alias("s")))


def upsert(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """The target after the merge: one full outer join, one expression per column."""
    keys = list(spec.keys)
    names = target.columns
    given = set(source.columns)
    t = target.select(*keys, F.struct(*names).alias("t"))
    both = t.join(unique_source(source, keys), keys, "full_outer")
    matched, inserted = F.col("t").isNotNull() & F.col("s").isNotNull(), F.col("t").isNull()
    clauses = spec.clauses
    if not clauses:
        cols = [c for c in names if c not in keys] if spec.update_cols is None else list(spec.update_cols)
        clauses = ((F.lit(True), tuple(cols)),)

    def merged(name: str) -> Column:
        dtype = target.schema[name].dataType
        if name in keys:
            return F.col(name).alias(name)
        new = F.col(f"s.{name}").cast(dtype) if name in given else F.lit(None).cast(dtype)
        default = spec.defaults.get(name)
        insert = new if default is None else F.coalesce(new, default.cast(dtype))
        out = F.when(inserted, insert)
        for cond, cols in clauses:
            takes = new if name in cols and name in given else F.col(f"t.{name}")
            out = out.when(matched & F.coalesce(cond, F.lit(False)), takes)
        return out.otherwise(F.col(f"t.{name}")).alias(name)

    return both.select(*[merged(c) for c in names])


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add source rows whose key is new; applying the same batch twice changes nothing."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


# Matched rows without a score take the score; all other matched rows take text and operator.
def message_clauses() -> tuple:
    first = F.col("t.sentiment_score").isNull() & F.col("s.sentiment_score").isNotNull()
    return (
        (first, ("sentiment_score", "sentiment_magnitude")),
        (F.lit(True), ("content", "operator_name")),
    )


def set_flag(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Set a flag on the listed rows."""
    listed = ids.select(key).distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, key, "left").withColumn(flag, F.coalesce("_listed", flag)).select(*df.columns)


def scd2_apply(assign: DataFrame, changes: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Close and open assignments.

    ``changes`` has employee_code, team, role, allocation_pct, valid_from, valid_to (null
    for open), is_primary, assignment_id and ``seq``, the order of application. A primary
    change closes every open primary of the employee on the day before it starts; several
    changes of one employee close each other in turn.

    The next primary change is looked for inside chunks of ``chunk`` positions and, for the
    last one of a chunk, in the first primary of the following chunk that has one, so an
    employee with very many changes is spread over tasks.
    """
    names = assign.columns
    numbered = changes.withColumn("_chunk", F.floor(F.col("seq") / chunk)).repartition("employee_code", "_chunk")
    later = Window.partitionBy("employee_code", "_chunk").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("is_primary"), F.col("valid_from"))
    inside = numbered.withColumn("_inside", F.last(starts, ignorenulls=True).over(later))
    heads = numbered.where("is_primary").groupBy("employee_code", "_chunk").agg(F.min_by("valid_from", "seq").alias("_head"))
    seam = Window.partitionBy("employee_code").orderBy("_chunk")
    beyond = heads.select("employee_code", "_chunk", F.lead("_head").over(seam).alias("_beyond"))
    added = inside.join(beyond, ["employee_code", "_chunk"], "left").withColumn("_next", F.coalesce("_inside", "_beyond"))
    first = changes.where("is_primary").groupBy("employee_code").agg(F.min_by("valid_from", "seq").alias("_next"))

    def close(df: DataFrame) -> DataFrame:
        ends = F.col("is_primary") & F.col("valid_to").isNull() & F.col("_next").isNotNull()
        return df.withColumn("valid_to", F.when(ends, F.date_sub("_next", 1)).otherwise(F.col("valid_to")))

    closed = close(assign.join(first, "employee_code", "left")).select(*names)
    opened = close(added)
    return closed.unionByName(opened.select(*[c for c in names if c in opened.columns]), allowMissingColumns=True)


def changeable(changes: DataFrame, assign: DataFrame) -> DataFrame:
    """Changes of employees that have an open primary assignment (a plain change needs one)."""
    open_ = assign.where(F.col("is_primary") & F.col("valid_to").isNull())
    return changes.join(open_, "employee_code", "left_semi")


def high_water(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Newest event time and its id, the mark of the next run."""
    last = F.max(F.struct(F.col(ts), F.col(key)))
    return df.agg(last.alias("m")).select(F.col(f"m.{ts}").alias("last_processed_at"), F.col(f"m.{key}").alias("last_event_id"))


def window_start(now: datetime, mark: datetime | None = None, since: datetime | None = None,
                 backfill_days: int | None = None, overlap: timedelta = timedelta(hours=2)) -> datetime:
    """Start of an incremental run: back-fill, else a given start, else the mark; minus the overlap."""
    if backfill_days is not None:
        start = now - timedelta(days=backfill_days)
    elif since is not None:
        start = since
    elif mark is not None:
        start = mark
    else:
        raise ValueError("no earlier run: give a start or the days to back-fill")
    return start - overlap


def rows_in_window(df: DataFrame, ts: str, start: datetime) -> DataFrame:
    return df.where(F.col(ts) >= ts_literal(start))


def changed_since(df: DataFrame, t) -> DataFrame:
    at = ts_literal(t)
    return df.where((F.col("updated_at") >= at) | (F.col("created_at") >= at))


def unsynced(conversations: DataFrame) -> DataFrame:
    """Flag is false or null."""
    return conversations.where(~F.coalesce("messages_synced", F.lit(False)))


MIN_TEXT = 3


def pending_sentiment(messages: DataFrame, k: int | None = None) -> DataFrame:
    """User texts without a score; with ``k`` the so many oldest, as one run."""
    rows = messages.where(
        (F.col("sender_type") == "user") & F.col("sentiment_score").isNull() & (F.length("content") > MIN_TEXT))
    return rows if k is None else rows.orderBy("created_at", "message_id").limit(k)


def enrich_pending(messages: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int | None = None) -> DataFrame:
    """Score pending texts and merge the scores back where there are none."""
    scored = scorer(pending_sentiment(messages, k)).where(F.col("sentiment_score").isNotNull())
    spec = MergeSpec(keys=("message_id",), clauses=message_clauses())
    return upsert(messages, scored.select(*messages.columns), spec)


def merge_preview(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a merge would insert and update."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    n = F.count(F.lit(1))
    return source.join(known, list(keys), "left").agg(
        n.alias("rows"), F.count(F.when(F.col("_known").isNull(), 1)).alias("to_insert"),
        F.count(F.when(F.col("_known"), 1)).alias("to_update"))


def load_batch(batch: DataFrame, target: DataFrame, spec: MergeSpec, order: Sequence[Column]) -> DataFrame:
    """First-seen rows of a landed batch merged into the target, in one plan."""
    first = skew.top_per_key(batch, spec.keys, order, 1).drop("rn")
    return upsert(target, first, spec)


def only_partitions(target: DataFrame, batch: DataFrame, part: str, limit: int = 10_000) -> DataFrame:
    """The target's rows in the partitions a batch names, the null partition included.

    Up to ``limit`` partition values become a literal filter, so that the scan lists only
    those folders; beyond that a semi join gives the same rows.
    """
    named = batch.select(F.col(part).alias("_named")).distinct()
    values = [r[0] for r in named.limit(limit + 1).collect()]
    if len(values) > limit:
        return target.join(named, F.col(part).eqNullSafe(F.col("_named")), "left_semi")
    known = F.col(part).isin([v for v in values if v is not None])
    return target.where(F.coalesce(known, F.lit(False)) | F.col(part).isNull() if None in values else known)


def read_target(spark, path: str, part: str, like: StructType) -> DataFrame:
    """A partitioned table with all columns any of its files has, and those of ``like``; the
    partition column keeps the type it has there."""
    known = spark.read.schema(like).parquet(path)
    if known.isEmpty():
        return known
    own = spark.read.option("mergeSchema", "true").parquet(path).schema
    fields = [f for f in own if f.name not in like.names] + list(like)
    return spark.read.schema(StructType(fields)).parquet(path).select([f.name for f in own] + [n for n in like.names if n not in own.names])


def merge_into_path(batch: DataFrame, path: str, part: str, spec: MergeSpec) -> None:
    """Merge a batch into a table partitioned by ``part``, touching only its partitions.

    The partition column must not change for a key (a creation day, say). Only the
    partitions the batch names are read, merged and replaced; the others stay as they are.
    Columns that the batch lacks keep their values.
    """
    target = read_target(batch.sparkSession, path, part, batch.schema)
    merged = upsert(only_partitions(target, batch, part), batch, spec)
    (by_partition(merged, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))
