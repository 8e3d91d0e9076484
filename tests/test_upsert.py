import pytest
from pyspark.sql import functions as F

from mostrador.functions.exprs import wavg
from mostrador.operators import scoring, upsert
from mostrador.operators.upsert import MergeSpec
from mostrador.session import scratch_path
from mostrador.streaming import ingest

DDL = "id int, a string, b string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_twice_is_once(spark):
    target = spark.createDataFrame([(1, "x", "y"), (2, "x", None)], DDL)
    batch = spark.createDataFrame([(2, "n", "m"), (3, None, "m")], DDL)
    spec = MergeSpec(("id",), ("a",), defaults={"a": F.lit("new")})
    once = upsert.upsert(target, batch, spec)
    assert rows(once) == [(1, "x", "y"), (2, "n", None), (3, "new", "m")]
    assert rows(upsert.upsert(once, batch.fillna("new"), spec)) == rows(once)
    added = upsert.insert_missing(target, batch, ["id"])
    assert rows(upsert.insert_missing(added, batch, ["id"])) == rows(added) == [(1, "x", "y"), (2, "x", None), (3, None, "m")]


def test_duplicate_keys_fail(spark):
    batch = spark.createDataFrame([(1, "p", "q"), (1, "r", "s")], DDL)
    with pytest.raises(Exception, match="several source rows for key 1"):
        upsert.upsert(spark.createDataFrame([(1, "x", "y")], DDL), batch, MergeSpec(("id",))).collect()


def test_first_clause_wins(spark):
    ddl = "message_id string, content string, operator_name string, sentiment_score double, sentiment_magnitude double"
    target = spark.createDataFrame([("m1", "old", "o", None, None), ("m2", "old", "o", 0.5, 1.0), ("m3", "old", "o", None, None)], ddl)
    batch = spark.createDataFrame([("m1", "new", "p", 0.1, 2.0), ("m2", "new", "p", 0.9, 2.0), ("m3", "new", "p", None, None)], ddl)
    out = upsert.upsert(target, batch, MergeSpec(("message_id",), clauses=upsert.message_clauses()))
    assert rows(out) == [("m1", "old", "o", 0.1, 2.0), ("m2", "new", "p", 0.5, 1.0), ("m3", "new", "p", None, None)]


def test_merge_touches_only_named_partitions(spark):
    ddl = "id int, v string, day date"
    path = scratch_path(spark, "merge")
    first = spark.sql("select 1 id, 'a' v, date'2024-01-01' day union all select 2, 'a', date'2024-01-02'")
    first.write.partitionBy("day").parquet(path)
    import glob

    before = set(glob.glob(f"{path}/day=2024-01-01/*.parquet"))
    batch = spark.sql("select 2 id, 'b' v, date'2024-01-02' day union all select 3, 'c', date'2024-01-03'")
    upsert.merge_into_path(batch, path, "day", MergeSpec(("id",), ("v",)))
    out = spark.read.schema(ddl).parquet(path)
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert set(glob.glob(f"{path}/day=2024-01-01/*.parquet")) == before


def test_scorer_failures_are_null(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "good day"), ("3", None), ("4", "boom!")], "message_id string, content string")

    def factory():
        return lambda texts: [None if "boom" in t else (0.5, 1.0) for t in texts]

    out = {r.message_id: r.sentiment_score for r in scoring.score_texts(df, factory).collect()}
    assert out == {"1": None, "2": 0.5, "3": None, "4": None}


def test_window_start():
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 10)
    assert upsert.window_start(now, backfill_days=2) == datetime(2024, 1, 7, 22)
    assert upsert.window_start(now, mark=datetime(2024, 1, 9), overlap=timedelta(hours=24)) == datetime(2024, 1, 8)
    with pytest.raises(ValueError):
        upsert.window_start(now)


def test_merge_lists_only_named_folders(spark):
    path = scratch_path(spark, "pruned")
    spark.sql("select id, date_add(date'2024-01-01', cast(id as int)) day from range(5)").write.partitionBy("day").parquet(path)
    target = spark.read.schema("id long, day date").parquet(path)
    batch = spark.sql("select 9L id, date'2024-01-03' day")
    pruned = upsert.only_partitions(target, batch, "day")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in pruned.collect()] == [2] and upsert.only_partitions(target, batch, "day", 0).count() == 1


def test_null_keys_enter_as_rows_of_their_own(spark):
    target = spark.createDataFrame([(1, "a"), (None, "kept")], "id long, v string")
    batch = spark.createDataFrame([(1, "b"), (None, "x"), (None, "y")], "id long, v string")
    out = upsert.upsert(target, batch, upsert.MergeSpec(("id",)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "b"), (None, "kept"), (None, "x"), (None, "y")], key=repr)


def test_repeated_batch_with_null_keys_changes_nothing(spark):
    path = scratch_path(spark, "null-keys")
    schema = spark.createDataFrame([], "id long, v string, day date").schema
    write = ingest.insert_only(path, "day", ["id"], schema)
    batch = spark.sql("select * from values (1L, 'a', date'2024-01-01'), (null, 'x', date'2024-01-01'), (null, 'y', date'2024-01-01') t(id, v, day)")
    for n in range(2):
        write(batch, n)
        assert sorted(r.v for r in spark.read.schema(schema).parquet(path).collect()) == ["a", "x", "y"]


def test_insert_only_leaves_held_partitions_alone(spark):
    import os

    path = scratch_path(spark, "held")
    schema = spark.createDataFrame([], "id long, v string, day date").schema
    write = ingest.insert_only(path, "day", ["id"], schema)
    files = lambda: {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}
    batch = "select * from values (1L, 'a', date'2024-01-01'), (null, 'x', date'2024-01-01'), (2L, 'b', date'2024-01-02')"
    write(spark.sql(batch + " t(id, v, day)"), 0)
    first = files()
    write(spark.sql(batch + " t(id, v, day)"), 1)
    assert files() == first and len(first) == 2
    write(spark.sql(batch + ", (3L, 'c', date'2024-01-02') t(id, v, day)"), 2)
    assert [d for d in first if files()[d] != first[d]] == ["day=2024-01-02"]
    assert sorted(r.v for r in spark.read.schema(schema).parquet(path).collect()) == ["a", "b", "c", "x"]


def test_insert_only_keeps_no_batch_in_memory(spark, monkeypatch):
    import os

    path, df = scratch_path(spark, "unheld"), type(spark.range(0))
    monkeypatch.setattr(df, "persist", lambda *a, **b: pytest.fail("a batch in the executors' memory"))
    schema = spark.createDataFrame([], "id long, v string, day date").schema
    write = ingest.insert_only(path, "day", ["id"], schema)
    for n, last in enumerate(("a", "b")):
        write(spark.sql(f"select * from values (1L, 'a', date'2024-01-01'), (1L, 'a', date'2024-01-01'), ({n + 2}L, '{last}', null) t(id, v, day)"), n)
    assert sorted((r.id, r.v) for r in spark.read.schema(schema).parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    # What it wrote meanwhile goes with the batch, also when that fails.
    with pytest.raises(Exception):
        write(spark.sql("select id, raise_error('x') v, day from values (4L, date'2024-01-01') t(id, day)"), 2)
    assert not [f for f in os.listdir(os.path.dirname(path)) if f.startswith(("batch-rows", "new-rows"))]


def test_weighted_mean_does_not_depend_on_order(spark):
    df = spark.range(5000).selectExpr("1 + pmod(hash(id), 10007) / 331.0D as position", "pmod(hash(id, 1), 9973) as impressions")
    assert len({df.repartition(n).agg(wavg("position", "impressions")).first()[0] for n in (1, 3, 7, 16)}) == 1
