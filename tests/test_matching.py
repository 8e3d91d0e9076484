"""What matching sends through shuffles, and what it may leave out."""

import random

from pyspark.sql import functions as F

from mostrador.functions import skew
from mostrador.operators import joins


def test_only_likely_needles_leave_a_text(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(200)]
    needles = sorted({t[i:i + n] for t in texts[:20] for i, n in ((3, 9), (40, 2), (70, 4), (90, 30))})
    hay = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = spark.createDataFrame([(n,) for n in needles], "w string")
    rows = [(r.i, r.needle) for r in skew.contained(hay, ["i"], "t", words, "w").collect()]
    want = {(i, n) for i, t in enumerate(texts) for n in needles if n in t}
    assert want <= set(rows) and all(n in texts[i] for i, n in rows)
    # Before, each of the 40,000 positions went to the join for each length of a start in use.
    assert len(set(rows)) < 2 * len(want) and len(rows) < 20_000, (len(rows), len(set(rows)), len(want))


def test_words_that_may_be_names(spark):
    hay = spark.createDataFrame([(1, "ana li asked juan"), (2, "banana lili"), (3, ""), (4, None)], "i int, t string")
    names = spark.createDataFrame([("ana li",), ("juan",), ("",)], "n string")
    assert {(1, "ana li"), (1, "juan")} <= {(r.i, r.needle) for r in skew.contained_words(hay, ["i"], "t", names, "n").collect()}
    assert {(r.i, r.n) for r in skew.word_matches(hay, ["i"], "t", names, "n").collect()} == {(1, "ana li"), (1, "juan")}


def test_hashed_in_holds_every_value(spark):
    for n in (0, 1, 5000):
        may_be = skew.hashed_in(spark.range(n).select(F.concat(F.lit("v"), "id").alias("v")))
        got = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("v")).where(may_be(F.col("v"))).select(F.substring("v", 2, 9).cast("int").alias("v"))
        found = {r.v for r in got.collect()}
        assert found >= set(range(n)) and len(found) < n + 2000


def test_long_messages_are_not_shuffled_by_position(spark):
    """The rows that reach the matching joins grow with the names found, not with the characters."""
    staff = spark.createDataFrame([(f"s{i}", i, f"quentin{i}", f"zyl{i}") for i in range(300)], "staff_id string, list_pos int, first_name string, last_name string")
    message = "nothing of note was changed by anyone at all today " * 100
    events = spark.range(40).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit(message), F.when(F.col("id") % 2 == 0, "Quentin7 Zyl7").otherwise("")).alias("message"),
                                    F.lit(None).cast("struct<id:string>").alias("author"))
    out = joins.attribute_staff(events, staff)
    assert {r.id: r.staff_id for r in out.collect()} == {f"e{i}": "s7" if i % 2 == 0 else None for i in range(40)}
    hits = skew.contained(events.select("id", F.lower("message").alias("t")), ["id"], "t", staff.select(F.concat_ws(" ", F.lower("first_name"), F.lower("last_name")).alias("f")), "f")
    assert hits.count() < 200


def test_tasks_hold_the_bits_of_few_names(spark, monkeypatch):
    """Each rule is looked up in a job of its own, so that no plan carries the bits of all names at once."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    cut, store = joins.cut_lineage, getattr(joins, "store_parts", None)
    monkeypatch.setattr(joins, "cut_lineage", lambda spark, df, name: cut(spark, seen(df), name))
    monkeypatch.setattr(joins, "store_parts", lambda spark, parts, name: store(spark, [seen(df) for df in parts], name), raising=False)
    staff = spark.createDataFrame([(f"s{i}", i, f"quentin{i}", f"zyl{i}") for i in range(9)], "staff_id string, list_pos int, first_name string, last_name string")
    events = spark.createDataFrame([("a", "Quentin3 Zyl3 sent it"), ("b", "by <a>Zyl4 - Quentin4</a>"), ("c", "<a>quentin5</a> and zyl9"), ("d", "zyl1")], "id string, message string")
    out = joins.attribute_staff(events.withColumn("author", F.lit(None).cast("struct<id:string>")), staff)
    assert {r.id: r.staff_id for r in out.collect()} == {"a": "s3", "b": "s4", "c": "s5", "d": None}
    seen(out)
    # A start, a whole name and the name it is joined with, of both names of a pair.
    held = [p.count("getbit(") for p in plans]
    assert max(held) <= 6 < sum(held), held


def test_bits_are_put_together_by_runs(spark):
    values = spark.range(70_000).select(F.concat(F.lit("v"), "id").alias("v"))
    may_be = skew.hashed_in(values)
    plan = spark.range(1).where(may_be(F.lit("v1"))).select("id")
    assert "flatten(" in plan._jdf.queryExecution().analyzed().toString()
    got = spark.range(60_000, 200_000).select(F.concat(F.lit("v"), "id").alias("v")).where(may_be(F.col("v")))
    assert got.where("cast(substr(v, 2) as int) < 70000").count() == 10_000 and got.count() < 30_000
