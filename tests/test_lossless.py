"""Partition writes and defaults that must not lose rows, columns or characters."""

from datetime import date, datetime

from pyspark.sql import functions as F

from mostrador.operators import joins, team, traffic, upsert
from mostrador.operators.upsert import MergeSpec
from mostrador.sources import payloads as pl
from mostrador.sources import schemas
from mostrador.streaming import ingest

EVENT = "id bigint, v int, day date"


def land(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(path)


def stream(spark, path):
    return ingest.stream_files(spark, path, schemas.struct(EVENT), files_per_batch=1)


def test_one_day_over_several_batches_is_rewritten_whole(spark, tmp_path):
    src, out, day = str(tmp_path / "src"), str(tmp_path / "out"), date(2024, 1, 1)
    spark.createDataFrame([(9, 9, day), (8, 8, date(2024, 1, 2))], EVENT).write.partitionBy("day").parquet(out)
    for i in range(3):
        land(spark, src, [(i, i, day)])
    land(spark, src, [(7, 7, None)])
    ingest.rewrite_window(stream(spark, src), out, "day", str(tmp_path / "landing"), str(tmp_path / "checkpoint"))
    read = lambda: sorted(r.id for r in spark.read.schema(schemas.struct(EVENT)).parquet(out).collect())
    assert read() == [0, 1, 2, 7, 8]
    ingest.rewrite_window(stream(spark, src), out, "day", str(tmp_path / "landing-2"), str(tmp_path / "checkpoint"))
    assert read() == [0, 1, 2, 7, 8]


def test_merge_keeps_null_partitions_and_own_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, 1, "a", None), (2, 2, "b", None), (3, 3, "c", "007"), (4, 4, "d", "x")]
    spark.createDataFrame(rows, "id int, v int, extra string, part string").write.partitionBy("part").parquet(path)
    batch = spark.createDataFrame([(5, 50, None), (1, 10, None), (3, 30, "007")], "id int, v int, part string")
    upsert.merge_into_path(batch, path, "part", MergeSpec(("id",)))
    got = spark.read.schema("id int, v int, extra string, part string").parquet(path).collect()
    assert sorted(map(tuple, got)) == [(1, 10, "a", None), (2, 2, "b", None), (3, 30, "c", "007"), (4, 4, "d", "x"), (5, 50, None, None)]


def test_partition_choice_is_the_same_on_either_way(spark):
    target = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, part string")
    for named in (["a"], [None], ["a", None], []):
        batch = spark.createDataFrame([(9, n) for n in named], "id int, part string")
        want = sorted(r.id for r in target.collect() if r.part in named)
        assert [sorted(r.id for r in upsert.only_partitions(target, batch, "part", k).collect()) for k in (0, 10)] == [want, want]


def test_late_older_event_does_not_replace_a_newer_row(spark, tmp_path):
    src, out, day = str(tmp_path / "src"), str(tmp_path / "out"), date(2024, 1, 1)
    sink = ingest.stream_upsert(out, "day", MergeSpec(("id",)), schemas.struct(EVENT), "v")
    for v in (5, 3):
        land(spark, src, [(1, v, day)])
        ingest.run_available(stream(spark, src), str(tmp_path / "checkpoint"), sink)
    assert [r.v for r in spark.read.parquet(out).collect()] == [5]


def test_long_handles_match(spark):
    products = spark.createDataFrame([(1, "h" * 300), (2, "mini"), (3, None), (4, "")], "id int, handle string")
    gsc = spark.createDataFrame([("https://x/products/" + "h" * 300 + "?a",), ("https://x/products/mini-pro",)], "page string")
    assert sorted(r.product_id for r in joins.product_pages_all(gsc, products).collect()) == [1, 2]


def test_message_ids_and_samples_are_the_same_at_any_partitioning(spark):
    raw = spark.range(200).select(F.lit("text").alias("type"), F.lit(None).cast("string").alias("fingerprint"), F.col("id").cast("string").alias("session_id"),
                                  F.col("id").alias("timestamp"), F.lit("user").alias("from"), F.struct(F.lit("n").alias("nickname")).alias("user"), F.lit("hi").alias("content"))
    ids = [sorted(r.message_id for r in pl.flatten_messages(raw.repartition(n)).collect()) for n in (2, 40)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 200
    events = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("attributeToUser"), F.lit("c").alias("createdAt"),
                                     F.lit("a").alias("action"), F.lit("m").alias("message"))
    a, b = ([r.id for r in team.event_sample(events.repartition(n)).collect()] for n in (2, 40))
    assert a == b and len(a) == 20


def test_orders_are_filtered_before_they_are_counted(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.createDataFrame([(1, datetime(2024, 1, 1, 5), "paid"), (2, datetime(2020, 1, 1), "paid")], "id int, created_at timestamp, financial_status string").write.parquet(path)
    traffic = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "date date")
    df = joins.traffic_with_orders(traffic, spark.read.parquet(path), "2024-01-01", "2024-01-02")
    assert sorted((str(r.date), r.orders) for r in df.collect()) == [("2024-01-01", 1), ("2024-01-02", 0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(created_at" in plan


def test_spend_and_conversions_cover_the_same_campaigns(spark):
    days = [(1, "2024-01-01", "REMOVED"), (1, "2024-01-02", "ENABLED"), (2, "2024-01-01", "ENABLED"), (2, "2024-01-02", "REMOVED")]
    ads = spark.createDataFrame(days, "campaign_id long, date string, status string").withColumn("date", F.col("date").cast("date"))
    conv = ads.withColumn("conversions", F.lit(1.0)).withColumn("category", F.lit("PURCHASE"))
    spent = traffic._live(ads, "2024-01-01", "2024-01-02").groupBy("campaign_id").count().collect()
    bought = traffic._counted(conv, ads, "2024-01-01", "2024-01-02").groupBy("campaign_id").count().collect()
    assert spent == bought == [(1, 2)]
