import os
import re
from datetime import date

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mostrador.session import cut_lineage, scratch_path
from mostrador.sources import schemas, tables
from mostrador.streaming import ingest


def lines(spark, text, name="in.txt"):
    folder = scratch_path(spark, "text")
    os.makedirs(folder)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)
    return folder


def test_staff_csv(spark):
    path = lines(spark, '# a\n\nstaff_id,email,first_name,last_name,employee_code,active,joined_at\n1, a@b ,"Ana, M",Li,ana.li,TRUE,2024-01-02\n#2,x\n3,c@d,,,c.d,,\n')
    got = sorted(tuple(r) for r in tables.read_staff_csv(spark, path).collect())
    assert got == [("1", "a@b", "Ana, M", "Li", "ana.li", "TRUE", "2024-01-02"), ("3", "c@d", None, None, "c.d", None, None)]


def test_staff_csv_header_is_the_first_line_whatever_it_says(spark):
    path = lines(spark, "# a\n\nID;Mail,Name\n1,a@b,Ana,Li,ana.li,TRUE,2024-01-02\nstaff_id,email,first_name,Li,x,y,z\n")
    assert sorted(r[0] for r in tables.read_staff_csv(spark, path).collect()) == ["1", "staff_id"]


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, "plain")], "i int, t string")
    path = scratch_path(spark, "csv")
    tables.write_csv(df, path)
    back = spark.read.schema(df.schema).option("header", "true").option("escape", '"').csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert '"say ""hi"", ok"' in text


def test_corrupt_json_is_kept_aside(spark):
    path = lines(spark, '{"i": 1}\n{"i": \n', "in.json")
    rows = tables.read_ndjson(spark, path, schemas.struct("i int")).cache()
    assert rows.where("_corrupt is null").count() == 1 and rows.where("_corrupt is not null").count() == 1


def test_evolve_and_retain(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 3, 1))], "i int, d date")
    grown = tables.evolve(df, schemas.struct("i long, d date, note string"))
    assert grown.dtypes == [("i", "bigint"), ("d", "date"), ("note", "string")] and grown.where("note is null").count() == 2
    assert [r.i for r in tables.retain(df, "d", 30, date(2024, 3, 5)).collect()] == [2]


def test_tail_of_empty_table(spark):
    empty = spark.createDataFrame([], "date date, v int")
    fresh = spark.createDataFrame([(date(2024, 1, 1), 1)], "date date, v int")
    cutoff = tables.tail_cutoff(empty, "date", 3, "2023-06-01")
    assert cutoff.first().cutoff == date(2023, 6, 1)
    assert tables.rewrite_tail(empty, fresh, "date", cutoff).count() == 1


def test_layout_spreads_a_large_day(spark):
    df = spark.range(200_000).select(F.lit("2024-01-01").cast("date").alias("day"), F.uuid().alias("k"))
    path, size = scratch_path(spark, "layout"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1MB")
    tables.write_layout(df.repartition(8), path, "day", ["k"])
    spark.conf.unset(size)
    files = [f for f in os.listdir(f"{path}/day=2024-01-01") if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(path).count() == 200_000


def test_stream_resumes_from_its_checkpoint(spark):
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "out", "check"))
    schema = schemas.struct("id int, day date")

    def land(ids):
        spark.createDataFrame([(i,) for i in ids], "id int").withColumn("day", F.lit("2024-01-01").cast("date")).write.mode("append").json(folder)
        stream = ingest.stream_ndjson(spark, folder, schema)
        ingest.run_available(stream, checkpoint, ingest.insert_only(out, "day", ["id"], schema))
        return sorted(r.id for r in spark.read.schema(schema).parquet(out).collect())

    assert land([1, 2]) == [1, 2]
    assert land([2, 3]) == [1, 2, 3]
    assert land([]) == [1, 2, 3]


def test_cut_lineage(spark):
    df = spark.range(5).withColumn("r", F.col("id") * 2)
    assert sorted(r.r for r in cut_lineage(spark, df, "cut").collect()) == [0, 2, 4, 6, 8]


def test_layout_files_of_a_large_day_do_not_overlap(spark):
    """A point lookup needs one file of a day: the footers say so."""
    rows = spark.range(500_000).select(F.lit("2024-01-01").cast("date").alias("day"), (F.col("id") * 7919 % 500_009).alias("k"))
    path, size = scratch_path(spark, "clustered"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1MB")
    tables.write_layout(rows.repartition(8), path, "day", ["k"])
    spark.conf.unset(size)
    folder = f"{path}/day=2024-01-01"
    spans = []
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            stats = [pq.ParquetFile(f"{folder}/{name}").metadata.row_group(g).column(0).statistics
                     for g in range(pq.ParquetFile(f"{folder}/{name}").metadata.num_row_groups)]
            spans.append((min(s.min for s in stats), max(s.max for s in stats)))
    spans.sort()
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert spark.read.parquet(path).count() == 500_000


def test_layout_splits_one_cluster_value(spark):
    rows = spark.range(50_000).select(F.lit("2024-01-01").cast("date").alias("day"), F.lit("hot").alias("k"), "id")
    path = scratch_path(spark, "hot")
    tables.write_layout(rows.repartition(8), path, "day", ["k"])
    assert spark.read.parquet(path).select("id").distinct().count() == 50_000
    assert set(spark.read.parquet(path).columns) == {"day", "k", "id"}


def test_expired_folders_go_and_the_rest_stays(spark):
    path = scratch_path(spark, "expired")
    days = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1), None]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, day date").write.partitionBy("day").parquet(path)
    os.makedirs(f"{path}/day=never")
    os.makedirs(f"{path}/other=2020-01-01")
    before = {n: sorted(os.listdir(f"{path}/{n}")) for n in os.listdir(path) if n.startswith("day=2024-03")}
    assert tables.drop_expired(spark, path, "day", 30, date(2024, 3, 2)) == ["2024-01-01"]
    assert tables.drop_expired(spark, path, "day", 30, date(2024, 3, 2)) == []
    folders = {n for n in os.listdir(path) if "=" in n}
    assert folders == {"day=2024-02-01", "day=2024-03-01", "day=__HIVE_DEFAULT_PARTITION__", "day=never", "other=2020-01-01"}
    assert {n: sorted(os.listdir(f"{path}/{n}")) for n in before} == before
    assert tables.drop_expired(spark, path + "-none", "day", 30, date(2024, 3, 2)) == []


def test_pages_read_their_own_range(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(1000)], "id int, v int").repartition(8)
    path, order = scratch_path(spark, "pages"), [F.desc("v"), F.asc("id")]
    # So small a table would become one range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_pages(rows, path, order)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    ranges = spark.read.parquet(f"{path}/ranges").collect()
    assert len(ranges) > 1 and sum(r.n for r in ranges) == 1000
    for limit in (1, 400):
        for page in (0, 2, 3, 4, 1000):
            got = [tuple(r) for r in tables.read_page(spark, path, rows.schema, order, page, limit).collect()]
            first = (max(1, page) - 1) * limit
            assert got == want[first:first + limit]
    one = tables.read_page(spark, path, rows.schema, order, 1000, 1)
    # The last row of the table: its range alone is listed.
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = 3", one._jdf.queryExecution().toString())


def test_pages_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "id int")
    path = scratch_path(spark, "no-pages")
    tables.write_pages(rows, path, [F.asc("id")])
    assert tables.read_page(spark, path, rows.schema, [F.asc("id")], 1, 10).collect() == []


def test_totals_stay_one_row_a_key(spark):
    schema, path = schemas.struct("w timestamp, k string, n long, day date"), scratch_path(spark, "totals")
    sink = ingest.keyed_totals(path, "day", ["w", "k"], "n", schema)

    def land(batch, *rows):
        data = spark.createDataFrame(rows, "w string, k string, n long").withColumn("w", F.col("w").cast("timestamp"))
        sink(data.withColumn("day", F.to_date("w")), batch)
        kept = spark.read.schema(schema).parquet(path)
        return sorted(((str(r.w)[:10], r.k, r.n) for r in kept.collect()), key=str)

    first = [("2024-01-01", "a", 1), ("2024-01-01", None, 2), ("2024-01-02", "a", 5)]
    assert land(0, *first) == sorted(first, key=str)
    second = [("2024-01-01", "a", 4), ("2024-01-01", "b", 1)]
    now = sorted([("2024-01-01", "a", 4), ("2024-01-01", "b", 1), *first[1:]], key=str)
    assert land(1, *second) == now
    assert land(1, *second) == now
    assert land(0, *first) == now
