"""What the physical plans must and must not hold, whatever the data size."""

import re

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from mostrador import plans
from mostrador.operators import market

FOLDER = "/root/testdata/sf0.001"
# These write files or run streams when they are built; their plans are plain scans.
WRITERS = ("src_", "str_")
KEYS = sorted(k for k in plans.queries() if not k.startswith(WRITERS))


def plan(spark, key):
    return entry.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Hints on sides whose rows a constant bounds: the top k products.
BOUNDED = {"sal_08_top_products_seo", "mkt_07_top20_prices"}


@pytest.mark.parametrize("key", KEYS)
def test_no_pairwise_joins_or_forced_broadcasts(no_broadcast, key):
    text = plan(no_broadcast, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("BroadcastHashJoin" in text) == (key in BOUNDED)


@pytest.mark.parametrize("key", [
    "win_01_latest_per_key", "win_02_previous_per_key", "win_02_latest_and_previous", "jn_13_position_report", "cal_01_dedupe_calls",
    "alg_04_trend_signal", "alg_05_momentum", "mkt_17_related_top", "win_04_dedupe_first", "ups_10_load_batch"])
def test_hot_keys_are_cut_before_the_shuffle(spark, key):
    text = plan(spark, key)
    first = text.index("WindowGroupLimit")
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text) and "Exchange" in text[first:]


def test_limited_listings_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS product_id", "id AS price")
    limited = market.first_listings(df, ["product_id"], [F.col("price")], k=20)
    text = limited._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text) and limited.count() == 60
    assert market.first_listings(df, ["product_id"], [F.col("price")]).count() == 1000


# A shuffle by the hot key alone would satisfy these groupings and keep the key in one task.
@pytest.mark.parametrize("key, columns", [
    ("sup_08_omnichannel_duplicates", "identity_key, target, block"), ("win_05_out_of_order", "source, chunk"),
    ("ups_07_scd2", "employee_code, _chunk"), ("sal_10_open_orders", "id, .*part"), ("mkt_16_keyword_groups", "keyword, part"),
    ("jn_16_attribute_staff", "event, unit, needle"), ("jn_04_duplicate_pairs", "identity_key, _bucket")])
def test_hot_keys_are_spread(no_broadcast, key, columns):
    text = re.sub(r"#\d+L?", "", plan(no_broadcast, key))
    assert re.search(rf"Exchange hashpartitioning\({columns}, \d+\)", text)


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "sal_02_sales_trend")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_orderpriority" not in schema and "o_totalprice" in schema


def test_session_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
