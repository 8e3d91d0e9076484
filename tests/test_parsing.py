"""Payload texts are read once a row, whatever conditions follow."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mostrador.sources import payloads as pl


@pytest.mark.parametrize("key", ["nrm_15_listings", "nrm_16_shelf_position", "nrm_02_order_lines", "nrm_08_audit"])
def test_a_payload_is_read_once(spark, key):
    plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_odd_payloads_keep_their_row(spark):
    texts = [None, "", "no json", "[]", '{"keyword": "k"}', '{"keyword": "l", "shopping_results": []}', '{"keyword": "m", "shopping_results": [{"source": "s", "price": "$3"}, null]}']
    raw = pl.parse(spark.createDataFrame([(t,) for t in texts], "payload string"), "payload", "listings")
    assert raw.columns == ["keyword", "product_id", "shopping_results", "ads_results"]
    assert sorted(r.keyword or "" for r in raw.collect()) == ["", "", "", "", "k", "l", "m"]
    assert [(r.keyword, r["rank"], r.competitor_price) for r in pl.flatten_listings(raw).collect()] == [("m", 1, 3.0)]
    assert raw.where(F.col("keyword") == "k").count() == 1
