"""Hand-computed cases of the column expressions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mostrador.functions import dates as dt
from mostrador.functions import exprs as ex
from mostrador.functions import text as tx
from mostrador.sources import payloads as pl


def evaluate(spark, expr, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_js_round_halves_go_up(spark):
    got = evaluate(spark, lambda c: ex.js_round(c), [0.5, 1.5, -0.5, -1.5, 2.4], "double")
    assert got == [1.0, 2.0, 0.0, -1.0, 2.0]
    assert evaluate(spark, lambda c: ex.js_round(c, 2), [1.005, 2.675, -3.125], "double") == [
        math.floor(v * 100 + 0.5) / 100 for v in (1.005, 2.675, -3.125)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_js_round_property(spark, values):
    assert evaluate(spark, lambda c: ex.js_round(c, 1), values, "double") == [math.floor(v * 10 + 0.5) / 10 for v in values]


def test_prices(spark):
    assert evaluate(spark, ex.price_dots, ["$129.990", "CLP 1.299.990", "free", "", None, "12,5"]) == [129.99, 1.299, 0.0, 0.0, 0.0, 125.0]
    assert evaluate(spark, ex.price_locale, ["$129.990", "1.299,50 CLP", "free", None]) == [129990.0, 1299.5, None, None]


def test_leading_numbers(spark):
    assert evaluate(spark, ex.int_or_zero, ["12", "12.9", " 7x", "x7", "", None, "-3"]) == [12, 12, 7, 0, 0, 0, -3]
    assert evaluate(spark, ex.float_or_zero, ["1.5e2", ".5", "5.", "abc", None]) == [150.0, 0.5, 5.0, 0.0, 0.0]


@pytest.mark.parametrize("version, title, keyword", [
    ("v1", "iPhone 15 Pro Max 256GB Azul Titanio", "iPhone 15 Pro Max"),
    ("v1", "Easythreed Nano: Mini Impresora 3D Educativa", "Easythreed Nano"),
    ("v1", "Cámara portátil para auto 64 mm -", "Cámara"),
    ("v1", "Monitor portátiles 144Hz negro", "Monitor portátiles"),
    ("v1", "a b c d e f g", "a b c d e"),
    ("v1", "precio:sin espacio", "precio:sin espacio"),
    ("v2", "Parlante portatil portátil negro", "Parlante portatil portátil"),
    ("v3", "Dron (nuevo) X [2024] 500mAh – gris", "Dron X"),
    ("v3", "Audífonos | BT-5", "Audífonos"),
])
def test_keywords(spark, version, title, keyword):
    assert evaluate(spark, lambda c: tx.extract_keyword(c, version), [title]) == [keyword]


def test_word_edges_are_ascii(spark):
    # An accented letter is an edge, so the colour inside "verdeé" goes, "verdes" stays.
    assert evaluate(spark, tx.extract_keyword, ["verdeé", "verdes"]) == ["é", "verdes"]


def test_normalize_and_codes(spark):
    assert evaluate(spark, tx.normalize_text, ["  Ñandú--Ünï  ", None, "a\tb"]) == ["nandu uni", "", "a b"]
    df = spark.createDataFrame(
        [("X@y.z", "María José", "González"), ("Ana.B@y.z", None, "Z"), (None, "", "Z"), ("", None, None)], "e string, f string, l string")
    got = [r[0] for r in df.select(tx.employee_code("e", "f", "l", F.lit(9))).collect()]
    assert got == ["mariajose.gonzalez", "ana.b", "unknown.9", "unknown.9"]


def test_ids_and_channels(spark):
    assert evaluate(spark, tx.clean_gid, ["gid://s/Event/12?x=/9", "12", "", None]) == ["12", "12", None, None]
    assert evaluate(spark, tx.normalize_channel, [None, "", "chat", "urn:crisp.im:whatsapp:0", "urn:crisp.im:sms", "urn:x:y:z", "web"]) == [
        None, None, "chat", "whatsapp", "sms", "urn:x:y:z", "web"]


def test_notes_and_fences(spark):
    assert evaluate(spark, tx.parse_note, ['["14. No"]', "[]", "[broken", "3. Si", None, '["a","b"]']) == ["14. No", "[]", "[broken", "3. Si", None, "a"]
    schema = "a int"
    got = evaluate(spark, lambda c: tx.parse_fenced_json(c, schema), ['```json\n[{"a":1}]\n```', "```[{\"a\":2}]```", '[{"a":3}]', "sorry", None])
    assert [[r.a for r in g] for g in got] == [[1], [2], [3], [], []]


def test_html_body(spark):
    pages = ["<p>x", "<BODY a=1>k<script>\n1</script><STYLE>s</style>m</body>t", "<body></body>rest", "y" * 20000]
    got = evaluate(spark, lambda c: tx.html_body(c, 15000), pages)
    assert got == ["<p>x", "km", "", "y" * 15000]
    assert evaluate(spark, lambda c: tx.html_body(c, None), pages)[3] == pages[3]


def test_identity_precedence(spark):
    rows = [("p1", "a@b", "1"), (None, "a@b", "1"), (None, "user@example.com", "1"), (None, "", ""), (None, None, "2")]
    df = spark.createDataFrame(rows, "p string, e string, t string")
    assert [r[0] for r in df.select(tx.identity_key("p", "e", "t")).collect()] == ["p1", "email:a@b", "phone:1", None, "phone:2"]


def test_trend_dates(spark):
    got = evaluate(spark, pl.trend_date, ["Dec 29 – Jan 4, 2020", "Jan 2020", "2021-03-04", "soon", None])
    assert [str(v) if v else None for v in got] == ["2020-12-29", "2020-01-01", "2021-03-04", None, None]


def test_labels_and_terms(spark):
    assert evaluate(spark, tx.date_label, ["Dec 29 – Jan 4, 2020", "Jan 2020", "Feb 2, 2020"]) == ["Dec 29", "Jan 2020", "Feb 2"]
    assert evaluate(spark, tx.terms, [" a , ,b,, c d "]) == [["a", "b", "c d"]]
    assert evaluate(spark, lambda c: tx.shorten(c, 5, 3), ["abcde", "abcdef"]) == ["abcde", "abc..."]


def test_object_content_becomes_text(spark):
    raw = spark.createDataFrame([('{"session_id":"s","fingerprint":"1","type":"text","from":"user","timestamp":1000,"content":{"a":[1]}}',),
                                 ('{"session_id":"s","type":"text","from":"operator","timestamp":2000,"content":"hi","user":{"nickname":"Eva"}}',),
                                 ('{"session_id":"s","fingerprint":"3","type":"file","from":"user","timestamp":1000,"content":"x"}',)], "payload string")
    rows = pl.flatten_messages(pl.parse(raw, "payload", "message")).orderBy("created_at").collect()
    assert [(r.content, r.operator_name) for r in rows] == [('{"a":[1]}', None), ("hi", "Eva")]
    assert rows[0].message_id == "1" and len(rows[1].message_id) == 64


def test_listing_rules(spark):
    raw = spark.createDataFrame([(
        '{"keyword":"k","product_id":1,"shopping_results":[{"source":"A","price":"$10.5","tag":"SIN STOCK"},{"store":"B","extracted_price":7},'
        '{"source":"","price":"5"},{"source":"D","price":"gratis"},{"source":"Mi Tienda","price":"$1.299,50"},{"source":"F","price":"1"}],'
        '"ads_results":[{"source":"Z"},{"source":"MI TIENDA cl"}]}',)], "payload string")
    parsed = pl.parse(raw, "payload", "listings")
    rows = [(r.rank, r.competitor_name, r.competitor_price, r.has_stock) for r in pl.flatten_listings(parsed, 5).orderBy("rank").collect()]
    assert rows == [(1, "A", 10.5, False), (2, "B", 7.0, True), (5, "Mi Tienda", 1.2995, True)]
    spot = pl.shelf_position(parsed, "mi tienda").first()
    assert (spot.organic_position, spot.paid_position, spot.top_competitor_name, spot.top_competitor_price) == (5, 2, "A", 105.0)


def test_date_presets():
    from datetime import date, datetime

    d = date(2024, 8, 5)
    assert dt.preset_dates("quarter", d) == (date(2024, 7, 1), d)
    assert dt.preset_dates("yesterday", d) == (date(2024, 8, 4), date(2024, 8, 4))
    assert dt.bounds("x", "2024-01-02", "ytd", datetime(2024, 5, 6)) == (datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert dt.range_days(datetime(2024, 1, 1), datetime(2024, 1, 1)) == 1
    assert dt.range_days(datetime(2024, 1, 1), datetime(2024, 1, 2, 0, 0, 1)) == 2
