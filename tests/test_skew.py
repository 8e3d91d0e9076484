"""Skew-safe operators against brute force, with one key holding most rows."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mostrador.functions import skew
from mostrador.operators import joins, sales, series, support, upsert

CONV = ("session_id string, created_at timestamp_ntz, channel_origin string, people_id string, visitor_nickname string, "
        "visitor_email string, visitor_phone string")


def conversations(n, seed):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        person = "hot" if rnd.random() < 0.5 else f"p{rnd.randrange(12)}"
        # Whole multiples of an hour hit the edges of the window; some carry microseconds.
        at = start + timedelta(hours=rnd.randrange(0, 1500)) + timedelta(microseconds=rnd.choice([0, 0, 0, 1, 999_999]))
        rows.append((f"s{rnd.randrange(10**6):06d}-{i}", at, rnd.choice(["chat", "email", "whatsapp", None]), rnd.choice([person, person, None]),
                     f"n{rnd.randrange(3)}", rnd.choice([None, f"{person}@x"]), None))
    return rows


def brute_duplicates(rows):
    people = {}
    for s, at, ch, pid, nick, mail, _ in rows:
        key = pid or (f"email:{mail}" if mail else None)
        if ch and key:
            people.setdefault(key, []).append((s, at, ch, pid, nick, mail))
    pairs, out = [], {}
    for key, convs in people.items():
        for a in convs:
            for b in convs:
                if a[2] != b[2] and a[0] < b[0] and abs(a[1] - b[1]) < timedelta(hours=73):
                    pairs.append((key, a, b))
    for key, a, b in pairs:
        o = out.setdefault(key, {"ch": set(), "first": a[1], "last": b[1], "seen": set(), "nick": a[4], "mail": set()})
        o["ch"] |= {a[2], b[2]}
        o["first"], o["last"] = min(o["first"], a[1]), max(o["last"], b[1])
        o["seen"] |= {(a[1], a[0]), (b[1], b[0])}
        o["nick"] = min(o["nick"], a[4])
    return pairs, {k: (tuple(sorted(o["ch"])), o["first"], o["last"], max(o["seen"])[1], o["nick"]) for k, o in out.items()}


def test_duplicates_match_brute_force(spark):
    for seed, n in ((1, 60), (2, 400), (3, 15)):
        rows = conversations(n, seed)
        df = spark.createDataFrame(rows, CONV)
        pairs, want = brute_duplicates(rows)
        got = {r.identity_key: (tuple(r.channels_used), r.first_contact, r.last_contact, r.latest_session_id, r.visitor_nickname)
               for r in support.omnichannel_duplicates(df).collect()}
        assert got == want
        assert joins.duplicate_pairs(df).count() == len(pairs)


def test_duplicate_window_edges(spark):
    t0 = datetime(2024, 1, 1)
    for delta, n in ((timedelta(hours=73), 0), (timedelta(hours=73) - timedelta(microseconds=1), 1), (timedelta(0), 1)):
        rows = [("a", t0, "chat", "p", "n", None, None), ("b", t0 + delta, "email", "p", "n", None, None)]
        df = spark.createDataFrame(rows, CONV)
        assert joins.duplicate_pairs(df).count() == n
        assert support.omnichannel_duplicates(df).count() == n
        back = spark.createDataFrame([(r[0], t0 - (r[1] - t0), *r[2:]) for r in rows], CONV)
        assert support.omnichannel_duplicates(back).count() == n


def test_contains_matches_brute_force(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 40))) for _ in range(150)] + ["abba" * 30, "é ab", ""]
    needles = list({"".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 9))) for _ in range(80)} | {"abbaabba", "é", "zz", "a" * 50})
    hay = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = spark.createDataFrame([(n,) for n in needles], "w string")
    got = {(r.i, r.needle) for r in skew.contains_matches(hay, ["i"], "t", words, "w").collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}
    assert skew.contains_matches(hay, ["i"], "t", words.where("w = 'none'"), "w").count() == 0


def test_contains_matches_in_long_texts(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdé😀 \n") for _ in range(n)) for n in (1023, 1024, 1025, 5000, 40_000)]
    needles = list({t[i:i + rnd.randrange(1, 60)] for t in texts for i in (0, 1000, 1020, 1023, 1024, len(t) - 30)} | {"zz", "😀" * 9})
    needles = [n for n in needles if n]
    hay = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = spark.createDataFrame([(n,) for n in needles], "w string")
    got = {(r.i, r.needle) for r in skew.contains_matches(hay, ["i"], "t", words, "w").collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}


def test_launch_matching_brute_force(spark):
    rnd = random.Random(9)
    words = ["sony", "son", "lg", "galaxy", "s", "tv 4k", "tv", "sonyx", ""]
    cands = [(i, rnd.choice(words) + rnd.choice(["", " tv"]), rnd.choice(["Sony", "LG", "on", "", None, "Acme LG"])) for i in range(60)]
    prods = [(rnd.choice(words) + " " + rnd.choice(words), rnd.choice(["SONY", "LG", "Samsung", None, "acme"])) for _ in range(30)]
    df = spark.createDataFrame(cands, "id int, producto string, marca string")
    shelf = spark.createDataFrame(prods, "title string, vendor string")
    got = {r.id: r.estado_db for r in joins.match_launches(df, shelf).collect()}

    def exists(name, brand):
        n, b = name.lower(), (brand or "").lower()
        return any(v and (n in t.lower() or b in t.lower()) and (b in v.lower() or v.lower() in b) for t, v in prods)

    assert got == {i: joins.EXISTING if exists(n, b) else joins.NEW_LAUNCH for i, n, b in cands}
    assert {r.estado_db for r in joins.match_launches(df, shelf.limit(0)).collect()} == {joins.NEW_LAUNCH}


def test_author_rules(spark):
    staff = spark.createDataFrame([
        (1, "s1", "Ana", "Li"), (2, "s2", "María José", "Peña"), (3, "s3", "Juan", "Soto"), (4, "s4", None, "Zed"), (5, "s5", "Juana", "Paz"), (6, "s6", "Juan", "Paz")],
        "list_pos int, staff_id string, first_name string, last_name string")
    cases = [
        ("e1", "x", "gid://s/StaffMember/77", "77"), ("e2?staff_member_id=88", "Juan Soto", None, "88"), ("e3", None, None, None),
        ("e4", "by MARIA JOSE PENA today", None, "s2"), ("e5", "<a href='/juan'>Soto, Juan</a>", None, "s3"), ("e6", "Soto asked Juan", None, "s3"),
        ("e7", "<a>Juan</a> moved <a>x</a>", None, "s3"), ("e8", "<a>x</a> moved <a>Juan</a>", None, None), ("e9", "Juanito Sotomayor", None, None),
        ("e10", "<a>Juana Paz</a>", None, "s5"), ("e11", "Paz and Juan", None, "s6"), ("e12", "<a>Ana</a> did", None, None), ("e13", "Zed", None, None),
        ("e14", "<a>Banana Lisa</a>", None, "s1"),
    ]
    events = spark.createDataFrame([(i, m, (a, "n") if a else None) for i, m, a, _ in cases], "id string, message string, author struct<id:string,name:string>")
    got = {r.id: r.staff_id for r in joins.attribute_staff(events, staff).collect()}
    assert got == {i: want for i, _, _, want in cases}


def test_collect_in_ordered_parts(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") < 18_000, "hot").when(F.col("id") < 19_000, F.lit(None)).otherwise("cold").alias("k"),
        F.struct(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919) % 5000).alias("v")).alias("e")).repartition(7)
    out = skew.collect_parts(df, ["k"], F.col("e"), "es", max_rows=1000).collect()
    for k, n in (("hot", 18_000), (None, 1000), ("cold", 1000)):
        parts = sorted((r for r in out if r.k == k), key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(-(-n // 1000))) and {r.parts for r in parts} == {-(-n // 1000)}
        assert all(len(r.es) == 1000 for r in parts)
        joined = [e.v for r in parts for e in r.es]
        assert joined == sorted(e.v for (e,) in df.where(F.col("k").eqNullSafe(F.lit(k))).select("e").collect())


def test_many_names_in_one_message(spark):
    first, last = [f"juan{i:03d}x" for i in range(1000)], [f"soto{i:03d}y" for i in range(1000)]
    staff = spark.createDataFrame([(f"s{i}", i, f, ln) for i, (f, ln) in enumerate(zip(first, last))], "staff_id string, list_pos int, first_name string, last_name string")
    message = " and ".join(first[500:] + last[700:] + first[:500])
    events = spark.createDataFrame([("e1", message, None), ("e2", "nobody", None)], "id string, message string, author struct<id:string>")
    start = time.perf_counter()
    assert {r.id: r.staff_id for r in joins.attribute_staff(events, staff).collect()} == {"e1": "s700", "e2": None}
    assert time.perf_counter() - start < 30


def test_open_order_search_keeps_large_orders(spark):
    at = datetime(2024, 1, 1)
    orders = spark.createDataFrame(
        [(i, 100 + i, at, 10.0 * i, None if i == 1 else "USD", "1. open", "paid", None) for i in range(1, 6)],
        "id long, order_number long, created_at timestamp_ntz, total_price double, currency string, estado_de_pedido string, financial_status string, fulfillment_status string")
    rows = [(1000 + k, 1, "A Widget" if k == 7 else "ring", 1, 1.0, "v") for k in range(40)]
    rows += [(2000, 2, "widget", 1, 1.0, "v") for _ in range(40)] + [(3000, 3, "ring", 1, 1.0, "v"), (4000, 4, None, 1, 1.0, "v")]
    lines = spark.createDataFrame(rows, "id long, order_id long, title string, quantity long, price double, vendor string")
    for q, status, want in (("widget", "1", {1, 2}), ("widget", "2", set()), ("103", "all", {3}), ("", "all", {1, 2, 3, 4, 5}), ("RING", "all", {1, 3})):
        long = sales.search_open_orders(orders, lines, q, status)
        assert {r.id for r in long.collect()} == want
        total = [tuple(sales.open_orders_total(long).first())]
        for limit in (3, 10, 50_000):
            found = sales.filter_open_orders(sales.open_orders(orders, lines, limit), q, status)
            assert sum(len(r.lines) for r in found.collect() if r.id == 1) == (40 if 1 in want else 0)
            total.append(tuple(sales.open_orders_total(found).first()))
        assert set(total) == {(sum(10.0 * i for i in want), len(want))}


def test_chunked_order_check(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(10) for _ in range(500)]
    df = spark.createDataFrame([("hot", i, v) for i, v in enumerate(values)] + [("one", 5, 1)], "s string, i int, v int")
    for chunk in (1, 7, 100, 10_000):
        got = {r.source: r.out_of_order for r in series.out_of_order(df, "s", "i", "v", chunk).collect()}
        assert got == {"hot": sum(b > a for a, b in zip(values, values[1:])), "one": 0}


def test_assignments_in_chunks(spark):
    rnd = random.Random(4)
    days = [datetime(2024, 1, 1).date() + timedelta(days=i) for i in range(200)]
    changes = [("hot" if i % 3 else "b", i, "t", "r", 100, days[i], None, rnd.random() < 0.4, f"n{i}") for i in range(200)]
    ddl = "employee_code string, seq int, team string, role string, allocation_pct long, valid_from date, valid_to date, is_primary boolean, assignment_id string"
    base = spark.createDataFrame([("a0", "hot", "t", "r", 100, datetime(2023, 1, 1).date(), None, True), ("a1", "hot", "t", "r", 20, datetime(2023, 1, 1).date(), None, False)],
                                 "assignment_id string, employee_code string, team string, role string, allocation_pct long, valid_from date, valid_to date, is_primary boolean")
    table = [["a0", "hot", None, True], ["a1", "hot", None, False]]
    for code, _, _, _, _, start, _, primary, key in changes:
        if primary:
            for row in table:
                if row[1] == code and row[3] and row[2] is None:
                    row[2] = start - timedelta(days=1)
        table.append([key, code, None, primary])
    want = {r[0]: r[2] for r in table}
    for chunk in (3, 1000):
        out = upsert.scd2_apply(base, spark.createDataFrame(changes, ddl), chunk).collect()
        assert {r.assignment_id: r.valid_to for r in out} == want


def test_nearest_partners_against_brute_force(spark):
    """Busy visitors, equal times, repeated rows, null channels and identities; window edges of 72 whole hours."""
    import random
    from datetime import datetime, timedelta

    from mostrador.operators import joins

    rng, start, data = random.Random(5), datetime(2024, 1, 1), []
    for i in range(600):
        person = rng.choice(["p1", "p1", "p1", "p2", "p3", None])
        at = start + timedelta(minutes=rng.choice([rng.randrange(0, 60 * 24 * 40), rng.randrange(0, 3) * 73 * 60, 72 * 60]))
        data.append((f"s{rng.randrange(10_000):05d}-{i}", person, rng.choice(["chat", "chat", "email", "whatsapp", None]), at))
    data += data[:5]
    df = spark.createDataFrame(
        [(*r, None, None) for r in data], "session_id string, people_id string, channel_origin string, created_at timestamp, visitor_email string, visitor_phone string")

    known = [r for r in data if r[1] and r[2]]

    def nearest(r, sign):
        others = [o for o in known if o[1] == r[1] and o[2] != r[2] and int(abs((o[3] - r[3]).total_seconds()) // 3600) <= 72]
        side = [(o[3], o[0]) for o in others if sign * ((o[3], o[0]) > (r[3], r[0])) + (1 - sign) * ((o[3], o[0]) < (r[3], r[0]))]
        return (min(side) if sign else max(side))[1] if side else None

    want = sorted((r[0], nearest(r, 0), nearest(r, 1)) for r in known)
    got = joins.nearest_partners(df).select("session_id", "before_session", "after_session").collect()
    key = lambda t: tuple(x or "" for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert joins.nearest_partners(df.limit(0)).count() == 0
