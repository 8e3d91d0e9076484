"""URL filter, prefix trie and lexical search beside SQL over small tables of odd rows."""

import random

import duckdb
import numpy as np
import pytest

from mostrador.llm import lexical, oracles, queries, trie, urls

EXTRA = ["'x' AS key", "1 AS run", "2 AS row", "'y' AS verdict", "3 AS n", "4 AS score", "'z' AS base"]


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def beside_sql(spark, folder, key, tables):
    """Rows of a query and of its SQL, over tables given by name as (rows, schema)."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        path = str(folder / f"{name}.parquet")
        # Several files, and columns named as the operators name theirs.
        spark.createDataFrame(rows, schema).repartition(3).selectExpr("*", *(e for e in EXTRA if e.split()[-1] not in schema)).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = queries.QUERIES[key](spark, str(folder))
    cur = con.execute(oracles_sql := queries.ORACLES[key])
    assert oracles_sql
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(got.columns) == sorted(names)
    return rows_of(got), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


# --- URL filter

PAGES = "page_id long, url string, html string"


def url_rows(seed=3):
    rnd = random.Random(seed)
    hosts = ["a.example.net", "example.net", "xnet", "net", "m.example.com", "Example.COM", "b.org", "blog.x.org", "notexample.net", "y.example.net:80"]
    made = [f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr', 'es'])}{rnd.choice(['/', '', '/x'])}{rnd.randrange(3000)}{rnd.choice(['', '?a=/b', '#t'])}"
            for _ in range(400)]
    odd = [None, "", "no-scheme/en/", "://", "http://", "http://net", "http://net?x=/y", "HTTP://ORG/fr/1", "http://org/FR/1", "a://b.org/fr/c://net/", "http://é.org/fr/日本\n\tx",
           "http://x.org/de/" + "long/" * 100, "http://org#/fr/"]
    return [(i if i % 50 else None, u, "<p>") for i, u in enumerate(made + odd + made[:40])]


def test_url_filter(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "op11_url_filter", {"pages": (url_rows(), PAGES)})
    assert got == want
    assert {r[-1] for r in got} == {"allow", "block"} and any(r[3] is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "http://a.example.com/en/1", ""), (None, None, None)], [(1, "http://a.net/x", "")] * 9])
def test_url_filter_without_examples(spark, tmp_path, rows):
    got, want = beside_sql(spark, tmp_path, "op11_url_filter", {"pages": (rows, PAGES)})
    assert got == want and len(got) == len(rows)


def test_url_models_tell_planted_kinds_apart(spark):
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(12))
    good, bad = lambda: word("abcdeilnorst"), lambda: word("qxzjkw0123456789")
    rows = [(i, f"http://{kind}.test/{good() if kind in ('yes', 'open') else bad()}") for i in range(900) for kind in (rnd.choice(["yes", "no", "open", "closed"]),)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, [("allow", "yes.test/"), ("block", "no.test/")]).collect()}
    for i, u in rows:
        kind = u.split("//")[1].split(".")[0]
        assert got[i].rule == {"yes": "yes.test/", "no": "no.test/"}.get(kind)
        assert (got[i].score is None) == (got[i].rule is not None)
    judged = [(got[i].verdict, u) for i, u in rows if got[i].rule is None]
    assert np.mean([(v == "allow") == ("open" in u) for v, u in judged]) > 0.97


def test_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://a.org/de/" + "long/" * 100_000), (2, "http://a.org/fr/short"), (3, "http://a.net/x")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, oracles.URL_RULES).collect()}
    assert len(got[1].path) == 4 + 500_000 and got[1].rule is None and got[2].rule == "org/fr/"


def test_best_limit():
    row = lambda step, allowed, blocked: {"step": step, "allowed": allowed, "blocked": blocked}
    assert urls.best_limit([]) == 0 and urls.best_limit([row(5, 3, 0)]) == 0
    assert urls.best_limit([row(10, 5, 0), row(-10, 0, 5)]) == 0
    assert urls.best_limit([row(50, 5, 0), row(30, 0, 5)]) == 0.31


# --- prefix trie

TURNS = "conv_id long, turn int, role string, text string"


def turn_rows(seed=4):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 150), 1000, 1017, 2041, 2042]:
        if c in (40, 47):
            continue  # 40 would be the donor of its family
        for turn in range(rnd.choice([1, 1, 2, 3, 6])):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), f"say {rnd.randrange(4)}  two\twords"))
    same = [(3000 + i, turn, "user", f"all the same {turn}") for i in range(700) for turn in range(3)]
    odd = [(None, 1, "user", "nobody"), (5000, None, None, None), (5000, None, None, None), (5000, 1, "user", ""), (5000, 1, None, "tie"), (5000, 1, "user", "tie"),
           (5001, 0, "", None), (5002, 0, "ab", "c"), (5003, 0, "a", "bc"), (5004, 0, "user", "long " * 100_000), (-7, 0, "user", "negative"), (-27, 0, "user", "negative")]
    return rows + same + odd + [(6001, t, "user", f"deep {t}") for t in range(70)] + [(6002, t, "user", f"deep {t}") for t in range(50)]


def test_prefix_trie(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "op12_prefix_trie", {"conversations": (turn_rows(), TURNS)})
    assert got == want


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 0, None, None)]])
def test_prefix_trie_of_few(spark, tmp_path, rows):
    got, want = beside_sql(spark, tmp_path, "op12_prefix_trie", {"conversations": (rows, TURNS)})
    assert got == want


def test_prefix_trie_of_small_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 3)
    shard = [(c, [(bytes([c % 3]) * 16, 1), (bytes([c % 5]) * 16, 2)]) for c in range(100)]
    nodes = {key: (depth, n, least, [s["ids"] for s in ends]) for key, depth, _, n, least, _, ends in trie.walk(shard)}
    assert len(nodes) == 1 + 3 + 15 and nodes[trie.ROOT][:3] == (0, 100, 0)
    leaf = next(v for v in nodes.values() if v[0] == 2 and v[2] == 0)
    assert leaf[3] == ["0,15,30", "45,60,75", "90"]
    monkeypatch.setattr(trie, "CONVERSATIONS", 7)
    assert [len(s) for s in trie.shards(((c, c, b"k", 1) for c in range(20)), 1)] == [7, 7, 6]


def test_plain_trie(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "u", "c"), (2, 0, "u", "a b"), (2, 1, "u", "d"), (21, 0, "u", "a b")]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 2)}
    assert (got[1, 1].n_convs, got[1, 1].n_children, got[1, 1].n_leaves, got[1, 1].saved_tokens) == (3, 2, 2, 4)
    assert got[1, 0].parent_conv_id is None and got[2, 2].parent_conv_id == 1


# --- lexical search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def search_tables(seed=6):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["über", "日本", "ÀB", "x9", "q" * 80, "q" * 81]
    text = lambda n: rnd.choice([" ", ",", "-", "\n"]).join(rnd.choice(words[: rnd.choice([5, 30, 66])]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 3, 20, 200]))) for i in range(300)]
    docs += [(i + 1000, docs[7][1].upper()) for i in range(15)] + [(7, "w1 w2"), (7, "w3"), (None, "w59 w58 w57"), (None, None), (400, None), (401, " .,"), (402, "w1 " * 50_000)]
    items = [(i, text(rnd.choice([1, 4, 12]))) for i in range(25)] + [(3, "w1 w1 w2"), (50, None), (51, ""), (52, "unheard of"), (None, "w1"), (53, docs[7][1]), (54, "w59 w58")]
    return docs, items


def test_lexical_search(spark, tmp_path):
    docs, items = search_tables()
    got, want = beside_sql(spark, tmp_path, "op13_lexical_search", {"documents": (docs, DOCS), "benchmark": (items, ITEMS)})
    # Equal scores of one id, or of rows without one, may stand in any order; what is listed is the same.
    assert got == want


def test_lexical_search_in_blocks_and_small_buckets(spark, tmp_path, monkeypatch):
    docs, items = search_tables(7)
    d, i = spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS)
    whole = rows_of(lexical.search(d, i))
    assert rows_of(lexical.search(d, i, postings=40)) == whole
    assert len(rows_of(lexical.search(d, i, k=3))) == sum(r[2] <= 3 for r in whole)


def test_bounds_lose_nothing(monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 8)
    rnd = np.random.default_rng(8)
    weights = rnd.integers(0, 5000, 40)
    counts = [{int(t): int(rnd.integers(1, 4)) for t in rnd.choice(40, size, replace=False)} for size in (1, 3, 10, 25)]
    best = lexical.Best(lexical.Items(list(range(4)), counts, weights), 5)
    docs = [{int(t): int(rnd.integers(1, 9)) for t in rnd.choice(40, rnd.integers(1, 30), replace=False)} for _ in range(200)]
    m = rnd.integers(25, 300, 200)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    best.search(np.arange(200), np.zeros(200, bool), m, starts, np.array([t for d in docs for t in d]), np.array([n for d in docs for n in d.values()]))
    for item, (scores, ids, _) in zip(counts, best.held):
        every = [(-sum(n * int(weights[t]) * ((10**9 * d[t]) // (1000 * d[t] + 8 * int(m[i]))) for t, n in item.items() if t in d), i) for i, d in enumerate(docs)]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == sorted(e for e in every if e[0] < 0)[:5]


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "..")], [(1, "a")])])
def test_lexical_search_of_nothing(spark, docs, items):
    assert lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
