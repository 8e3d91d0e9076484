"""Packing, substring removal, decontamination and the Jaccard join beside brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mostrador.llm import decontaminate, jaccard, packing, queries, sides, substring
from mostrador.session import cut_lineage

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randint(1, 6))) for _ in range(n)]


def corpus(seed=1, n=120):
    """Texts with exact and near copies, shared passages, short, empty and null ones."""
    rnd, words = random.Random(seed), vocabulary(300, seed)
    shared = [" ".join(rnd.choice(words) for _ in range(70)) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.15:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.5 and (base := rnd.choice(texts)):
            ws = base.split()
            for _ in range(rnd.randint(1, 6)):
                if ws:
                    ws[rnd.randrange(len(ws))] = rnd.choice(words)
            texts.append(" ".join(ws))
        elif kind < 0.65:
            own = [rnd.choice(words) for _ in range(rnd.randint(5, 100))]
            at = rnd.randint(0, len(own))
            texts.append(" ".join(own[:at]) + "\n" + rnd.choice(shared) + " " + " ".join(own[at:]))
        else:
            texts.append(" ".join(rnd.choice(words).title() for _ in range(rnd.choice([0, 1, 3, 4, 5, 30, 80, 200]))))
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "a" * 5000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Columns named as the operators name theirs.
    return df.selectExpr("doc_id", "text", "'x' AS h", "1 AS grp", "2 AS start", "'y' AS ids", "3 AS version") if extra else df


# --- packing

def check_packing(rows, docs, capacity):
    tok = Tokenizer.from_file(JSON)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for doc_id, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at: at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and at & (at - 1) == 0


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_round_trip(spark, capacity):
    docs = corpus(3, 40) + [(999, "naïve <|endoftext|> 漢字 don't " * 7), (1000, "x1 " * 3000)]
    check_packing(packing.pack(frame(spark, docs), JSON, RANKS, capacity).collect(), docs, capacity)


def test_packing_chunks_equal_whole(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    text = " ".join(t for _, t in corpus(5, 20) if t) + "  odd \n\n spaces 12 34 l'été $$ %%% the end"
    whole = Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
    for ranks in (RANKS, None):
        assert np.concatenate(list(packing.Encoder(JSON, ranks).ids(text))).tolist() == whole


def test_packing_real_table_and_digest(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    check_packing(packing.pack(queries.table(spark, SF, "documents"), JSON, RANKS).collect(), docs, 1024)
    row = queries.op10_packing(spark, SF).filter("doc_id = 7 AND start = 0").first()
    ids = np.array(Tokenizer.from_file(JSON).encode(dict(docs)[7], add_special_tokens=False).ids + [0], dtype="<u4")
    assert row.ids_crc32 == zlib.crc32(ids[: row.length].tobytes())


# --- substring

def brute_substring(docs, window):
    first = {}
    split = {}
    for i, t in docs:
        ws = split[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a: a + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, ws in split.items():
        gone = set()
        for a in range(len(ws) - window + 1):
            if first[tuple(ws[a: a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("window,seed", [(50, 1), (50, 2), (7, 3), (20, 4)])
def test_substring_equals_brute_force(spark, window, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, docs), window).collect()}
    assert got == brute_substring(docs, window)


def test_substring_hot_window_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 5)
    docs = corpus(8, 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, docs), 20).collect()}
    assert got == brute_substring(docs, 20)


def test_substring_odd_rows(spark):
    long = " ".join(vocabulary(80, 9))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, long + " z")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 0, 0), (-1, 80, 0), (1, 80, 0), (1, 80, 0), (2, 81, 80)]
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_real_table(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, SF).collect()}
    assert got == {i: (a, b, hashlib.sha256(k.encode()).hexdigest()) for i, (a, b, k) in brute_substring(docs, 50).items()}


# --- decontamination

def brute_contamination(docs, items, window=13):
    def ws(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = ws(t)
        for a in range(max(len(w) - window + 1, 1 if w else 0)):
            owners[tuple(w[a: a + window])].add(i)
    sizes = {len(k) for k in owners}
    out = []
    for i, t in docs:
        w, hit, found = ws(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a: a + n])) in owners:
                    hit.update(range(a, a + n))
                    found |= owners[key]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def contaminated(spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS h", "2 AS `group`", "3 AS doc_id")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(frame(spark, docs), items).collect()), key=repr)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df: df if limit == 0 else decontaminate.F.broadcast(df))
    docs = corpus(4, 80)
    rnd = random.Random(0)
    items = []
    for k in range(25):
        src = (rnd.choice(docs)[1] or "").split()
        at = rnd.randrange(len(src) + 1)
        items.append((k, ", ".join(src[at: at + rnd.choice([1, 2, 5, 12, 13, 14, 30, 60])]).upper()))
    items += [(25, None), (26, ""), (27, "Ünïcode ÉTÉ x1"), (None, docs[0][1]), (3, "again " + (docs[5][1] or "")), (28, items[0][1])]
    docs = docs + [(500, "the ünïcode ÉTÉ x1 here"), (500, "the ünïcode Été x1 here"), (None, items[6][1]), (501, items[8][1]), (501, items[8][1])]
    assert contaminated(spark, docs, items) == brute_contamination(docs, items)


def test_decontamination_empty_tables(spark):
    assert contaminated(spark, [], [(1, "a b")]) == []
    assert contaminated(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_decontamination_real_table(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    want = {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, f in brute_contamination(docs, items)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op4_decontamination(spark, SF).collect()}
    assert got == want and any(v[4] for v in want.values())


# --- Jaccard

def brute_jaccard(docs, percent=75, width=5):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[i] = {tuple(w[a: a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=60, words=120):
    """Chains of near copies on both sides of the limit."""
    rnd, vocab = random.Random(seed), vocabulary(400, seed)
    docs = []
    for _ in range(4):
        base = [rnd.choice(vocab) for _ in range(words)]
        for _ in range(n // 4):
            ws = list(base)
            for _ in range(rnd.randint(0, 6)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
            docs.append(" ".join(ws[: len(ws) - rnd.choice([0, 0, 0, 10, 25, 40])]))
            if rnd.random() < 0.3:
                base = ws
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("docs,rare", [(corpus(6), 64), (corpus(7, 200), 3), (near_copies(1), 64), (near_copies(2, 120), 5), (near_copies(3, 80, 30), 2)])
def test_jaccard_equals_brute_force(spark, docs, rare, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", rare)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, docs)).collect()}
    assert got == brute_jaccard(docs)


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    from mostrador.llm.words import emit

    schema = pa.schema([("i", pa.int64()), ("packed", pa.binary())])
    sizes = [10, 0, 900, 400, 5000, 1, 2, 300]
    batches = list(emit(((i, b"x" * n if n else None) for i, n in enumerate(sizes)), schema, 100, 1000))
    assert [b.num_rows for b in batches] == [4, 1, 3] and [i for b in batches for i in b.column(0).to_pylist()] == list(range(8))
    assert [b.num_rows for b in emit(((i, b"") for i in range(8)), schema, 3, 1000)] == [3, 3, 2]


def test_jaccard_in_small_parts_and_ranges(spark, monkeypatch):
    for name, value in (("PART", 3), ("RANGE", 50), ("HELD", 200), ("RARE", 2)):
        monkeypatch.setattr(jaccard, name, value)
    # Heavily edited copies of one text, half of them not linked with any other, and lines that many texts share.
    rnd, vocab = random.Random(9), vocabulary(500, 9)
    base, line = [rnd.choice(vocab) for _ in range(80)], [rnd.choice(vocab) for _ in range(12)]
    docs = []
    for i in range(90):
        ws = list(base) if i % 3 else [rnd.choice(vocab) for _ in range(30)]
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 9])):
            ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
        docs.append((i, " ".join(ws + line * (i % 2) + line[:8] * (i % 5 == 0))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, docs)).collect()}
    assert got == brute_jaccard(docs) and 5 < len({c for _, c in got.values()}) < 85


def test_cell_links_connect_what_links():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    links = set(jaccard.cell_links([(i, i, t) for i, t in enumerate(sets[:15])], [(i + 15, i + 15, t) for i, t in enumerate(sets[15:])], 40))
    assert all(100 * len(np.intersect1d(sets[x], sets[y])) >= 40 * len(np.union1d(sets[x], sets[y])) for x, y in links)
    reach = {i: {i} for i in range(30)}
    every = [(x, y) for x in range(15, 30) for y in range(15) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 40 * len(np.union1d(sets[x], sets[y]))]
    for pairs, of in ((links, "found"), (every, "all")):
        for x, y in pairs:
            whole = reach[x] | reach[y]
            for z in whole:
                reach[z] = whole
        if of == "found":
            found = {i: set(c) for i, c in reach.items()}
    assert found == reach and len(links) <= 29


def test_jaccard_shuffles_no_sets(spark, monkeypatch):
    """With more documents than may be sent, sets stay in the files they were written to, and only texts that meet others travel."""
    monkeypatch.setattr(sides, "SENT", 20)
    monkeypatch.setattr(sides.small, "__defaults__", (20,))
    monkeypatch.setattr(jaccard, "RARE", 3)
    plans, cut, store = {}, jaccard.cut_lineage, getattr(jaccard, "store_parts", None)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().explainString(mode))
        return df

    monkeypatch.setattr(jaccard, "cut_lineage", lambda spark, df, name: cut(spark, seen(df, name), name))
    monkeypatch.setattr(jaccard, "store_parts", lambda spark, parts, name: store(spark, (seen(df, name) for df in parts), name), raising=False)
    docs = corpus(11, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, docs)).collect()}
    assert got == brute_jaccard(docs)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)", "\n".join(p for ps in plans.values() for p in ps))
    assert shuffled and not [x for x in shuffled if re.search(r"\b(lead|tokens)#", x)]
    assert len(plans["leading-shingles"]) > 3


def test_wide_rows_meet_rows_by_file(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sides, "SENT", 10)
    wide = [(i, i % 3, "x" * i) for i in range(60)] + [(7, 1, "again"), (None, 0, "none")]
    spark.createDataFrame(wide, "a long, b long, w string").repartition(5).write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    rows = stored.filter("a % 4 = 3 OR a < 30").select("a", "b", (F.col("a") * 10).alias("g"), sides.file_of().alias("file")).distinct()
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    parts = list(sides.meeting_by_file(stored, rows, ["a", "b"]))
    got = sorted(tuple(r) for part in parts for r in part.select("a", "b", "w", "g").collect())
    assert got == sorted((a, b, w, a * 10) for a, b, w in wide if a is not None and (a % 4 == 3 or a < 30)) and len(parts) > 3
    assert [p.count() for p in sides.meeting_by_file(stored, rows.filter("false"), ["a", "b"])] == [0]
    for limit in (3, 1000):
        monkeypatch.setattr(sides, "SENT", limit)
        few = rows.filter("a < 9").select("a", "g").distinct()
        met = sides.meeting(stored, cut_lineage(spark, few, "few"), "a").select("a", "w", "g").collect()
        assert sorted(tuple(r) for r in met) == sorted((a, w, a * 10) for a, _, w in wide if a is not None and a < 9)


def test_jaccard_odd_rows(spark):
    rows = [(4, "a b c"), (3, "A  b\tC"), (None, "a b c"), (None, None), (5, None), (6, ""), (7, "q w"), (7, "a b c"), (8, "q w")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, rows)).collect() if r.doc_id)
    assert got == [(3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 1, 3), (7, 1, 3), (8, 1, 3)]
    assert jaccard.similar_groups(frame(spark, [])).count() == 0


def test_jaccard_real_table(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, SF).collect()}
    assert got == brute_jaccard(docs)


def test_tasks_hand_back_what_they_held(spark, monkeypatch):
    import weakref
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    from mostrador.llm import words

    made, gone = [], []
    monkeypatch.setattr(words, "TRIM", lambda _: gone.append([ref() is None for ref in made]))

    class Encoder(packing.Encoder):
        def __init__(self, *paths):
            super().__init__(*paths)
            made.append(weakref.ref(self))

    monkeypatch.setattr(packing, "Encoder", Encoder)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(select=lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = list(run([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})]))
    assert sum(b.num_rows for b in pieces) and gone == [[True]]

    schema = pa.schema([("i", pa.int64())])
    assert [b.num_rows for b in words.emit_arrays([(np.arange(3),)], schema)] == [3] and len(gone) == 2
    assert list(words.handed_back(iter([1, 2]))) == [1, 2] and len(gone) == 3
