"""Ranked lexical search over norm buckets.

A document is a vector of impacts over the terms that any item holds, an item a vector of weighted counts; a score is
their inner product. Each task orders its documents by the length of their vectors and cuts them into buckets. For an item
the Cauchy-Schwarz bound of a bucket's longest vector, held against the item's k-th best score so far, skips the bucket;
within one, the exact products over the item's heaviest coordinates plus the same bound for the rest leave few documents,
and those are scored in integers. Only a task's k best of each item are shuffled.

Bounds are doubles and widened by more than their rounding; scores never are. Items come in blocks of bounded size, each
sent to all tasks, so that any number of items is searched. Null and blank texts have no term, count for nothing and are
never found. Rows of documents that repeat an id are documents of their own; those without an id stand behind equal scores
that have one. Rows of items that repeat an id are one item with the terms of all, and those without an id are none. Terms
of any length and texts of any length are read whole. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import blocks, columns, emit

# Bytes that part terms become blanks, A-Z small letters; digits, letters and all beyond ASCII stay.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
# A longer term is known by its digest behind a byte that no term holds.
LONG = 64
# Distinct (item, term) of a block of items.
POSTINGS = 1 << 20
# Vector entries that a task holds at once, and documents of a bucket.
ENTRIES, BUCKET = 2_000_000, 2048
# Share of an item's squared length that its heaviest coordinates hold.
FOCUS = 0.75
# Bounds are widened by this share, far above the rounding of doubles.
SLACK = 1e-9


def terms(data: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a whole text, a block at a time."""
    for part in blocks(data or b""):
        found = part.translate(FOLD).split()
        if found and max(map(len, found)) > LONG:
            found = [t if len(t) <= LONG else b"\0" + xxhash.xxh3_128_digest(t) for t in found]
        yield found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """Vectors of a block of items over its vocabulary."""

    def __init__(self, ids: list[int], counts: list[dict[int, int]], weights: np.ndarray):
        self.ids, self.root = ids, np.sqrt(weights.astype(np.float64))
        self.at, self.exact, self.q, self.heavy, self.rest = [], [], [], [], []
        for held in counts:
            at, n = np.array(list(held), np.int64), np.array(list(held.values()), np.int64)
            q = n * self.root[at]
            order = np.argsort(-q, kind="stable")
            at, n, q = at[order], n[order], q[order]
            squares = np.cumsum(q * q)
            heavy = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1 if len(q) else 0
            self.at.append(at)
            self.exact.append(n * weights[at])
            self.q.append(q)
            self.heavy.append(min(heavy, len(q)))
            self.rest.append(math.sqrt(float((q[heavy:] ** 2).sum())))
        self.lengths = np.array([math.sqrt(float((q * q).sum())) for q in self.q])


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none) for _ in items.ids]
        # A document must reach this to be among the best; 1 until there are k.
        self.least = np.ones(len(items.ids), np.int64)
        self.dense = np.zeros(len(items.root), np.int64)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        good = scores >= self.least[i]
        if not good.any():
            return
        scores, ids, nameless = (np.concatenate(both) for both in zip(self.held[i], (scores[good], ids[good], nameless[good])))
        order = np.lexsort((ids, nameless, -scores))[: self.k]
        self.held[i] = scores[order], ids[order], nameless[order]
        if len(order) == self.k:
            self.least[i] = max(1, scores[order[-1]])

    def search(self, ids: np.ndarray, nameless: np.ndarray, m: np.ndarray, starts: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """All documents given by their vectors: document d has the entries from starts[d] to starts[d + 1]."""
        of = np.repeat(np.arange(len(ids)), np.diff(starts))
        impact = impacts(tf, m[of])
        p = self.items.root[at] * impact
        squares = np.bincount(of, p * p, len(ids))
        longest = np.argsort(-squares, kind="stable")
        for first in range(0, len(ids), BUCKET):
            chosen = longest[first: first + BUCKET]
            top = math.sqrt(squares[chosen[0]])
            active = np.flatnonzero(self.items.lengths * top * (1 + SLACK) >= self.least)
            if len(active):
                self.bucket(active, ids[chosen], nameless[chosen], squares[chosen], starts[chosen], starts[chosen + 1], at, impact, p)

    def bucket(self, active, ids, nameless, squares, starts, ends, at, impact, p) -> None:
        sizes = ends - starts
        entry = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        doc = np.repeat(np.arange(len(ids)), sizes)
        # The bucket's coordinates: entries by term.
        by_term = np.argsort(at[entry], kind="stable")
        term, doc_of, p_of = at[entry][by_term], doc[by_term], p[entry][by_term]
        for i in active.tolist():
            heavy = self.items.heavy[i]
            low = np.searchsorted(term, self.items.at[i][:heavy])
            high = np.searchsorted(term, self.items.at[i][:heavy], "right")
            product, seen = np.zeros(len(ids)), np.zeros(len(ids))
            for a, b, q in zip(low.tolist(), high.tolist(), self.items.q[i][:heavy].tolist()):
                product[doc_of[a:b]] += q * p_of[a:b]
                seen[doc_of[a:b]] += p_of[a:b] ** 2
            # What is left of a vector beyond the seen coordinates, never less than its rounding.
            left = np.sqrt(np.maximum(squares - seen, SLACK * squares))
            near = np.flatnonzero((product + self.items.rest[i] * left) * (1 + SLACK) >= self.least[i])
            if len(near):
                self.add(i, self.scores(i, starts[near], sizes[near], at, impact), ids[near], nameless[near])

    def scores(self, i: int, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores of the documents whose entries are given; every one has some."""
        edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        entry = np.repeat(starts - edges, sizes) + np.arange(sizes.sum())
        self.dense[self.items.at[i]] = self.items.exact[i]
        scores = np.add.reduceat(self.dense[at[entry]] * impact[entry], edges)
        self.dense[self.items.at[i]] = 0
        return scores


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n) of all items."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((i, t, n) for i, text in columns(batches) for part in terms(text) for t, n in Counter(part).items()), schema)

    return items.mapInArrow(run, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, at, tf): the number of all terms of each document that has any, and the counts of those that are in the
    vocabulary, by their place in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary.value)}.get

        def rows():
            for doc_id, text in columns(batches):
                n, held = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    held.update(map(place, part))
                held.pop(None, None)
                if n:
                    yield doc_id, n, list(held), list(held.values())

        yield from emit(rows(), schema, 5000)

    return docs.mapInArrow(run, "doc_id long, n long, at array<int>, tf array<long>")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents of each term, added up in each task."""
    schema = pa.schema([("at", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], schema=schema)

    rows = vectors.select("at").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return df


def _search_block(docs: DataFrame, block: pa.Table, k: int) -> DataFrame | None:
    """(item_id, doc_id, score): each task's best documents of each item of a block."""
    spark = docs.sparkSession
    names = sorted(set(block.column("term").to_pylist()))
    place = {t: i for i, t in enumerate(names)}
    counts: dict[int, dict[int, int]] = {}
    for item_id, term, n in zip(*(block.column(c).to_pylist() for c in ("item_id", "term", "n"))):
        counts.setdefault(item_id, {})[place[term]] = n
    vectors = cut_lineage(spark, _vectors(docs, spark.sparkContext.broadcast(names)), "impact-vectors")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.array([weight(n_docs, int(df)) for df in _frequencies(vectors, len(names))], np.int64)
    sent = spark.sparkContext.broadcast((list(counts), list(counts.values()), weights))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(Items(*sent.value), k)
        held: list[tuple] = []

        def search() -> None:
            if not held:
                return
            ids, nameless, n, sizes, at, tf = (np.concatenate(c) for c in zip(*held))
            held.clear()
            m = np.array([25 + 75 * x * n_docs // length for x in n.tolist()], np.int64)
            best.search(ids, nameless, m, np.concatenate([[0], np.cumsum(sizes)]), at, tf)

        have = 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            for cut in range(0, batch.num_rows, BUCKET):
                doc_id, n, at, tf = batch.slice(cut, BUCKET).columns
                held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), n.to_numpy(),
                             pc.list_value_length(at).to_numpy(), at.flatten().to_numpy(), tf.flatten().to_numpy()))
                have += len(held[-1][4])
                if have >= ENTRIES:
                    search()
                    have = 0
        search()
        yield from emit(((item, None if none else int(doc), int(score)) for item, (scores, ids, nameless) in zip(best.items.ids, best.held)
                         for score, doc, none in zip(scores, ids, nameless)), schema)

    return vectors.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    items = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    held = cut_lineage(spark, _item_terms(items), "item-terms")
    n_blocks = max(1, -(-held.count() // postings))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(n_blocks):
        block = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toArrow()
        part = _search_block(docs, block, k) if block.num_rows else None
        found = found if part is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
