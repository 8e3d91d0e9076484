"""Repeated passages across documents by one doubling.

Windows of half the wanted length come first: of each document only those that are the least hash in some wanted
window (so that every wanted window holds one, the same wherever it occurs). Half windows that occur in a single
document end there; the rest alone are extended to twice the length, which is the wanted one. That is the only
doubling: longer shared passages are removed as overlapping windows, but not reported by their length.

A word is removed if a window covering it also starts in a document with a smaller id. Null texts and texts shorter
than the window lose nothing. Rows that repeat an id count as one document (none precedes the other). Rows without an
id have no order: they neither lose words nor make others lose any. Equal texts keep one: the later copies lose all
words if they hold a window. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sides import small
from .words import columns, emit, emit_arrays, rolling, signed, sliding_min, split_words, word_hashes

# Documents of one window in one task, before its rows are dealt over several.
HOT = 10_000


def _prepared(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): whether a document with a smaller id has the same words."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((i, *sequence_key(word_hashes(t, False))) for i, t in columns(batches)), schema)

    keyed = cut_lineage(docs.sparkSession, docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, a long, b long"), "sequences")
    first = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, ["a", "b"]).groupBy("doc_id").agg(F.min(F.col("first") < F.col("doc_id")).alias("copy"))


def sequence_key(h: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = xxhash.xxh3_128_intdigest(h.tobytes())
    return tuple(int(x) for x in np.array([raw >> 64, raw & (1 << 64) - 1], np.uint64).view(np.int64))


def _anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least half-window hash of every window, and the half windows' hashes."""
    half = (window + 1) // 2
    grams = rolling(h, half)
    return sliding_min(grams, window - half + 1), grams


def find_repeats(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, windows): hashes of a document's windows that also start in a document with a smaller id."""
    pairs = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])

    def halves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for doc_id, text in columns(batches):
                h = np.unique(_anchors(word_hashes(text, False), window)[0])
                yield signed(h), np.full(len(h), doc_id, np.int64)

        yield from emit_arrays(parts(), pairs)

    half = cut_lineage(docs.sparkSession, docs.mapInArrow(halves, "h long, doc_id long"), "half-windows")
    shared = (half.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
              .filter("least < most").select("h", F.ceil(F.col("n") / HOT).cast("int").alias("salts")))
    candidates = cut_lineage(docs.sparkSession, half.join(shared, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "salts")).alias("found")), "candidates")

    def extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("salt", pa.int32())])

        def parts():
            for doc_id, text, found in columns(batches):
                h = word_hashes(text, False)
                keys = np.array([f["h"] for f in found], np.int64).view(np.uint64)
                salts = np.array([f["salts"] for f in found], np.int32)
                order = np.argsort(keys)
                keys, salts = keys[order], salts[order]
                least, _ = _anchors(h, window)
                at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                hit = keys[at] == least
                whole, first = np.unique(rolling(h, window)[hit], return_index=True)
                of = salts[at][hit][first]
                yield signed(whole), np.full(len(whole), doc_id, np.int64), np.where(of > 1, doc_id % np.maximum(of, 1) + 1, 0).astype(np.int32)

        yield from emit_arrays(parts(), schema)

    # Only texts that hold a candidate move.
    held = docs.join(small(candidates.select("doc_id")), "doc_id", "left_semi")
    windows = held.join(candidates, "doc_id").select("doc_id", "text", "found").mapInArrow(extended, "h long, doc_id long, salt int")
    # The first document of each window; a window that many documents hold is dealt over salts, whose firsts meet again.
    one = Window.partitionBy("h", "salt").orderBy("doc_id")
    ranked = windows.withColumn("first", F.first("doc_id").over(one))
    salted = cut_lineage(docs.sparkSession, ranked.filter("first < doc_id OR salt > 0"), "windows")
    again = Window.partitionBy("h").orderBy("doc_id")
    firsts = salted.filter("first = doc_id").withColumn("first", F.first("doc_id").over(again))
    later = salted.filter("first < doc_id").unionByName(firsts.filter("first < doc_id"))
    return later.groupBy("doc_id").agg(F.collect_set("h").alias("windows"))


def covered(h: np.ndarray, marked: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(np.isin(signed(rolling(h, window)), marked))
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its remaining words, joined by one space)."""
    docs = _prepared(docs, id_column, text_column)
    spark = docs.sparkSession
    copies = small(cut_lineage(spark, _copies(docs).filter("copy").select("doc_id"), "copies"))
    marks = cut_lineage(spark, find_repeats(docs.filter("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti"), window), "marks")
    marked = small(marks.select("doc_id"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, copy, marked in columns(batches):
                h = word_hashes(text, False)
                if copy and len(h) >= window:
                    yield doc_id, len(h), len(h), ""
                    continue
                gone = covered(h, np.array(marked, np.int64), window) if marked else np.zeros(len(h), bool)
                kept, at = [], 0
                for part in split_words(text, False):
                    here = gone[at: at + len(part)]
                    kept.append(b" ".join(w for w, g in zip(part, here) if not g) if here.any() else b" ".join(part))
                    at += len(part)
                yield doc_id, len(h), int(gone.sum()), b" ".join(k for k in kept if k).decode("utf-8")

        yield from emit(rows(), schema, 1000)

    none = F.lit(None).cast("array<long>")
    whole = docs.join(copies, "doc_id", "left_semi").select("doc_id", "text", F.lit(True).alias("copy"), none.alias("windows"))
    parts = docs.join(marked, "doc_id", "left_semi").join(marks, "doc_id").select("doc_id", "text", F.lit(False).alias("copy"), "windows")
    rest = docs.join(copies, "doc_id", "left_anti").join(marked, "doc_id", "left_anti").select("doc_id", "text", F.lit(False).alias("copy"), none.alias("windows"))
    return whole.unionByName(parts).unionByName(rest).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
