"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every six neighbouring 8-word hashes the least is kept as a fingerprint, in documents and items alike. Any 13 words
that both share hold a common fingerprint, because they hold six 8-word runs. Documents whose fingerprints meet an
item's are read again to place the hits, and each is extended to the 13-word windows around it, which are compared as text.
Items shorter than a window are one window; their length's runs are all kept, which is winnowing with a step of one.

Words are runs of digits, ASCII letters (A-Z folded) and characters beyond ASCII. Null and empty texts have none: such
documents have no hit, such items no window. Items without an id hit but are not listed. Rows that repeat an id stand
for themselves, each judged by its own text; equal rows get equal results. Empty tables are allowed on either side;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sides import small

WINDOW = 13
GRAM = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What lies between words, once A-Z are folded, and before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_ANY_CASE), "")).cast("long")


def runs(items: Column, width: int, each) -> Column:
    """``each(slice, start)`` for every run of ``width`` elements; starts count from 0."""
    return F.transform(F.when(F.size(items) >= width, F.sequence(F.lit(0), F.size(items) - width)).otherwise(F.array().cast("array<int>")),
                       lambda i: each(F.slice(items, i + 1, width), i))


def grams(items: Column, gram: int) -> Column:
    return let(F.transform(items, lambda w: F.xxhash64(w)), lambda hs: runs(hs, gram, lambda part, _: F.xxhash64(part)))


def minima(values: Column, width: int) -> Column:
    """Least of each value and its followers, ``width`` in all, by doubling; at the end of those there are."""
    def shifted(have: int, by: int):
        return lambda xs: reach(F.transform(xs, lambda x, i: F.least(x, F.get(xs, i + by))), have + by)

    def reach(xs: Column, have: int) -> Column:
        return xs if have == width else let(xs, shifted(have, min(have, width - have)))

    return reach(values, 1)


def fingerprints(items: Column, window: int, gram: int) -> Column:
    """(window, hash) of the 8-word runs that are least among the runs of some window."""
    marks = F.transform(F.array_distinct(minima(grams(items, gram), window - gram + 1)), lambda h: mark(F.lit(window), h))
    return F.when(F.size(items) >= window, marks).otherwise(F.array().cast("array<struct<length:int,h:bigint>>"))


def mark(length: Column, h: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), h.alias("h"))


def short_runs(items: Column, width: int) -> Column:
    """All runs of a short item's length, hashed with that length."""
    return runs(items, width, lambda part, _: mark(F.lit(width), F.xxhash64(F.lit(width), part)))


def places(items: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """(start, length, hash) of every run that may be a fingerprint."""
    def placed(marks: Column) -> Column:
        return F.transform(marks, lambda m, i: F.struct(i.alias("start"), m["length"].alias("length"), m["h"].alias("h")))

    return F.concat(placed(F.transform(grams(items, gram), lambda h: mark(F.lit(window), h))), *(placed(short_runs(items, n)) for n in lengths))


def candidate_windows(items: Column, hits: Column, window: int, gram: int) -> Column:
    """(start, length, text) of the windows that hold a hit."""
    def near(h: Column) -> Column:
        reach = F.sequence(F.greatest(h["start"] - (window - gram), F.lit(0)), F.least(h["start"], F.size(items) - window))
        return F.when((h["length"] == window) & (F.size(items) >= window), F.transform(reach, lambda s: F.struct(s.alias("start"), h["length"].alias("length")))).otherwise(
            F.when(h["length"] < window, F.array(F.struct(h["start"].alias("start"), h["length"].alias("length")))).otherwise(
                F.array().cast("array<struct<start:int,length:int>>")))

    return F.transform(F.array_distinct(F.flatten(F.transform(hits, near))), lambda s: F.struct(
        s["start"].alias("start"), s["length"].alias("length"), F.array_join(F.slice(items, s["start"] + 1, s["length"]), " ").alias("window")))


def benchmark_windows(items: DataFrame, window: int, gram: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Stored tables of item windows: fingerprints, (window, group), (group, items), and the short lengths in use."""
    spark = items.sparkSession
    ws = items.select(F.col(id_column).cast("string").alias("item_id"), words(F.col(text_column).cast("string")).alias("ws")).filter(F.size("ws") > 0)
    size = F.size("ws")
    texts = F.when(size >= window, runs(F.col("ws"), window, lambda part, _: F.array_join(part, " "))).otherwise(F.array(F.array_join("ws", " ")))
    owned = (ws.select("item_id", F.explode(texts).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
             .withColumn("group", F.sha2(F.to_json("items"), 256)))
    owned = cut_lineage(spark, owned, "benchmark-windows")
    prints = ws.select(F.explode(F.when(size >= window, fingerprints(F.col("ws"), window, gram)).otherwise(
        F.array(mark(size, F.xxhash64(size, F.col("ws")))))).alias("p")).select(F.col("p.h").alias("h"), F.col("p.length").alias("length")).distinct()
    prints = cut_lineage(spark, prints, "benchmark-fingerprints")
    lengths = sorted(r["length"] for r in prints.filter(F.col("length") < window).select("length").distinct().collect())
    return prints, owned.select("window", "group"), owned.select("group", "items").dropDuplicates(["group"]), lengths


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id",
                  text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, version (hash of its text), n_words, n_hit (words inside an occurring window), items
    (sorted ids as text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    prints, owned, groups, lengths = benchmark_windows(items, window, gram, item_id, item_text)
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version"))

    def renamed(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"doc_id": "of_id", "version": "of_version"})

    def marks(ws: Column) -> Column:
        return F.concat(fingerprints(ws, window, gram), *(short_runs(ws, n) for n in lengths))

    sent = small(prints)
    found = (docs.select("doc_id", "version", F.explode(let(words(F.col("text")), marks)).alias("p"))
             .select("doc_id", "version", "p.length", "p.h").join(sent, ["h", "length"], "left_semi"))
    met = cut_lineage(spark, found.groupBy("doc_id", "version").agg(F.count("*").alias("n")), "documents-met")
    placed = (docs.join(renamed(small(met)), same, "left_semi")
              .select("doc_id", "version", F.explode(let(words(F.col("text")), lambda ws: places(ws, window, gram, lengths))).alias("p"))
              .select("doc_id", "version", "p.start", "p.length", "p.h").join(sent, ["h", "length"], "left_semi"))
    hits = cut_lineage(spark, placed.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "length")).alias("hits")), "fingerprint-hits")
    windows = (docs.join(renamed(small(hits)), same).select("doc_id", "version", F.explode(let(
        words(F.col("text")), lambda ws: candidate_windows(ws, F.col("hits"), window, gram))).alias("w"))
        .select("doc_id", "version", "w.start", "w.length", "w.window"))
    spans = windows.join(small(owned), "window").select("doc_id", "version", "start", "length", "group")
    one = spans.groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("group").alias("groups"))
    one = cut_lineage(spark, one.select("doc_id", "version", F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("n_hit"), "groups"), "hit-words")
    named = (one.select("doc_id", "version", F.explode("groups").alias("group")).join(small(groups), "group")
             .groupBy("doc_id", "version").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    counted = one.join(renamed(named), same, "left").select("doc_id", "version", "n_hit", "items")
    counted = small(cut_lineage(spark, counted, "contaminated"))
    sized = docs.select("doc_id", "version", n_words(F.col("text")).alias("n_words"))
    return sized.join(renamed(counted), same, "left").select(
        "doc_id", "version", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: float = 0.05) -> Column:
    """At least ``share`` of the words, and one, lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words"))
