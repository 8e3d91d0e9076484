"""Grouping and matching that stay whole when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key in ``order``, numbered in ``rank``.

    The filter sits right on the row number, so Spark keeps at most ``k`` rows per key in
    every map task before the shuffle: a hot key costs ``k`` rows per task, not all rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def collect_parts(df: DataFrame, keys: Sequence[str], element: Column, name: str, max_rows: int = 50_000) -> DataFrame:
    """Sorted array of ``element`` per key in parts of ``max_rows`` elements, numbered in ``part`` from 0; ``parts`` is how
    many the key has. Parts put one after the other are the key's sorted array.

    Rows are ranged by key, element and a number of their own, so that neither a hot key nor an element that comes very often
    stays in one task. Each task numbers its own rows, and the counts of the ranges before lift them to places in the key.
    Null elements are left out, as collecting them does; keys may be null.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*keys).alias("_key"), element.alias("_element")).where(F.col("_element").isNotNull())
    rows = cut_lineage(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "elements")
    ranged = cut_lineage(spark, rows.repartitionByRange("_key", "_element", "_row").withColumn("_range", F.spark_partition_id()), "ranged-elements")
    before = Window.partitionBy("_key").orderBy("_range")
    counts = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_key", "_range", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_key")).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_key", "_range").orderBy("_element", "_row"))
    placed = ranged.withColumn("_place", own).join(offsets, ["_key", "_range"]).select(
        "_key.*", "_element", F.floor((F.col("_before") + F.col("_place") - 1) / max_rows).alias("part"), F.ceil(F.col("_all") / max_rows).alias("parts"))
    # Spread by part as well: rows clustered by the keys alone would stay in one task.
    return placed.repartition(*keys, "part").groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list("_element")).alias(name), F.first("parts").alias("parts"))


# Characters per piece of a long text.
PIECE = 1024
# Hashed bits per value of a side that is looked up, the least there are (8 KB), and the most (8 MB) however many values it has.
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def hashed_in(values: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every value of ``values`` (one column) and false for nearly all others.

    The values go to tasks as the bits of their hashes only, of which a constant bounds the number. What passes is
    still to be joined; rows that cannot match are left out where they are made and never shuffled. ``values`` is
    counted, so it should be a stored table.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * values.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(values.columns[0]))
    word, low = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), low)
    rows = values.select(word.alias("word"), one.alias("bits"))
    # Every word is there, so that a word's number is its place.
    none = values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = rows.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # Put together by runs of words, which tasks hold as numbers; a million words in one task would each be an object there.
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda w: w[value])
    runs = words.groupBy(F.shiftright("word", 10).alias("run")).agg(in_order("word", "bits").alias("bits"))
    table = runs.agg(F.flatten(in_order("run", "bits"))).scalar()

    def test(c: Column) -> Column:
        h = place(c)
        return F.getbit(F.get(table, F.shiftright(h, 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1

    return test


def contained(hay: DataFrame, ids: Sequence[str], text: str, needles: DataFrame, needle: str, anchor: int = 4) -> DataFrame:
    """(row id, needle) rows for every needle that the row's text contains, and a few for other pieces of the text.

    Each row is a true substring of its text, so a join with the needles, or with anything known of them, leaves the exact
    matches. Nothing is shuffled here. Each text position offers its first 1 to ``anchor`` characters; where some needle
    starts so, it offers the lengths that needles have, of which those that are no needle's hash are left out. A row may
    come more than once. Empty needles are left to the caller. ``needles`` should be a stored table.
    """
    known = needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct()
    starts = F.explode(F.array_distinct(F.array("needle", F.substring("needle", 1, anchor))))
    may_be = hashed_in(known.select(starts.alias("needle")).distinct())
    # One row of facts about the needles: their lengths, the longest, and the anchor sizes in use.
    facts = known.agg(F.struct(
        F.max(F.length("needle")).alias("longest"), F.sort_array(F.collect_set(F.length("needle"))).alias("lens"),
        F.sort_array(F.collect_set(F.least(F.length("needle"), F.lit(anchor)))).alias("sizes"))).scalar()
    # Long texts are cut into pieces that overlap by the longest needle, and each piece into
    # the windows that start at its characters: every character is visited once per window,
    # however long the text is.
    def cut(size: Column, step: str) -> Column:
        return F.concat(F.lit("(?s)(?=(.{1,"), size.cast("string"), F.lit("})).{1," + step + "}"))

    at = (
        hay.where(F.length(text) > 0)
        .select(*ids, F.col(text).alias("_text"), facts.alias("_facts"))
        .select(*ids, "_facts", F.explode(F.regexp_extract_all("_text", cut(F.col("_facts.longest") + PIECE, str(PIECE)), F.lit(1))).alias("_piece"))
        .select(*ids, "_facts", F.explode(F.regexp_extract_all("_piece", cut(F.col("_facts.longest"), "1"), F.lit(1))).alias("_rest"))
        .select(*ids, "_rest", F.col("_facts.lens").alias("_lens"), F.explode("_facts.sizes").alias("_size"))
        .where((F.length("_rest") >= F.col("_size")) & may_be(F.expr("substr(_rest, 1, _size)")))
    )
    # A start shorter than an anchor is a whole needle; the others start a needle.
    fits = F.expr(f"filter(_lens, n -> n <= length(_rest) AND n >= _size AND (n = _size OR _size = {anchor}))")
    return at.select(*ids, "_rest", F.explode(fits).alias("_len")).select(
        *ids, F.expr("substr(_rest, 1, _len)").alias("needle")).where(may_be(F.col("needle")))


def contains_matches(hay: DataFrame, ids: Sequence[str], text: str, needles: DataFrame, needle: str, anchor: int = 4) -> DataFrame:
    """Every (row id, needle) where the row's text contains the needle, by an equi-join.

    The pieces of text that may be needles meet the distinct needles: no pairs of rows and needles are formed, a needle
    shared by many rows costs one row per match, and rows never carry the whole text. Empty needles are left to the caller.
    """
    known = cut_lineage(needles.sparkSession, needles.select(F.col(needle).alias("needle")).distinct(), "needles")
    hits = contained(hay, ids, text, known, "needle", anchor)
    # Spread by row id before the distinct, so that a needle many rows contain is not one task.
    return hits.join(known, "needle", "left_semi").select(*ids, "needle").repartition(*ids, "needle").distinct()


def contained_words(hay: DataFrame, ids: Sequence[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """(row id, needle) rows for every name that stands in the row's text as whole words, and a few for other words.

    Texts and names are words joined by one space each. A text offers its runs of as many words as some name has, of which
    those that are no name's hash are left out, so that nothing is shuffled here. Each row is a true run of its text and may
    come more than once. ``names`` should be a stored table.
    """
    known = names.select(F.col(name).alias("needle")).where(F.col(name) != "").distinct()
    sizes = known.agg(F.collect_set(F.size(F.split("needle", " ")))).scalar()
    run = F.concat(F.lit("(?<![^ ])(?=([^ ]+(?: [^ ]+){"), (F.col("_size") - 1).cast("string"), F.lit("})(?![^ ])).[^ ]*"))
    return (
        hay.select(*ids, F.col(text).alias("_text"), F.explode(sizes).alias("_size"))
        .select(*ids, F.explode(F.regexp_extract_all("_text", run, F.lit(1))).alias("needle"))
        .where(hashed_in(known)(F.col("needle")))
    )


def word_matches(hay: DataFrame, ids: Sequence[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """Every (row id, name) where the name stands in the row's text as whole words, by an equi-join; a name that many rows
    hold costs one row per match."""
    known = cut_lineage(names.sparkSession, names.select(F.col(name).alias("needle")).distinct(), "names")
    runs = contained_words(hay, ids, text, known, "needle").join(known, "needle", "left_semi")
    return runs.select(*ids, "needle").repartition(*ids, "needle").distinct().withColumnRenamed("needle", name)
