"""Language by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams of space-padded lower-case words, in order; so is a document's. The
distance of a document to a language is the sum over the document's n-grams of how far their places differ, those that
the language's profile lacks counting as its length. The nearest language wins, of equally near ones the first by name.

Profiles count every learning document whole. Null texts and those without a letter are ``und`` with score 0, as is
all if there is nothing to learn from. Every row gives one row, also those without or with repeated ids; rows with a null
language teach nothing. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import Counts, gathered, gram_counts, to_code, to_gram
from .words import columns, emit, emit_arrays

PLACES = 300


def ranked(counts: Counts, places: int) -> np.ndarray:
    """Codes of the most frequent n-grams; equally frequent ones by code point."""
    codes, n = counts
    if len(codes) > 2 * places:
        often = n >= np.partition(n, len(n) - places)[len(n) - places]
        codes, n = codes[often], n[often]
    return codes[np.lexsort((codes, -n))][:places]


def learn_profiles(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", places: int = PLACES) -> dict[str, dict[str, int]]:
    """{language: {n-gram: place}} from all rows given; as large as languages times ``places``."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((np.full(len(codes), lang, object), codes.view(np.int64), n) for lang, codes, n in gathered((lang, text) for text, lang in columns(batches)))
        yield from emit_arrays(parts, schema)

    texts = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    counts = (texts.filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("place", place).filter(F.col("place") <= places).collect():
        profiles.setdefault(r["lang"], {})[to_gram(r["gram"])] = r["place"] - 1
    return profiles


class Profiles:
    """The places of all profiles' n-grams, one row a language; those that a profile lacks are marked."""

    def __init__(self, profiles: dict[str, dict[str, int]], places: int):
        self.names, self.places = sorted(profiles), places
        self.codes = np.array(sorted({to_code(g) for p in profiles.values() for g in p}), np.uint64)
        self.at = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for row, name in zip(self.at, self.names):
            row[np.searchsorted(self.codes, np.array([to_code(g) for g in profiles[name]], np.uint64))] = list(profiles[name].values())

    def nearest(self, counts: Counts) -> tuple[str, float]:
        """The language and how clearly it is nearer than the next: its rival's share of both distances."""
        own = ranked(counts, self.places)
        at = np.searchsorted(self.codes, own)
        known = np.append(self.codes, np.uint64(0))[at] == own
        place = self.at[:, np.where(known, at, len(self.codes))]
        far = np.where(place < 0, self.places, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best, *others = sorted(zip(far.tolist(), self.names))
        rival = others[0][0] if others else self.places * len(own)
        return best[1], rival / (best[0] + rival) if best[0] + rival else 1.0


def predict_language(docs: DataFrame, profiles: dict[str, dict[str, int]], id_column: str = "doc_id", text_column: str = "text",
                     places: int = PLACES) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(sent.value, places)

        def rows():
            for doc_id, text in columns(batches):
                counts = gram_counts(text)
                yield (doc_id, *known.nearest(counts)) if len(counts[0]) and known.names else (doc_id, "und", 0.0)

        yield from emit(rows(), schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
