"""Plug-in scorers for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .upsert import MIN_TEXT

# A factory runs once per task and returns the scorer of a batch of texts, which gives one
# (score, magnitude) pair per text, or None for a text it cannot score.
ScorerFactory = Callable[[], Callable[[list[str]], list[tuple[float, float] | None]]]


def score_texts(df: DataFrame, factory: ScorerFactory, text: str = "content") -> DataFrame:
    """Score and magnitude of texts longer than three characters; null for shorter ones and
    for those the scorer fails on. The model is loaded once per task, texts come in batches."""
    fields = [f for f in df.schema.fields if f.name not in ("sentiment_score", "sentiment_magnitude")]
    out = T.StructType([*fields, T.StructField("sentiment_score", T.DoubleType()),
                        T.StructField("sentiment_magnitude", T.DoubleType())])
    keep = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for batch in batches:
            rows = batch[keep].copy()
            long = rows[text].fillna("").str.len() > MIN_TEXT
            pairs = iter(score(rows.loc[long, text].tolist()))
            results = [next(pairs) if is_long else None for is_long in long]
            rows["sentiment_score"] = pd.array([r[0] if r else None for r in results], dtype="Float64")
            rows["sentiment_magnitude"] = pd.array([r[1] if r else None for r in results], dtype="Float64")
            yield rows

    return df.mapInPandas(run, out)


def lexicon_scorer(positive: frozenset[str], negative: frozenset[str]) -> ScorerFactory:
    """A deterministic scorer from two word sets, for tests and as the smallest example."""

    def factory():
        def score(texts: list[str]) -> list[tuple[float, float] | None]:
            out: list[tuple[float, float] | None] = []
            for text in texts:
                words = text.lower().split()
                up = sum(w.strip(".,;:!?") in positive for w in words)
                down = sum(w.strip(".,;:!?") in negative for w in words)
                total = up + down
                out.append(((up - down) / total, float(total)) if total else (0.0, 0.0))
            return out

        return score

    return factory
