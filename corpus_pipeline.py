"""Preparing ``documents`` for training: toxic texts go, one of each group of near duplicates stays, contaminated texts
go, secrets are blanked out, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept; all but the last return the columns
of their input. Rows without an id are kept unless their own text is toxic or contaminated (nothing tells which of two
such copies comes first). Of rows that repeat an id one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mostrador.llm import decontaminate, jaccard, packing, secrets, toxicity
from mostrador.llm.queries import remainder, table
from mostrador.llm.sides import small
from mostrador.session import cut_lineage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Toxicity from which a document goes.
MOST_TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the limit; labels teach as in the operator's query."""
    score = toxicity.learned_scorer(docs, docs.filter(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return docs.filter(score(F.col("text").cast("string")) < MOST_TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of linked documents."""
    groups = jaccard.similar_groups(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    groups = cut_lineage(spark, groups, "components")
    stay = groups.filter("doc_id = component_id")
    # Sent or shuffled, the smaller side: the ids that stay or those that go.
    kept = docs.join(small(groups.filter("doc_id <> component_id OR rows > 1").select("doc_id")), "doc_id", "left_anti")
    again = docs.join(small(stay.filter("rows > 1").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(again).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version"))
    bad = small(cut_lineage(spark, bad.distinct(), "contaminated-documents"))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_version"])
    return docs.join(bad, same, "left_anti")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the value of every secret replaced and ``n_chars`` counted anew where the table has it."""
    clean = docs.withColumn("text", secrets.redactor(RANKS)(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024."""
    return packing.pack(docs, VOCABULARY, RANKS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", blank_secrets),
          ("packing", pack_sequences)]
# Scores, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
