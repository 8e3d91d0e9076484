"""One registered query per operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, jaccard, langid, lexical, licenses, oracles, packing, secrets, substring, toxicity, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The other operators' results are beyond SQL.
ORACLES: dict[str, str] = {"op11_url_filter": oracles.url_filter(), "op12_prefix_trie": oracles.PREFIX_TRIE, "op13_lexical_search": oracles.LEXICAL_SEARCH}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of those whose remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, docs.filter(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return ann.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, similarity 0.75."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 13-word windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents; the one of most aligned words first."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.element_at(F.array_sort("notices", lambda a, b: F.when(a["aligned"] != b["aligned"], b["aligned"] - a["aligned"]).otherwise(a["start"] - b["start"]).cast("int")), 1)
    listed = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"], n["end"])), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.when(F.size("notices") > 0, best["license"]).alias("license"),
                        F.when(F.size("notices") > 0, best["coverage"]).alias("coverage"), listed.alias("spans"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those whose remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.learn_profiles(docs.filter(remainder(3) != 1)))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: known forms and strings of few characters per token."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    base = F.filter("spans", lambda s: s["kind"] != "dense")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), count("dense"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that start in an earlier document too."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 1024."""
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URLs of all pages, by rules and else by character models of what the rules decide."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), oracles.URL_RULES)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, first turns shared within families of 20."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), family=20, heads=4)


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
