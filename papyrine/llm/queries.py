"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import decontaminate, gru_lm, html_text, lemp, ngram_join, oracles, packing, quality, rp_forest, secrets, substring_dedup, suffix_dedup, variants, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The scores of trained models, packing, alignment, extraction and token counts are beyond SQL; tests check them.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op4_suffix_array": oracles.REPEATED_BYTES,
    "op5_projection_forest": oracles.NEAR_VECTORS,
    "op6_window_doubling": oracles.REPEATED_WINDOWS,
    "op11_bloom_variants": oracles.SPELLING_VARIANTS,
    "op12_norm_buckets": oracles.RANKED_SEARCH,
    "op13_secret_owners": oracles.SECRETS,
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_gru_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by a recurrent language model, beside a unigram base."""
    return gru_lm.score(table(spark, folder, "documents"))


@query
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query
def op3_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, filled with lexical neighbours."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op4_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Removal of every string of 200 bytes that occurs elsewhere, by induced suffix arrays."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op5_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.95 or more, by random-projection trees."""
    return rp_forest.near_vectors(table(spark, folder, "embeddings"))


@query
def op6_window_doubling(spark: SparkSession, folder: str) -> DataFrame:
    """Removal of every run of 35 words that occurs elsewhere, level by level."""
    return substring_dedup.remove_windows(table(spark, folder, "documents"))


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of documents that lie within the edit budget of a benchmark item."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_text_density(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page by composite text density."""
    return html_text.extract(table(spark, folder, "pages"))


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy word pieces of every document, counted by a linear longest-match automaton."""
    return wordpiece.token_counts(table(spark, folder, "documents"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality by a byte-level convolutional network."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op11_bloom_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with its most frequent near spelling and the root that forms lead to, by Bloom-guided edits."""
    return variants.group(table(spark, folder, "documents"))


@query
def op12_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item, by norm buckets of impact vectors."""
    return lemp.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_secret_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base patterns, and values that one owner alone holds."""
    return secrets.scan(table(spark, folder, "documents"))
