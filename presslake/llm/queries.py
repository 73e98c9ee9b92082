"""Queries of the language-model problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm import leakage, packing, pairs, residue, terms, topn
from presslake.llm.sql import ORACLES  # noqa: F401
from presslake.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n(table(spark, d, "scored_candidates"), "impression_id", "score", "candidate_position", 3)
    return best.select("impression_id", F.col("candidate_position").cast("bigint").alias("candidate_position"))


def _reader_pairs(spark: SparkSession, d: str) -> DataFrame:
    clicked = F.expr("transform(filter(impressions, c -> c.clicked = 1), c -> c.news_id)")
    return pairs.pair_scores(table(spark, d, "behaviors"), "impression_id", [F.col("history"), clicked], 5, 20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _reader_pairs(spark, d).select(F.col("item_a").alias("news_a"), F.col("item_b").alias("news_b"))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    out = _reader_pairs(spark, d)
    return out.select("item_a", "item_b", "n_records", "count_a", "count_b", "n_both", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


TEXTS = ["title", "abstract", "category"]


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return terms.first_versions(table(spark, d, "news"), "news_id", "source_split", "source_row_number", TEXTS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    weights = terms.term_weights(_articles(spark, d), "news_id", TEXTS, k1=None, idf="smooth")
    return terms.top_terms(weights, "news_id", 3).select("news_id", "term")


def p6_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Saturating, length-normalised weights of all terms."""
    weights = terms.term_weights(_articles(spark, d), "news_id", TEXTS)
    return weights.select("news_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one above the capacity."""
    sized = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sized, "doc_id", table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of used space per capacity."""
    packed = p8_pack(spark, d).groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("piece_tokens").alias("n_tokens"))
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").distinct()
    used = F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4)
    return packed.join(F.broadcast(specs), "spec_id").select("spec_id", "n_containers", "n_tokens", used.alias("used"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of twelve words that were edited in at most one word."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=12, edits=1)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue documents."""
    documents = table(spark, d, "documents")
    return residue.without(documents, residue.residue_documents(documents)).select("doc_id", "lang", "source", "n_chars")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_scores, p6_found, p6_relevance, p8_pack, p8_fill, p9_found, p9_edited, p10_found, p10_clean)}
