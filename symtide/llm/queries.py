"""Queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import docpairs, leakage, residue, tokenize


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.symbol_pairs(table(spark, d, "symbols")).select("usr")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every documented function symbol."""
    return docpairs.symbol_pairs(table(spark, d, "symbols"))


def p4_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Functions found in the texts themselves, with the comments above them."""
    return docpairs.source_pairs(table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The hash of what the ids of each document decode to, and whether it is the text again."""
    docs = table(spark, d, "documents")
    back = tokenize.decode(tokenize.encode(docs)).withColumnRenamed("text", "decoded")
    met = docs.select("doc_id", "text").join(back, "doc_id")
    return met.select("doc_id", F.md5("decoded").alias("decoded_md5"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tokens of each source and language."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    ids = tokenize.encode(table(spark, d, "documents")).select("doc_id", F.size("ids").cast("long").alias("n"))
    return docs.join(ids, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks that were lightly edited: windows of 16 words within two edits."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=16, max_edits=2)


def p9_suites(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and affected documents of each suite."""
    hits = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    items = table(spark, d, "eval_items").select("item_id", "suite", "split_name")
    return hits.join(items, "item_id").groupBy("suite", "split_name").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents")).select("doc_id")


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    """The message groups behind p10_found, with how widely they recur."""
    return residue.recurring_messages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pairs, p4_source_pairs, p8_ids, p8_round_trip, p8_token_counts, p9_found, p9_near, p9_suites, p10_found, p10_messages)}

#: SQL that DuckDB can run; the other queries are tested against brute force.
ORACLE = {"p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS decoded_md5, true AS same FROM documents"}
