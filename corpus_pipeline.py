"""Corpus pipeline over ``documents``: quality rules, near-duplicates, repeated
passages, mixing to target weights, SentencePiece ids. Each stage works on what the
one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm import mixing, pieces, quality, simhash, substrings
from paylens.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rules or the outlier test reject go."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each component stays."""
    return simhash.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: words that repeat a passage of an earlier document are removed. A
    text that lost nothing stays as it is, line feeds included; of others, the kept
    words are joined by a space. ``n_chars`` follows."""
    own = {c: f"__own_{c}" for c in docs.columns if c in substrings.RESULTS}  # columns that happen to have its results' names
    cut = substrings.without_repeats(docs.withColumnsRenamed(own))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    told = cut.withColumn("text", text)
    told = told.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return told.drop(*substrings.RESULTS).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the ids of each document with begin and end (little-endian
    32-bit integers), checked against the library, and whether they decode to it."""
    ids = pieces.encode(docs, decoded=True)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can express neither the outlier estimates nor merge-type encoding;
#: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
