"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import shared_dir

#: Fixed value: a word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def ordering_id(column: str = "doc_id") -> Column:
    """A document's place in the order of ids; a null id comes after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))
