"""Exact distinct counts of a growing index (A9, A11, A12), from stored bitmaps.

A dictionary numbers each distinct display name and identifier once, densely, in the
order of arrival. For each yearly file the store keeps its number of index rows, its
year, and per kind the bitmaps of the numbers it holds, 32,768 to a bucket. Adding
files reads those files' index rows alone and meets the dictionary by the distinct
values that they bring; the counts over all files are an OR of bitmaps by bucket,
a map-side partial aggregate, and read neither index rows nor values.

A file added again replaces what it held before; its values keep their numbers. Values
no file holds any more stay in the dictionary and count nothing. An index row belongs
to one file by its keys, so row counts add up. One writer at a time. A failed ``add`` is
simply run again: values that it numbered already keep their numbers.

Nulls in a counted column and empty identifiers are no values. Rows of a null or empty
file name are one file. An empty index adds nothing; an empty store counts zero.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.session import staged

#: What is counted, and the column of the index that holds it.
KINDS = {"physicians": "display_name", "identifiers": "identifier"}
ROWS = "rows"
DICTIONARY = "kind string, value string, number long"
HELD = "kind string, bucket long, bits binary, n long, year string, source_file string"


class DistinctCounts:
    """The counts of an appearance index, kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(os.path.join(self.folder, name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def dictionary(self) -> DataFrame:
        return self._read("dictionary", DICTIONARY)

    def held(self) -> DataFrame:
        return self._read("held", HELD)

    def _number(self, values: DataFrame) -> None:
        """Number the (kind, value) rows that the dictionary lacks, after its greatest.

        Each partition's rows follow on one another; where a partition begins is a
        prefix sum over one row per partition."""
        new = values.join(self.dictionary(), ["kind", "value"], "left_anti")
        new = new.sortWithinPartitions("kind")  # a partition's rows of one kind are a run
        new = staged(new.select("kind", "value", F.monotonically_increasing_id().alias("at")), "counts-new")
        part = F.shiftright("at", 33)
        sizes = new.groupBy("kind", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
        before = F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select("kind", "part", F.coalesce(before, F.lit(0)).alias("start"))
        last = self.dictionary().groupBy("kind").agg(F.max("number").alias("last"))
        starts = starts.join(sizes.select("kind", "part", "first"), ["kind", "part"]).join(last, "kind", "left")
        numbered = new.withColumn("part", part).join(starts, ["kind", "part"])
        number = F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("start") + F.col("at") - F.col("first")
        numbered.select("kind", "value", number.alias("number")).write.mode("append").parquet(
            os.path.join(self.folder, "dictionary"))

    def add(self, index: DataFrame) -> None:
        """Take in the index rows of some files, whole files each."""
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.col(c), F.lit("")).alias("value")) for k, c in KINDS.items()])
        found = index.select("source_file", F.explode(pairs).alias("p")).select("source_file", "p.*")
        found = staged(found.where(F.col("value").isNotNull()).distinct(), "counts-found")
        self._number(found.select("kind", "value").distinct())
        numbers = found.join(self.dictionary(), ["kind", "value"])
        bits = numbers.groupBy("source_file", "kind", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        rows = index.groupBy("source_file", "year").agg(F.count(F.lit(1)).alias("n"))
        held = rows.select(F.lit(ROWS).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"),
                           "n", "year", "source_file")
        held = held.unionByName(bits.select("kind", "bucket", "bits", F.lit(None).cast("long").alias("n"),
                                            F.lit(None).cast("string").alias("year"), "source_file"))
        (held.repartition("source_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_file").parquet(os.path.join(self.folder, "held")))

    def stats(self) -> DataFrame:
        """One row: indexed_matches, the distinct counts of KINDS, and the known years."""
        held = self.held()
        merged = (held.where(F.col("kind") != ROWS).groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
                  .select("kind", F.bitmap_count("bits").alias("n"), F.lit(None).cast("string").alias("year")))
        both = merged.unionByName(held.where(F.col("kind") == ROWS).select("kind", "n", "year"))
        total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
        years = F.array_sort(F.collect_set(F.when(F.col("year") != "Unknown", F.col("year"))))
        return both.agg(total(ROWS).alias("indexed_matches"), *[total(k).alias(k) for k in KINDS],
                        F.when(F.size(years) > 0, F.array_join(years, ", ")).otherwise(F.lit("Unknown")).alias("years"))
