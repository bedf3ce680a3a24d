"""Stored bitmaps give the distinct counts of the whole index."""

from pyspark.sql import functions as F

from paylens.operators.appearances import index_stats
from paylens.operators.counts import DistinctCounts

SCHEMA = "display_name string, identifier string, year string, source_file string, extra int"


def _rows(spark, file, names, year="2015"):
    return spark.createDataFrame([(f"N {n}" if n is not None else None, f"{n % 7}" if n is not None and n % 3 else "", year, file, 0)
                                  for n in names], SCHEMA)


def _want(index):
    stats = index_stats(index).first().asDict()
    stats["identifiers"] = index.where("identifier <> ''").select(F.count_distinct("identifier")).first()[0]
    return stats


def test_added_files_and_republication(spark, tmp_path):
    counts = DistinctCounts(spark, str(tmp_path / "counts"))
    assert counts.stats().first().asDict() == {"indexed_matches": 0, "physicians": 0, "identifiers": 0, "years": "Unknown"}
    a, b = _rows(spark, "a.csv", range(0, 400)), _rows(spark, "b.csv", [*range(300, 700), None, 5, 5], "2016")
    counts.add(a.repartition(5))
    counts.add(b.unionByName(_rows(spark, "c.csv", [1, 1000], "Unknown")).repartition(3))
    both = a.unionByName(b).unionByName(_rows(spark, "c.csv", [1, 1000], "Unknown"))
    assert counts.stats().first().asDict() == _want(both)
    again = _rows(spark, "a.csv", range(350, 420))  # a smaller a.csv is published
    counts.add(again)
    counts.add(again)  # a repeated call changes nothing
    counts.add(again.limit(0))
    now = again.unionByName(b).unionByName(_rows(spark, "c.csv", [1, 1000], "Unknown"))
    assert counts.stats().first().asDict() == _want(now)
    numbers = counts.dictionary().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("number").alias("d"),
                                                      F.max("number").alias("m"), F.min("number").alias("l")).collect()
    assert len(numbers) == 2 and all(r.n == r.d == r.m + 1 and r.l == 0 for r in numbers)


def test_counts_read_no_index_rows(spark, tmp_path):
    counts = DistinctCounts(spark, str(tmp_path / "counts"))
    counts.add(_rows(spark, "a.csv", range(50)))
    plan = counts.stats()._jdf.queryExecution().executedPlan().toString()
    assert "display_name" not in plan and "value#" not in plan
