"""Exports are files under their names, put together in order, or numbered files."""

import os

import pytest
from pyspark.sql import functions as F

from paylens.operators import exports


def _listed(path):
    return sorted(n for n in os.listdir(path) if not n.endswith(".crc"))


def test_one_file_in_order_and_replaced(spark, tmp_path):
    target = f"{tmp_path}/out/x.csv"
    df = spark.range(1000).select(F.col("id").alias("a"), F.concat(F.lit('q "'), "id", F.lit('",\nz')).alias("b")).orderBy(F.desc("a"))
    df.write.csv(target)  # a folder of the same name, as Spark writes it
    assert [p.split(":")[-1].lstrip("/") for p in exports.write_file(df.repartitionByRange(7, F.desc("a")).sortWithinPartitions(F.desc("a")), target)] == [
        target.lstrip("/")]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(target).collect()
    assert [int(r.a) for r in back] == list(range(999, -1, -1)) and back[0].b == 'q "999",\nz'
    exports.write_file(df.limit(0), target)
    assert open(target).read() == "a,b\n" and _listed(f"{tmp_path}/out") == ["x.csv"]


def test_large_exports_are_numbered_and_former_forms_go(spark, tmp_path):
    target, df = f"{tmp_path}/x.csv", spark.range(0, 100, 1, 4).select("id")
    exports.write_file(df, target)
    made = exports.write_file(df, target, one_file=10, rows=10)
    assert len(made) == 12 and _listed(tmp_path) == [f"x.part-{i:05d}.csv" for i in range(1, 13)]
    read = [open(f"{tmp_path}/{n}").read().split() for n in _listed(tmp_path)]
    assert all(r[0] == "id" and len(r) <= 11 for r in read) and [int(v) for r in read for v in r[1:]] == list(range(100))
    exports.write_file(df.where("id < 40"), target, one_file=10, rows=20)
    assert _listed(tmp_path) == ["x.part-00001.csv", "x.part-00002.csv", "x.part-00003.csv"]
    exports.write_file(df, target)
    assert _listed(tmp_path) == ["x.csv"]


def test_a_failed_export_leaves_the_former_one(spark, tmp_path):
    target = f"{tmp_path}/x.csv"
    exports.write_file(spark.range(3), target)
    with pytest.raises(Exception):
        exports.write_file(spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")), target)
    assert open(target).read() == "id\n0\n1\n2\n" and _listed(tmp_path) == ["x.csv"]
    os.makedirs(f"{tmp_path}/mine.csv/kept")
    with pytest.raises(FileExistsError):
        exports.write_file(spark.range(1), f"{tmp_path}/mine.csv")
    assert os.path.isdir(f"{tmp_path}/mine.csv/kept")
    with pytest.raises(ValueError):
        exports.write_file(spark.range(1).select(F.col("id").alias("a,b")), target)


def test_a_file_for_each_value(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("n-"), (F.col("id") % 3).cast("string")).alias("file"), "id", F.lit("x").alias("c"))
    ordered = df.repartitionByRange(4, "file", "id").sortWithinPartitions("file", "id")
    assert exports.write_files(ordered, "file", f"{tmp_path}/d") == 3 and _listed(f"{tmp_path}/d") == ["n-0.csv", "n-1.csv", "n-2.csv"]
    rows = open(f"{tmp_path}/d/n-1.csv").read().split()
    assert rows[0] == "id,c" and [int(r.split(",")[0]) for r in rows[1:]] == list(range(1, 300, 3))
