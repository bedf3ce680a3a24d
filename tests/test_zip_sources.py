"""Pruning of ZIP members and the store of decoded members."""

import zipfile

from pyspark.sql import functions as F

from paylens.sources import zip_store
from paylens.sources.zip_source import ZipCsvReader, member_year, read_zip_payments
from tests.helpers import covered_row, write_csv


def archive(tmp_path, name, members):
    path = tmp_path / name
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for member, rows in members.items():
            zf.write(write_csv(tmp_path / "m.csv", rows), member)
    return path


def rows(df):
    return sorted((r.source_file, r.year, r.row_pos, r.persons[0].first, r.identifier) for r in df.collect())


def test_filters_reach_the_source(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    for y in (2019, 2020):
        archive(folder, f"{y}.zip", {f"{y}_a.csv": [covered_row("Ann", "Li", "5")] * 3, f"x/{y}_b.csv": [covered_row("Bo", "Ng", "7")],
                                     "undated.csv": [covered_row("Cy", "Oh", "1")]})
    every = read_zip_payments(spark, str(folder))
    assert len(rows(every)) == 10
    for cond in (F.col("year") == 2020, F.col("year").isin(2020, 2031), F.col("year") > 2019, F.col("source_file").startswith("x/"),
                 F.col("source_file") == "2019_a.csv", F.col("year").isNull(), (F.col("year") >= 2019) & (F.col("source_file").contains("_b"))):
        want = every.withColumn("k", F.monotonically_increasing_id()).where(cond)  # not pushed through the id
        assert rows(every.where(cond)) == rows(want)
    one, all_ = every.where(F.col("year") == 2020), every
    assert one.rdd.getNumPartitions() < all_.rdd.getNumPartitions()
    assert "(year" not in one._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]


def test_reader_keeps_what_it_cannot_decide(tmp_path):
    from pyspark.sql import datasource as ds

    reader = ZipCsvReader(str(tmp_path))
    given = [ds.EqualTo(("year",), 2020), ds.EqualTo(("c1",), "x"), ds.IsNull(("year",)), ds.IsNotNull(("year",))]
    assert list(reader.pushFilters(given)) == [given[1], given[2]]
    assert reader._chosen("a/2020.csv") and not reader._chosen("a/2021.csv") and not reader._chosen("none.csv")
    assert member_year("x/1999-2001.csv") == 1999 and member_year("part-1.csv") is None


def test_store_decodes_changes_only_and_equals_the_archives(spark, tmp_path):
    folder, store = tmp_path / "zips", str(tmp_path / "store")
    folder.mkdir()
    archive(folder, "a.zip", {"2019.csv": [covered_row(f"N{i}", "Li", str(i)) for i in range(500)], "undated.csv": [covered_row("Cy", "Oh", "1")],
                              "empty.csv": [{"x": 1}]})
    archive(folder, "b.zip", {"2020.csv": [covered_row("Bo", "Ng", "7")]})
    assert zip_store.refresh(spark, str(folder), store) == 4
    assert zip_store.refresh(spark, str(folder), store) == 0
    assert rows(zip_store.read_store(spark, store)) == rows(read_zip_payments(spark, str(folder)))
    archive(folder, "b.zip", {"2020.csv": [covered_row("Changed", "Ng", "8")], "2021.csv": [covered_row("Di", "Pe", "9")]})
    assert zip_store.refresh(spark, str(folder), store) == 2
    assert rows(zip_store.read_store(spark, store)) == rows(read_zip_payments(spark, str(folder)))
    (folder / "a.zip").unlink()
    assert zip_store.refresh(spark, str(folder), store) == 0
    left = zip_store.read_store(spark, store)
    assert [r[3] for r in rows(left)] == ["Changed", "Di"]
    assert "year=2021" in " ".join(left.where("year = 2021").inputFiles()) and len(left.where("year = 2021").collect()) == 1


def test_stored_member_is_read_in_splits(spark, tmp_path):
    folder, store = tmp_path / "zips", str(tmp_path / "store")
    folder.mkdir()
    archive(folder, "a.zip", {"2019.csv": [covered_row(f"N{i}", f"L{i * 7919 % 10007}", str(i)) for i in range(4000)]})
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    zip_store.refresh(spark, str(folder), store)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert zip_store.read_store(spark, store).rdd.getNumPartitions() > 1
        assert zip_store.read_store(spark, store).count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
