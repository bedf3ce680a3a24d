"""Paths taken at scale: split CSV files, files with unlike headers, names too many to broadcast."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paylens.constants import PAYMENT_COLUMN
from paylens.operators import batch, matching, report
from paylens.plans.checks import node_counts
from paylens.sources.csv_years import read_payment_file, read_payment_years
from tests.helpers import NEW, OLD, covered_row, write_csv, year_dir


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _names(canon):
    return {r.row_pos: (r.persons[0].first, r.persons[0].last) for r in canon.select("row_pos", "persons").collect()}


def test_row_positions_exact_across_blocks(spark, tmp_path, small_splits):
    rows = [covered_row(f"N{i}", 'L "x", i', "N/A" if i % 7 == 0 else str(i)) for i in range(3000)]
    path = write_csv(tmp_path / "2015_rsh_payments.csv", rows)
    canon = read_payment_file(spark, path, year=2015, multi_line=False)
    assert _names(canon) == {i: (f"N{i}", 'L "x", i') for i in range(3000)}
    ids = {r.row_pos: r.identifier for r in canon.collect()}
    assert all(ids[i] == f"UNKNOWN_{i}" for i in range(3000))


def test_quoted_line_feed_raises_or_is_read_exactly(spark, tmp_path, small_splits):
    rows = [covered_row("An\nn" if i == 700 else f"N{i}", "Li", str(i)) for i in range(1500)]
    path = write_csv(tmp_path / "2015_rsh_payments.csv", rows)
    with pytest.raises(PySparkException, match="line feed"):
        read_payment_file(spark, path, year=2015, multi_line=False)
    for how in (None, True):
        got = _names(read_payment_file(spark, path, year=2015, multi_line=how))
        assert len(got) == 1500 and got[700] == ("An\nn", "Li") and got[701] == ("N701", "Li")


def test_part_files_with_other_headers_are_not_swapped(spark, tmp_path):
    folder = tmp_path / "2016_rsh_payments.csv"
    folder.mkdir()
    write_csv(folder / "part-0.csv", [covered_row("Ann", "Li", "1", npi="1")])
    names = list(covered_row("a", "b", "1"))
    write_csv(folder / "part-1.csv", [covered_row("Bo", "Ng", "2")], columns=names[::-1])
    write_csv(folder / "part-2.csv", [covered_row("Cy", "Oh", "3", npi="7", prefix=OLD)])
    (folder / "part-3.csv").write_text("﻿\n" + ",".join(f'"{n}"' for n in names) + "\n\n" + ",".join(
        {f"{NEW}First_Name": "Di", f"{NEW}Last_Name": "Pe", PAYMENT_COLUMN: "4"}.get(n, "") for n in names) + "\n")
    got = read_payment_years(spark, str(tmp_path), [2016]).collect()
    assert {(r.persons[0].first, r.persons[0].last, float(r.amount), r.identifier, r.row_pos, r.source_file) for r in got} == {
        ("Ann", "Li", 1.0, "1", 0, "2016_rsh_payments.csv"), ("Bo", "Ng", 2.0, "UNKNOWN_1", 1, "2016_rsh_payments.csv"),
        ("Cy", "Oh", 3.0, "7", 2, "2016_rsh_payments.csv"), ("Di", "Pe", 4.0, "UNKNOWN_3", 3, "2016_rsh_payments.csv")}


def test_skipped_year_warns(spark, tmp_path):
    write_csv(tmp_path / "2015_rsh_payments.csv", [{"x": 1}])
    write_csv(tmp_path / "2016_rsh_payments.csv", [covered_row("Ann", "Li", "1")])
    with pytest.warns(UserWarning, match="2015"):
        assert read_payment_years(spark, str(tmp_path), [2015, 2016], on_error="skip_year").count() == 1


def test_large_amounts_stay_exact(spark, tmp_path):
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "100000000000000.25", npi="1"), covered_row("Ann", "Li", "0.5", npi="1")]})
    pay = read_payment_years(spark, d, [2015])
    detail = report.physician_detail(pay, report.single_query(spark, "Ann", None, "Li"), [2015])
    assert str(detail.first().Total_USD) == "100000000000000.750000"


def test_batch_without_broadcast_gives_same_result(spark, tmp_path, monkeypatch):
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1", middle="G"),
                                   covered_row("Bo", "Ng", "7", npi="2",
                                               pi={1: ("Ann", "", "Li", "")}),
                                   covered_row("Ann", "Li", "1", npi="3", pi={1: ("Ann", "G", "Li", "")})]})
    pay = read_payment_years(spark, d, [2015])
    names = batch.names_frame(spark, ["Ann G Li", "Bo Ng", "Ann Li"])
    q = names.select("query_id")

    def run():
        b = batch.BatchReport(pay, names, [2015])
        return sorted((r.Full_Name, r.Total_Payment, r.Total_Entries) for r in b.summary.collect())

    small = run()
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = run()
        parsed = batch.accepted_names(batch.parse_names(names))
        detail = batch.batch_detail(pay, parsed, [2015])
        counts = node_counts(detail)
        shuffled = [x for x in detail._jdf.queryExecution().executedPlan().toString().split("\n")
                    if "Exchange hashpartitioning(kf" in x or "Exchange hashpartitioning(source_file" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert q.count() == 3 and small == big == [("Ann G Li", 14.0, 4), ("Ann Li", 13.0, 3), ("Bo Ng", 7.0, 1)]  # Q3: named twice, counted twice
    assert counts["SortMergeJoin"] >= 2 and counts["BroadcastHashJoin"] == 0
    assert counts["BroadcastNestedLoopJoin"] == 0 and counts["CartesianProduct"] == 0
    assert shuffled


def test_rows_without_a_number_match_alike_on_both_paths(spark, tmp_path, monkeypatch):
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1"), covered_row("Ann", "Li", "5", npi="1"), covered_row("Bo", "Ng", "7")]})
    pay = read_payment_years(spark, d, [2015]).withColumn("row_pos", F.lit(None).cast("bigint"))
    prepared = matching.prepare_queries(report.single_query(spark, "Ann", None, "Li"))
    few = matching.match_rows(pay, prepared, query_bytes=100).count()
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)
    assert few == matching.match_rows(pay, prepared, query_bytes=100).count() == 2


def test_staged_tables_can_be_dropped(spark, monkeypatch):
    import os

    from paylens import session
    monkeypatch.setattr(session, "_MADE", [])
    df = session.staged(spark.range(3), "drop-me")
    (path,) = session._MADE
    assert df.count() == 3 and os.path.isdir(path)
    assert session.drop_staged(spark) == 1 and not os.path.exists(path) and session.drop_staged(spark) == 0


def test_readers_limit_generated_methods(spark, tmp_path):  # beyond 8000 bytes the JIT compiles none
    name = "spark.sql.codegen.hugeMethodLimit"
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1")]})
    try:
        for given, after in (("65535", "8000"), ("9000", "9000")):
            spark.conf.set(name, given)
            assert read_payment_years(spark, d, [2015]).count() == 1 and spark.conf.get(name) == after
    finally:
        spark.conf.unset(name)


def test_rows_are_numbered_without_an_exchange_of_rows(spark, monkeypatch):
    from paylens.session import staged
    from paylens.sources import csv_years
    told = [("u", "a", 0, 5), ("u", "a", 0, 6), ("u", "a", 9, 7), ("u", "b", 0, 9), ("v", "c", 0, 1)]
    rows = staged(spark.createDataFrame(told, "_unit string, _file string, _block long, _mid long"), "numbered-rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, places = csv_years.numbered(rows), {}
        counts = node_counts(few)
        for blocks in (csv_years.BLOCKS, 0):
            monkeypatch.setattr(csv_years, "BLOCKS", blocks)
            places[blocks] = sorted((r["_unit"], r["_file"], r["_mid"], r["_pos"]) for r in csv_years.numbered(rows).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts["BroadcastHashJoin"] == 1 and counts["SortMergeJoin"] == 0
    assert [p[3] for p in places[0]] == [0, 1, 2, 3, 0] and len(set(map(tuple, places.values()))) == 1
