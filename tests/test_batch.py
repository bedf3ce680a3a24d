"""Batch reports (reference CLI batch test + alerts, counters, rejects, plan shape)."""

from paylens.operators import batch
from paylens.plans.checks import PYTHON_NODES, node_counts
from paylens.sources.csv_years import read_payment_years
from tests.helpers import covered_row, year_dir

BGD = dict(middle="G", npi="1154454635", specialty="Orthopedic Surgery")


def _setup(spark, tmp_path, names):
    d = year_dir(tmp_path, {2015: [
        covered_row("Benjamin", "Domb", "200.0", **BGD),
        covered_row("Alice", "Smith", "90.0", middle="M", npi="2233445566",
                    specialty="Cardiology"),
        covered_row("Alice", "Smith", "10.0", npi="9999999999"),
    ]})
    names_file = tmp_path / "names.txt"
    names_file.write_text("\n".join(names) + "\n")
    pay = read_payment_years(spark, d, [2015])
    return batch.BatchReport(pay, batch.read_names(spark, str(names_file)), [2015])


def test_batch_summary_and_details(spark, tmp_path):  # R12
    b = _setup(spark, tmp_path, ["Benjamin G Domb", "", "Alice M Smith", "  "])
    rows = b.ordered_summary().collect()
    # the wide search of "Alice M Smith" also finds the middle-less Alice Smith row
    assert [(r.Full_Name, r.Total_Payment) for r in rows] == [
        ("Benjamin G Domb", 200.0), ("Alice M Smith", 100.0)]
    assert b.detail.select("query_id").distinct().count() == 2


def test_rejects_alerts_counters(spark, tmp_path):  # N11, N15, Q18-Q20
    b = _setup(spark, tmp_path, ["Domb", "Alice Smith", "Nobody Here", "(retired)",
                                 "Alice Smith"])
    assert sorted(r.raw for r in b.rejected.collect()) == ["(retired)", "Domb"]
    summary = b.summary.collect()
    assert len(summary) == 3                     # duplicates are not merged
    assert {r.Full_Name: r.Total_Payment for r in summary}["Nobody Here"] == 0.0
    alerts = b.alerts().collect()
    assert {r.NPI for r in alerts} == {"2233445566", "9999999999"}
    assert {r.name for r in alerts} == {"Alice Smith"}
    c = b.counters().first()
    assert (c.physicians_processed, c.total_unique_npis, c.physicians_with_multiple_npis) == (
        3, 2, 1)
    totals = {r.label: r.total_payment for r in b.totals_by_year().collect()}
    assert totals == {"2015": 200.0, "TOTAL": 200.0}  # two Alice rows of 100 each
    top = b.top(2).collect()
    assert [r.Total_Payment for r in top] == [100.0, 100.0]


def test_outputs_do_not_read_the_payments_again(spark, tmp_path):
    b = _setup(spark, tmp_path, ["Benjamin G Domb", "Alice M Smith"])
    for out in (b.detail, b.summary, b.ordered_summary(), b.alerts(), b.flagged_summary(), b.counters(),
                b.totals_by_year(), b.top(10), b.rejected):
        files = " ".join(out.inputFiles())
        assert "batch-" in files and "csv-rows" not in files and "payments" not in files
    assert node_counts(b.top(10))["TakeOrderedAndProject"] == 1
    assert "Window" not in b.alerts()._jdf.queryExecution().executedPlan().toString()


def test_match_plan_shape(spark, tmp_path):
    b = _setup(spark, tmp_path, ["Benjamin G Domb", "Alice M Smith"])
    pay = read_payment_years(spark, str(tmp_path), [2015])
    detail = batch.batch_detail(pay, b.accepted, [2015])
    counts = node_counts(detail)
    assert counts["BroadcastHashJoin"] >= 1
    assert counts["BroadcastNestedLoopJoin"] == 0 and counts["CartesianProduct"] == 0
    assert all(counts[n] == 0 for n in PYTHON_NODES)
    # rows are summed by hash before the first row of each identity is picked
    assert counts["HashAggregate"] >= 2


def test_unreadable_year_gives_zeros_and_the_reason(spark, tmp_path):  # Q16
    _setup(spark, tmp_path, ["x"])
    names = batch.names_frame(spark, ["Benjamin G Domb", "Domb"])
    b = batch.report_years(spark, str(tmp_path), names, [2015, 2031])
    (r,) = b.ordered_summary().collect()
    assert (r.Full_Name, r.Total_Payment, r.Payment_2015_USD, r.Total_Entries) == ("Benjamin G Domb", 0.0, 0.0, 0)
    assert "2031_rsh_payments.csv" in r.Error
    (tmp_path / "2016_rsh_payments.csv").write_text("a,b\n1,2\n")
    assert "lacks" in batch.report_years(spark, str(tmp_path), names, [2016]).summary.first().Error
    good = batch.report_years(spark, str(tmp_path), names, [2015])
    assert "Error" not in good.summary.columns and good.summary.first().Total_Payment == 200.0


def test_names_in_file_order(spark, tmp_path):
    folder = tmp_path / "names"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("".join(f"\n Name {i} {j} \n" for j in range(4)))
    got = [(r.query_id, r.raw) for r in batch.read_names(spark, str(folder)).orderBy("query_id").collect()]
    assert got == [(4 * i + j, f"Name {i} {j}") for i in range(3) for j in range(4)]


def test_unique_ids_are_summed_per_physician(spark, tmp_path):  # N15 / Q20
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1", middle="G"),
                                   covered_row("Ann", "Lee", "6", npi="1")]})
    pay = read_payment_years(spark, d, [2015])
    b = batch.BatchReport(pay, batch.names_frame(spark, ["Ann G Li", "Ann Lee"]), [2015])
    c = b.counters().first()
    assert (c.total_unique_npis, c.global_unique_npis) == (2, 1)


def test_report_plan_keeps_one_scan_and_few_exchanges(spark, tmp_path):
    from paylens.operators import report

    b = _setup(spark, tmp_path, ["Benjamin G Domb", "Alice M Smith"])
    pay = read_payment_years(spark, str(tmp_path), [2015])
    one = report.physician_report(spark, pay, "Benjamin", "G", "Domb", [2015])
    c = node_counts(one)
    # The CSV is parsed once when it is read. Scans: the stored rows, and their block
    # numbers. Exchanges: partial sums by identity, their pick, (query, identifier)
    # co-partitioning, final order -- plus two on the per-block table (one row per
    # input split: its group-by and its prefix-sum window)
    assert c["FileScans"] == 2 and c["ShuffleExchange"] <= 6
    assert "csv-rows" in " ".join(one.inputFiles()) and b.detail.count() == 3


def test_names_listed_often_are_searched_once(spark, tmp_path):
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", str(i), npi=str(1000 + i)) for i in range(1, 5)] + [covered_row("Bo", "Ng", "7", npi="2")]})
    names = batch.names_frame(spark, ["Ann Li", "ANN  li", "Bo Ng", "Ann G Li", "ann Li (MD)"])
    b = batch.BatchReport(read_payment_years(spark, d, [2015]), names, [2015])
    assert b.found.count() == 4 + 4 + 1  # Ann Li, Ann G Li (wide), Bo Ng: not once more for a listing
    assert b.detail.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 4), (2, 4), (3, 1), (4, 4), (5, 4)]
    assert [(r.query_id, r.Total_Payment, r.Total_Entries) for r in b.summary.orderBy("query_id").collect()] == [
        (1, 10.0, 4), (2, 10.0, 4), (3, 7.0, 1), (4, 10.0, 4), (5, 10.0, 4)]
    assert b.top(2).select("query_id").collect() == [(1,), (2,)]
    assert b.alerts().groupBy("name").count().orderBy("name").collect() == [("ANN li", 4), ("Ann G Li", 4), ("Ann Li", 4), ("ann Li", 4)][:3] + [("ann Li", 4)]
    assert b.counters().collect() == [(5, 17, 5, 4)]


def test_an_id_listed_with_two_names_stands_for_itself(spark):
    rows = [(1, "Ann", "Li"), (2, "Ann", "Li"), (3, "Ann", "Li"), (3, "Bo", "Ng"), (None, "Ann", "Li"), (2, "Ann", "Li"), (4, "Bo", "Ng")]
    names = spark.createDataFrame([(i, f, None, l) for i, f, l in rows], "query_id long, first_name string, middle_name string, last_name string")
    told = sorted(tuple(r) for r in batch.shared_searches(names).where("query_id IS NOT NULL").collect())
    assert told == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert [tuple(r) for r in batch.shared_searches(names).where("query_id IS NULL").collect()] == [(None, None)]
