"""Sinks: exports carry money as two-decimal text; the index round-trips."""

import glob

from paylens.operators import appearances as A
from paylens.operators import batch, report, sinks
from paylens.session import shared_dir
from paylens.sources.csv_years import read_payment_years
from tests.helpers import covered_row, year_dir

BGD = dict(middle="G", npi="1154454635", specialty="Orthopedic Surgery")


def _read_csv(spark, path):
    return spark.read.option("header", True).csv(path).collect()


def test_detail_and_summary_exports(spark, tmp_path):  # K1, K2, K3, R11
    d = year_dir(tmp_path, {2015: [covered_row("Benjamin", "Domb", "200", **BGD),
                                   covered_row("Alice", "Smith", "0.125", npi="2")]})
    pay = read_payment_years(spark, d, [2015])
    out = shared_dir(spark, "sinks")
    q = report.single_query(spark, "Benjamin", "G", "Domb")
    detail = report.physician_detail(pay, q, [2015])
    path = sinks.save_physician_report(detail, "Benjamin", "Domb", [2015], out)
    assert path.endswith("research_payments_Domb_Benjamin_2015.csv")
    (row,) = _read_csv(spark, path)
    assert (row.NPI, row.Physician_Name, row.Payment_2015_USD, row.Total_USD) == (
        "1154454635", "Benjamin G Domb", "200.00", "200.00")

    names = batch.names_frame(spark, ["Benjamin G Domb", "Alice Smith"])
    b = batch.BatchReport(pay, names, [2015])
    sp = sinks.save_summary_csv(b.summary, [2015], f"{out}/summary.csv")
    got = {r.Full_Name: r.Total_Payment for r in _read_csv(spark, sp)}
    assert got == {"Benjamin G Domb": "200.00", "Alice Smith": "0.12"}
    bp = sinks.save_batch_details(b.exact_detail, b.accepted, [2015], f"{out}/details")
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{bp}/query_slug=*")) == [
        "Alice_Smith", "Benjamin_G_Domb"]
    flags = {r.Full_Name: r.Has_Multiple_NPIs for r in b.flagged_summary().collect()}
    assert flags == {"Benjamin G Domb": False, "Alice Smith": False}


def test_index_parquet_and_json(spark, tmp_path):  # K4, P17
    d = year_dir(tmp_path, {2021: [covered_row("Ann", "Li", "10.005", npi="3"),
                                   covered_row("Ann", "Li", "1", npi="3")]})
    idx = A.appearance_index(read_payment_years(spark, d, [2021]))
    out = shared_dir(spark, "index")
    sinks.save_index(idx, f"{out}/pq")
    (r,) = spark.read.parquet(f"{out}/pq").collect()
    assert (r.display_name, str(r.total_payment), r.instance_count, r.year) == (
        "Ann Li", "11.01", 2, 2021)
    sinks.save_index(idx, f"{out}/js", fmt="json")
    (j,) = spark.read.json(f"{out}/js").collect()
    assert j.identifier == "3" and j.role == "Covered Recipient"


def test_batch_details_are_sorted_and_told_apart(spark, tmp_path):  # K1
    rows = [covered_row("Ann", "Li", str(i % 50), npi=str(1000 + i)) for i in range(200)]
    pay = read_payment_years(spark, year_dir(tmp_path, {2015: rows}), [2015])
    b = batch.BatchReport(pay, batch.names_frame(spark, ["Ann Li", "Ann. Li"]), [2015])
    path = sinks.save_batch_details(b.exact_detail, b.accepted, [2015], shared_dir(spark, "details"))
    assert [p.rsplit("/", 1)[1] for p in sorted(glob.glob(f"{path}/query_slug=Ann_Li/*"))] == ["query_id=1"]
    values = []
    for part in sorted(glob.glob(f"{path}/query_slug=Ann_Li/query_id=1/*.csv")):
        values += [float(r.Total_USD) for r in spark.read.option("header", True).csv(part).collect()]
    assert len(values) == 200 and values == sorted(values, reverse=True)


def test_money_text_of_odd_values(spark):  # P14
    from pyspark.sql import functions as F

    from paylens.functions.text import money_text
    df = spark.createDataFrame([("abc",), ("",), (None,), ("12.345",)], "v string")
    assert [r[0] for r in df.select(money_text(F.col("v"))).collect()] == ["0.00", "0.00", "0.00", "12.35"] or \
        [r[0] for r in df.select(money_text(F.col("v"))).collect()] == ["0.00", "0.00", "0.00", "12.34"]


def test_totals_of_a_person_without_matches(spark, tmp_path):  # A5
    pay = read_payment_years(spark, year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "1")]}), [2015])
    q = report.single_query(spark, "No", None, "Body")
    r = report.physician_totals(report.physician_detail(pay, q, [2015]), q).first()
    assert (r.total_payment, r.total_entries) == (0.0, 0)
