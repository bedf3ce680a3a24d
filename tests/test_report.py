"""Searches and multi-year reports (reference dataset/processor tests + quirks)."""

import pytest
from pyspark.sql import functions as F

from paylens.operators import report
from paylens.sources.csv_years import read_payment_file, read_payment_years
from tests.helpers import OLD, covered_row, pi_row, write_csv, year_dir

BGD = dict(middle="G", npi="1154454635", specialty="Orthopedic Surgery")


def _search(spark, path, year, first="Benjamin", middle="G", last="Domb", **kw):
    pay = read_payment_file(spark, path, year=year, **kw)
    q = report.single_query(spark, first, middle, last)
    return report.search_summary(pay, q).orderBy(F.desc("Total_Payment_USD")).collect()


def test_search_sums_covered_rows(spark, tmp_path):  # R4
    p = write_csv(tmp_path / "2015_rsh_payments.csv",
                  [covered_row("Benjamin", "Domb", "100.0", **BGD),
                   covered_row("Benjamin", "Domb", "150.0", **BGD)])
    (row,) = _search(spark, p, 2015)
    assert (row.NPI, row.Physician_Name, row.Specialty, row.Entry_Count,
            row.Total_Payment_USD) == ("1154454635", "Benjamin G Domb", "Orthopedic Surgery",
                                       2, 250.0)


def test_search_matches_pi_when_covered_differs(spark, tmp_path):  # R5
    p = write_csv(tmp_path / "2016_rsh_payments.csv",
                  [pi_row("Study", "Subject", "Benjamin", "Domb", "400.0", pi_middle="G",
                          pi_npi="1154454635")])
    (row,) = _search(spark, p, 2016)
    assert (row.NPI, row.Physician_Name, row.Specialty, row.Total_Payment_USD) == (
        "1154454635", "Benjamin G Domb", "Principal Investigator", 400.0)


def test_profile_identifier_and_unknown_specialty(spark, tmp_path):  # R6
    p = write_csv(tmp_path / "2017_rsh_payments.csv",
                  [covered_row("Benjamin", "Domb", "50.0", middle="G", profile="12345")])
    (row,) = _search(spark, p, 2017)
    assert (row.NPI, row.Physician_Name, row.Specialty) == (
        "PROFILE_12345", "Benjamin G Domb", "Unknown")


def test_multi_year_report_and_totals(spark, tmp_path):  # R7
    d = year_dir(tmp_path, {2015: [covered_row("Benjamin", "Domb", "100.0", **BGD)],
                            2016: [covered_row("Benjamin", "Domb", "300.0", **BGD)]})
    pay = read_payment_years(spark, d, [2015, 2016])
    rep = report.physician_report(spark, pay, "Benjamin", "G", "Domb", [2015, 2016])
    (row,) = rep.collect()
    assert (row.Payment_2015_USD, row.Payment_2016_USD, row.Total_USD) == (100.0, 300.0, 400.0)
    q = report.single_query(spark, "Benjamin", "G", "Domb")
    tot = report.physician_totals(report.physician_detail(pay, q, [2015, 2016])).first()
    assert (tot.total_payment, tot.total_entries) == (400.0, 2)


def test_dual_search_does_not_double_count(spark, tmp_path):  # R8
    d = year_dir(tmp_path, {2015: [covered_row("Benjamin", "Domb", "125.0", **BGD)]})
    pay = read_payment_years(spark, d, [2015])
    (row,) = report.physician_report(spark, pay, "Benjamin", "G", "Domb", [2015]).collect()
    assert (row.Total_USD, row.Entry_Count) == (125.0, 1)


def test_dual_merge_keys_include_the_name(spark, tmp_path):  # N1 / Q11
    d = year_dir(tmp_path, {2015: [covered_row("Benjamin", "Domb", "40", npi="1"),
                                   covered_row("Benjamin", "Domb", "100", middle="G", npi="1")]})
    pay = read_payment_years(spark, d, [2015])
    ref = report.physician_report(spark, pay, "Benjamin", "G", "Domb", [2015]).collect()
    assert [(r.Total_USD, r.Entry_Count) for r in ref] == [(240.0, 3)]
    fix = report.physician_report(spark, pay, "Benjamin", "G", "Domb", [2015],
                                  merge="by_id").collect()
    assert [(r.Total_USD, r.Entry_Count, r.Physician_Name) for r in fix] == [
        (140.0, 2, "Benjamin G Domb")]


def test_row_counts_once_when_two_roles_match(spark, tmp_path):  # N2 / Q1
    row = covered_row("Benjamin", "Domb", "10", pi={1: ("Benjamin", "", "Domb", "")})
    p = write_csv(tmp_path / "2015_rsh_payments.csv", [row])
    (r,) = _search(spark, p, 2015, middle=None)
    assert (r.Entry_Count, r.Total_Payment_USD) == (1, 10.0)


def test_identifier_ignores_who_matched(spark, tmp_path):  # N3, N4 / Q2
    a = covered_row("Study", "Subject", "5", npi="9", pi={1: ("Benjamin", "", "Domb", "1")})
    b = covered_row("Study", "Subject", "6",
                    pi={1: ("Ann", "", "Li", "7"), 2: ("Benjamin", "", "Domb", "1")})
    p = write_csv(tmp_path / "2015_rsh_payments.csv", [a, b])
    rows = {r.NPI: r for r in _search(spark, p, 2015, middle=None)}
    assert set(rows) == {"9", "7"}
    assert (rows["9"].Physician_Name, rows["9"].Specialty) == ("Benjamin Domb",
                                                               "Principal Investigator")


def test_unknown_identifier_uses_row_position(spark, tmp_path):  # N5 / Q3
    rows = [covered_row("Benjamin", "Domb", "N/A"), covered_row("Ann", "Li", "1"),
            covered_row("Benjamin", "Domb", "3")]
    p = write_csv(tmp_path / "2015_rsh_payments.csv", rows)
    (r,) = _search(spark, p, 2015, middle=None)
    assert r.NPI == "UNKNOWN_2"
    (r2,) = _search(spark, p, 2015, middle=None, unknown_id="file_row")
    assert r2.NPI == "UNKNOWN_2015_rsh_payments.csv#2"


def test_absent_pi_middle_column_labels_covered_name(spark, tmp_path):  # N6 / Q6
    row = covered_row("Study", "Subject", "5")
    row.update({"Principal_Investigator_1_First_Name": "Benjamin",
                "Principal_Investigator_1_Last_Name": "Domb"})
    cols = [c for c in row if c != "Principal_Investigator_1_Middle_Name"]
    p = write_csv(tmp_path / "2015_rsh_payments.csv", [row], columns=cols)
    (r,) = _search(spark, p, 2015)
    assert r.Physician_Name == "Study Subject"


def test_invalid_amounts_are_dropped(spark, tmp_path):  # N7
    amounts = ["1,000", "$5", "N/A", "", " 7 ", "1e2"]
    rows = [covered_row("Ann", "Li", a, npi="1") for a in amounts]
    p = write_csv(tmp_path / "2015_rsh_payments.csv", rows)
    (r,) = _search(spark, p, 2015, first="Ann", middle=None, last="Li")
    assert (r.Entry_Count, r.Total_Payment_USD) == (2, 107.0)


def test_specialty_slots_and_fallback(spark, tmp_path):  # N9
    a = covered_row("Ann", "Li", "1", npi="1", specialty="A")
    a["Covered_Recipient_Specialty_3"] = "B"
    p = write_csv(tmp_path / "2015_rsh_payments.csv", [a])
    assert _search(spark, p, 2015, "Ann", None, "Li")[0].Specialty == "A; B"
    b = covered_row("Ann", "Li", "1", npi="1")
    b.pop("Covered_Recipient_Specialty_1")
    b["Covered_Recipient_Specialty"] = "Bare"
    p2 = write_csv(tmp_path / "2016_rsh_payments.csv", [b])
    assert _search(spark, p2, 2016, "Ann", None, "Li")[0].Specialty == "Bare"


def test_absent_year_gets_zero_column(spark, tmp_path):  # N10 / Q12, Q13
    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", "5", npi="1")],
                            2016: [covered_row("Bob", "Li", "5", npi="2")]})
    pay = read_payment_years(spark, d, [2015, 2016, 2015])
    rep = report.physician_report(spark, pay, "Ann", None, "Li", [2015, 2016, 2015])
    (r,) = rep.collect()
    assert rep.columns.count("Payment_2015_USD") == 1
    assert (r.Payment_2015_USD, r.Payment_2016_USD, r.Total_USD) == (5.0, 0.0, 5.0)


def test_old_and_new_layouts_combine(spark, tmp_path):  # N18
    old = covered_row("Ann", "Li", "5", npi="1", prefix=OLD)
    d = year_dir(tmp_path, {2015: [old], 2016: [covered_row("Ann", "Li", "7", npi="1")]})
    pay = read_payment_years(spark, d, [2015, 2016])
    (r,) = report.physician_report(spark, pay, "Ann", None, "Li", [2015, 2016]).collect()
    assert (r.Payment_2015_USD, r.Payment_2016_USD, r.Entry_Count) == (5.0, 7.0, 2)


def test_missing_file_and_columns(spark, tmp_path):  # S6, S9, Q15
    with pytest.raises(FileNotFoundError):
        read_payment_years(spark, str(tmp_path), [1999])
    write_csv(tmp_path / "2015_rsh_payments.csv", [{"x": "1"}])
    with pytest.raises(ValueError, match="lacks the columns"):
        read_payment_years(spark, str(tmp_path), [2015])
    write_csv(tmp_path / "2016_rsh_payments.csv", [covered_row("Ann", "Li", "1")])
    ok = read_payment_years(spark, str(tmp_path), [2015, 2016], on_error="skip_year")
    assert ok.count() == 1


def test_single_physician_total(spark, tmp_path):  # R14
    d = year_dir(tmp_path, {2015: [covered_row("Benjamin", "Domb", "220", **BGD)]})
    pay = read_payment_years(spark, d, [2015])
    q = report.single_query(spark, "Benjamin", "G", "Domb")
    tot = report.physician_totals(report.physician_detail(pay, q, [2015])).first()
    assert (tot.total_payment, tot.total_entries) == (220.0, 1)


def test_invalid_amounts_observed_during_the_scan(spark, tmp_path):  # A13
    from paylens.plans.layouts import observe_invalid, valid_payments

    d = year_dir(tmp_path, {2015: [covered_row("Ann", "Li", a, npi="1")
                                   for a in ("1", "N/A", "$5", "2")]})
    observed, obs = observe_invalid(read_payment_years(spark, d, [2015]))
    assert valid_payments(observed).count() == 2
    assert obs.get == {"invalid_rows": 2, "rows": 4}


def test_years_of_two_headers_are_parsed_once(spark, tmp_path):  # S2, U2
    from paylens.plans.checks import node_counts

    old = covered_row("Ann", "Li", "1", npi="1", prefix=OLD)
    d = year_dir(tmp_path, {2014: [old],
                            2015: [covered_row("Ann", "Li", "2", npi="1")],
                            2016: [covered_row("Ann", "Li", "4", npi="1")]})
    pay = read_payment_years(spark, d, [2014, 2015, 2016])
    # both header groups are parsed once, into one table: its rows and its block numbers
    assert node_counts(pay)["FileScans"] == 2
    rows = {r.year: (r.source_file, r.row_pos, float(r.amount)) for r in pay.collect()}
    assert rows == {2014: ("2014_rsh_payments.csv", 0, 1.0),
                    2015: ("2015_rsh_payments.csv", 0, 2.0),
                    2016: ("2016_rsh_payments.csv", 0, 4.0)}
