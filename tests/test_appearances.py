"""Appearance index over ZIP archives (reference archive tests + quirks)."""

import zipfile

from paylens.operators import appearances as A
from paylens.sources.zip_source import read_zip_payments
from tests.helpers import covered_row, pi_row, write_csv


def _zip(tmp_path, members):
    path = tmp_path / "archive.zip"
    with zipfile.ZipFile(path, "w") as zf:
        for name, rows in members.items():
            if rows is None:
                zf.writestr(name, "")
                continue
            csv_path = write_csv(tmp_path / "m.csv", rows)
            zf.write(csv_path, name)
    return str(path)


def test_index_groups_roles_and_identifier_types(spark, tmp_path):  # R9
    z = _zip(tmp_path, {"2021_rsh_payments.csv": [
        covered_row("Benjamin", "Domb", "100", middle="G", npi="1154454635",
                    specialty="Orthopedic Surgery"),
        pi_row("Study", "Subject", "Benjamin", "Domb", "80", pi_middle="G",
               pi_npi="1154454635"),
        covered_row("Benjamin", "Domb", "40", profile="999"),
    ], "notes.txt": None, "folder/": None})
    idx = A.appearance_index(read_zip_payments(spark, z)).collect()
    kinds = {(r.role, r.identifier_type) for r in idx}
    assert {("Covered Recipient", "NPI"), ("Covered Recipient", "Profile ID"),
            ("Principal Investigator 1", "NPI"), ("Covered Recipient", "Missing")} <= kinds
    assert len(idx) == 4
    assert all(r.year == "2021" for r in idx)


def test_year_from_nested_member(spark, tmp_path):  # R10
    z = _zip(tmp_path, {"nested/2023_rsh_payments.csv": [covered_row("Alice", "Smith", "50")]})
    (r,) = A.appearance_index(read_zip_payments(spark, z)).collect()
    assert (r.year, r.display_name, float(r.total_payment)) == ("2023", "Alice Smith", 50.0)


def test_every_named_person_carries_the_full_amount(spark, tmp_path):  # N13 / Q22
    row = covered_row("Ann", "Li", "80", pi={1: ("Bo", "", "Ng", "1"), 2: ("Cy", "", "Ot", "")})
    z = _zip(tmp_path, {"2020.csv": [row]})
    apps = A.appearances(read_zip_payments(spark, z)).collect()
    assert sorted(float(a.payment_amount) for a in apps) == [80.0, 80.0, 80.0]


def test_token_search_and_stats(spark, tmp_path):  # R13, N14, F14
    z = _zip(tmp_path, {"a/2021.csv": [covered_row("Benjamin", "Domb", "200", middle="G"),
                                       covered_row("Ann", "Li", "5", npi="3")],
                        "b/undated.csv": [covered_row("Ben", "Domb", "7")]})
    idx = A.appearance_index(read_zip_payments(spark, z))
    hits = A.token_search(idx, "ben domb").collect()
    assert [h.display_name for h in hits] == ["Benjamin G Domb", "Ben Domb"]
    assert A.token_search(idx, "  ").count() == 0
    st = A.index_stats(idx).first()
    assert (st.indexed_matches, st.years) == (3, "2021")
    assert A.missing_identifier(idx).count() == 2
    labels = {r.display_name: r.identifier_label
              for r in A.serialized_index(idx).collect()}
    assert labels["Ann Li"] == "NPI: 3" and labels["Ben Domb"] == "Missing unique identifier"


def test_members_without_payment_column_are_skipped(spark, tmp_path):  # F9
    z = _zip(tmp_path, {"2019.csv": [{"Covered_Recipient_First_Name": "A"}],
                        "2020.CSV": [covered_row("Ann", "Li", "1")]})
    rows = read_zip_payments(spark, z).collect()
    assert [r.source_file for r in rows] == ["2020.CSV"]


def test_ragged_member_falls_back_to_row_reader(spark, tmp_path):
    header = ("Covered_Recipient_First_Name,Covered_Recipient_Last_Name,"
              "Covered_Recipient_NPI,Total_Amount_of_Payment_USDollars\n")
    body = header + "Ann,Li,1,5\n\nBo,Ng\nCy,Ot,3,7\n"   # blank line and a short row
    path = tmp_path / "ragged.zip"
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr("2020.csv", body)
    rows = read_zip_payments(spark, str(path)).orderBy("row_pos").collect()
    assert [r.row_pos for r in rows] == [0, 1, 2]
    assert rows[1].amount is None and rows[2].identifier == "3"


def test_blank_lines_quotes_and_old_layout_members(spark, tmp_path):
    new = "Covered_Recipient_First_Name,Covered_Recipient_Last_Name,Extra,Total_Amount_of_Payment_USDollars"
    old = "Total_Amount_of_Payment_USDollars,Physician_Last_Name,Physician_First_Name,Physician_NPI"
    path = tmp_path / "odd.zip"
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr("2020.csv", f'\n  \n{new}\n"Ann\nMay",Li,x,5\nBo,"Ng, Jr",,7\n')
        zf.writestr("2014.csv", f"﻿{old}\n9,Oh,Cy,123\n")
        zf.writestr("2013.csv", "\n\n")
    rows = {(r.source_file, r.row_pos): r for r in read_zip_payments(spark, str(path)).collect()}
    assert set(rows) == {("2020.csv", 0), ("2020.csv", 1), ("2014.csv", 0)}
    names = {k: (r.persons[0].first, r.persons[0].last, float(r.amount), r.identifier) for k, r in rows.items()}
    assert names["2020.csv", 0] == ("Ann\nMay", "Li", 5.0, "UNKNOWN_0")
    assert names["2020.csv", 1] == ("Bo", "Ng, Jr", 7.0, "UNKNOWN_1")
    assert names["2014.csv", 0] == ("Cy", "Oh", 9.0, "123")
    assert not rows["2020.csv", 0].persons[0].has_middle and not rows["2020.csv", 0].persons[1].has_name


def test_writer_streams_members(spark, tmp_path):
    from pyspark.sql import functions as F

    from paylens.sources.zip_source import write_zip_members
    wide = spark.range(5000).select(
        F.concat(F.lit("200"), F.col("id") % 7, F.lit(".csv")).alias("m"), F.col("id").alias("o"),
        F.concat(F.lit('a "q", \n'), F.col("id")).alias("Covered_Recipient_First_Name"), F.lit("Li").alias("Covered_Recipient_Last_Name"),
        F.col("id").cast("string").alias("Total_Amount_of_Payment_USDollars"))
    assert write_zip_members(wide, str(tmp_path / "zips"), "m", "o") == 7
    rows = read_zip_payments(spark, str(tmp_path / "zips")).collect()
    assert {(r.source_file, r.row_pos, r.persons[0].first) for r in rows} == {
        (f"200{i % 7}.csv", i // 7, f'a "q", \n{i}') for i in range(5000)}
