"""Row filter and middle-name rules (reference matching tests + quirks)."""

from pyspark.sql import functions as F

from paylens.operators import matching, report
from paylens.plans.layouts import canonicalize
from tests.helpers import covered_row


def _canon(spark, rows):
    pdf_cols = list(dict.fromkeys(k for r in rows for k in r))
    df = spark.createDataFrame([[i] + [r.get(c, "") for c in pdf_cols]
                                for i, r in enumerate(rows)],
                               "_i long, " + ", ".join(f"`{c}` string" for c in pdf_cols))
    return canonicalize(df, source_file=F.lit("2015_rsh_payments.csv"), year=F.lit(2015),
                        row_pos=F.col("_i"))


def test_middle_initial_rule(spark):  # R1
    cells = spark.createDataFrame([("G",), ("G.",), ("Grant",), ("X",)], "m string")
    out = [r[0] for r in cells.select(matching.middle_rule(F.col("m"), "G.")).collect()]
    assert out == [True, True, True, False]


def test_case_insensitive_by_default(spark):  # R2
    canon = _canon(spark, [covered_row("Benjamin", "Domb", "1", middle="G"),
                           covered_row("Alice", "Smith", "1")])
    hit = matching.row_filter(canon, "benjamin", "g", "domb", roles="covered")
    assert hit.count() == 1


def test_case_sensitive_flag(spark):  # R3
    canon = _canon(spark, [covered_row("Benjamin", "Domb", "1", middle="G"),
                           covered_row("benjamin", "Domb", "1", middle="G")])
    hit = matching.row_filter(canon, "Benjamin", "G", "Domb", roles="covered",
                              case_sensitive=True)
    assert [r.row_pos for r in hit.collect()] == [0]


def test_full_middle_name_needs_equality(spark):  # Q7
    canon = _canon(spark, [covered_row("Ben", "Domb", "1", middle="G"),
                           covered_row("Ben", "Domb", "1", middle="Grant")])
    hit = matching.row_filter(canon, "Ben", "Grant", "Domb", roles="covered")
    assert [r.row_pos for r in hit.collect()] == [1]


def test_absent_middle_column_is_not_checked(spark):  # Q6 (row filter side)
    row = covered_row("Study", "Subject", "5")
    row.update({"Principal_Investigator_1_First_Name": "Benjamin",
                "Principal_Investigator_1_Last_Name": "Domb"})
    row.pop("Principal_Investigator_1_Middle_Name")
    canon = _canon(spark, [row])
    assert matching.row_filter(canon, "Benjamin", "G", "Domb", roles="pi").count() == 1
    assert matching.any_slot_filter(canon, "Benjamin", "G", "Domb").count() == 1


def test_literal_name_equals_the_table_path(spark):
    rows = [covered_row("Ben", "Domb", "1", middle="G", npi="1"), covered_row("ben", "domb", "2", middle="Grant", npi="1"),
            covered_row("Ann", "Smith", "3", npi="2", pi={1: ("Ben", "G.", "Domb", "9"), 2: ("Ben", "", "Domb", "8")}),
            covered_row("Ben", "Domb", "4", middle="X", npi="3", pi={3: ("Ben", "G", "Domb", "7")}),
            covered_row("", "", "5", pi={1: ("Ben", "", "Domb", "")}), covered_row("Carl", "Doe", "6", npi="4"),
            covered_row("", "Domb", "7", npi="5")]
    canon = _canon(spark, rows)
    for first, middle, last in [("Ben", "G", "Domb"), ("Ben", None, "Domb"), (" ben", "Grant", "DOMB "), ("Ben", " ", "Domb"),
                                ("", "", "Domb"), (None, None, "Domb"), ("No", "B", "One")]:
        for case in (False, True):
            prepared = matching.prepare_queries(report.single_query(spark, first, middle, last), case)
            want = matching.match_rows(canon, prepared, case_sensitive=case, query_bytes=100, single=True)
            got = matching.match_literal(canon, first, middle, last, case_sensitive=case)
            assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(
                map(str, want.select(*sorted(got.columns)).collect())), (first, middle, last, case)
        for merge in ("reference", "by_id"):
            want = report.physician_detail(canon, report.single_query(spark, first, middle, last), [2015], merge=merge, query_bytes=100)
            got = report.literal_detail(canon, first, middle, last, [2015], merge=merge)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
