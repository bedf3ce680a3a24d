"""Column helpers: strip, NULL markers, initials, name parsing, money, slugs, tokens."""

from pyspark.sql import functions as F

from paylens.functions import text as T


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_removes_unicode_whitespace(spark):
    assert _one(spark, T.strip("v"), "  Ann\t ") == "Ann"
    assert _one(spark, T.clean("v"), None) == ""


def test_null_markers_follow_pandas_defaults(spark):  # N8
    rows = [("NULL",), ("null",), ("NA",), ("Null",), ("",), ("n/a",), ("Smith",)]
    out = [r[0] for r in spark.createDataFrame(rows, "v string")
           .select(T.null_markers("v")).collect()]
    assert out == [None, None, None, "Null", None, None, "Smith"]


def test_middle_initial(spark):  # R1 / P5
    vals = ["G.", "G", "Grant", ". G .", ""]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(T.middle_is_initial("v")).collect()]
    assert out == [True, True, False, True, False]


def test_parse_name(spark):  # N11
    names = ["Domb", "Jane Smith", "John A Doe", "Ana Maria de la Cruz", "Jane (Lee) Smith",
             "(retired)", "  Ben   G  Domb "]
    df = spark.createDataFrame([(n,) for n in names], "raw string").select(
        T.parse_name("raw").alias("p"))
    got = [(r.p.first, r.p.middle, r.p.last) for r in df.collect()]
    assert got == [(None, None, "Domb"), ("Jane", None, "Smith"), ("John", "A", "Doe"),
                   ("Ana", "Maria de la", "Cruz"), ("Jane", None, "Smith"),
                   (None, None, None), ("Ben", "G", "Domb")]


def test_year_from_path(spark):  # N12
    paths = ["arch_1999/2023.csv", "x.csv", "12019.csv", "nested/2023_rsh_payments.csv"]
    out = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "v string")
           .select(T.year_from_path("v")).collect()]
    assert out == ["1999", "Unknown", "2019", "2023"]


def test_money_text_matches_python_rounding(spark):  # N16
    vals = [0.125, 1234567.125, None, 2.675, -1234.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [(r[0], r[1]) for r in df.select(T.money_text("v"), T.money_label("v")).collect()]
    assert [g[0] for g in got] == [f"{(v or 0.0):.2f}" for v in vals]
    assert got[4][1] == f"${-1234.5:,.2f}"
    assert got[1][1] == f"${1234567.125:,.2f}"


def test_safe_slug(spark):  # N17
    vals = ["Dr. O'Neil-Smith, Jr", "  José (x) M ", "a  b"]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(T.safe_slug("v")).collect()]
    assert out == ["Dr_ONeil-Smith_Jr", "José_x_M", "a__b"]
    assert T.year_range_label([2016, 2015]) == "2015-2016"
    assert T.year_range_label([2015]) == "2015"


def test_token_search_predicate(spark):  # N14
    df = spark.createDataFrame([("Benjamin G Domb",)], "v string")
    assert df.where(T.all_tokens_in(F.col("v"), "ben dom")).count() == 1
    assert df.where(T.all_tokens_in(F.col("v"), "domb x")).count() == 0
    assert df.where(T.all_tokens_in(F.col("v"), "   ")).count() == 0
