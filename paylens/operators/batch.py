"""Batch reports over a names table (D4: J4, J5, A7-A10, O4, O5, W4, F11, F12).

The disclosure tool loops over names and re-reads every yearly file per name.
Here a names table of any size is parsed with column expressions, joined once
with the payment rows (broadcast when its size is proven small, a shuffle join
on the two name keys otherwise) and every summary is an aggregate keyed by
``query_id``, which also orders the names as they appeared in the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.functions.text import join_name, parse_name, strip
from paylens.operators import matching, report
from paylens.operators.report import payment_column, unique_years
from paylens.plans.layouts import CANONICAL
from paylens.session import staged
from paylens.sources.csv_years import check_columns, check_exists, numbered, read_payment_years, year_file, year_headers


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, stripped, blank lines dropped. ``query_id`` is the
    name's place in the file (of a folder: in its files by name)."""
    lines = spark.read.text(path).select(
        strip(F.col("value")).alias("raw"), F.lit(path).alias("_unit"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    kept = lines.where(F.col("raw") != "").withColumn("_mid", F.monotonically_increasing_id())
    return numbered(staged(kept, "names")).select(F.col("_pos").alias("query_id"), "raw")


def names_frame(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """An in-memory names list with 1-based ``query_id`` in list order."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, start=1)],
                                 "query_id long, raw string")


def parse_names(names: DataFrame) -> DataFrame:
    """P12 over (query_id, raw) -> (query_id, raw, first_name, middle_name, last_name)."""
    p = parse_name(F.col("raw"))
    return names.select("query_id", "raw", p["first"].alias("first_name"),
                        p["middle"].alias("middle_name"), p["last"].alias("last_name"))


def accepted_names(parsed: DataFrame) -> DataFrame:
    """names with a first and a last name."""
    return parsed.where(F.col("first_name").isNotNull() & F.col("last_name").isNotNull())


def rejected_names(parsed: DataFrame) -> DataFrame:
    """The complement -- one-word and empty names get no summary row."""
    return (parsed.where(F.col("first_name").isNull() | F.col("last_name").isNull())
            .select("query_id", "raw"))


def display_name() -> "F.Column":
    return join_name(F.col("first_name"), F.coalesce(F.col("middle_name"), F.lit("")),
                     F.col("last_name"))


def batch_detail(payments: DataFrame, accepted: DataFrame, years: Sequence[int], *,
                 case_sensitive: bool = False, merge: str = "reference",
                 names_bytes: int | None = None) -> DataFrame:
    """D3 for every accepted name in one pass: detail rows keyed by query_id, money
    exact. ``names_bytes`` (measured when not given) decides whether the names are
    broadcast."""
    queries = accepted.select("query_id", "first_name", "middle_name", "last_name")
    size = matching.table_bytes(queries) if names_bytes is None else names_bytes
    return report.physician_detail(payments, queries, years, case_sensitive=case_sensitive,
                                   merge=merge, query_bytes=size)


def shared_searches(accepted: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(query_id, search_id): listings whose names normalise alike ask the same search,
    known by the smallest ``query_id`` of them. An id that is null, or listed with names
    that differ, stands for itself."""
    queries = accepted.select("query_id", "first_name", "middle_name", "last_name")
    key = ["q_kf", "q_kl", "q_km"]
    asked = matching.prepare_queries(queries, case_sensitive, dual=False).select("query_id", F.struct(*key).alias("_n"))
    listed = asked.groupBy("query_id").agg(F.min("_n").alias("_n"), F.max("_n").alias("_m"))
    alone = F.col("query_id").isNull() | ~F.col("_n").eqNullSafe(F.col("_m"))
    plain = listed.where(~alone).select("query_id", "_n.*")
    first = plain.groupBy(*key).agg(F.min("query_id").alias("search_id"))
    met = plain.join(first, [plain[k].eqNullSafe(first[k]) for k in key], "inner").select("query_id", "search_id")
    return met.unionByName(listed.where(alone).select("query_id", F.col("query_id").alias("search_id")))


def _by_search(names: DataFrame, searches: DataFrame | None) -> DataFrame:
    """Listed names with the ``search_id`` that ``detail`` is keyed by."""
    return names.withColumn("search_id", F.col("query_id")) if searches is None else names.join(searches, "query_id")


def batch_summary(accepted: DataFrame, detail: DataFrame, years: Sequence[int],
                  errors: dict[int, str] | None = None, searches: DataFrame | None = None) -> DataFrame:
    """J5 + A10: one row per accepted name, zeros when nothing matched. With ``searches``
    (see :func:`shared_searches`) ``detail`` holds each search once, by its ``search_id``.

    Full_Name, First_Name, Middle_Name, Last_Name, Payment_<y>_USD..., Total_Payment,
    Total_Entries (plus query_id). Where ``errors`` tells why years could not be read,
    the tool could report no name: all amounts are zero and ``Error`` holds the first
    reason in request order.
    """
    years = unique_years(years)
    exact = [F.sum(F.col(payment_column(y)).cast("decimal(38,6)")).alias(payment_column(y))
             for y in years]
    per_query = (detail.groupBy("query_id")
                 .agg(*exact,
                      F.sum(F.col("Total_USD").cast("decimal(38,6)")).alias("Total_Payment"),
                      F.sum("Entry_Count").alias("Total_Entries")))
    if searches is not None:
        per_query = searches.join(per_query.withColumnRenamed("query_id", "search_id"), "search_id").drop("search_id")
    joined = accepted.join(per_query, "query_id", "left")
    reason = [] if not errors else [F.lit(next(errors[y] for y in years if y in errors)).alias("Error")]
    return (joined.select(
        "query_id",
        F.col("raw").alias("Full_Name"),
        F.col("first_name").alias("First_Name"),
        F.coalesce(F.col("middle_name"), F.lit("")).alias("Middle_Name"),
        F.col("last_name").alias("Last_Name"),
        *[F.coalesce(F.col(payment_column(y)), F.lit(0)).cast("double").alias(payment_column(y))
          for y in years],
        F.coalesce(F.col("Total_Payment"), F.lit(0)).cast("double").alias("Total_Payment"),
        F.coalesce(F.col("Total_Entries"), F.lit(0)).cast("bigint").alias("Total_Entries"),
        *reason,
    ))


def order_summary(summary: DataFrame) -> DataFrame:
    """By Total_Payment descending, ties in names-file order."""
    return summary.orderBy(F.desc("Total_Payment"), "query_id")


def last_query_wins(accepted: DataFrame) -> DataFrame:
    """For a display name listed more than once the last listing wins.

    (display_name, query_id) -- one row per distinct display name.
    """
    return (accepted.select(display_name().alias("display_name"), "query_id")
            .groupBy("display_name").agg(F.max("query_id").alias("query_id")))


def multi_identifier(accepted: DataFrame, detail: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """A8 + P24: physicians whose report holds more than one identifier, with
    their detail rows: (name, NPI, Specialty, Entry_Count, Total_USD).

    ``detail`` has one row per (query, identifier): counts per query, made with a
    map-side step, pick the queries, so no name's identifiers gather in one task."""
    several = detail.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ids")).where(F.col("n_ids") > 1)
    winners = _by_search(last_query_wins(accepted), searches).join(several.select(F.col("query_id").alias("search_id")), "search_id")
    return (detail.withColumnRenamed("query_id", "search_id").join(winners, "search_id")
            .select(F.col("display_name").alias("name"), "NPI", "Specialty",
                    "Entry_Count", F.col("Total_USD").cast("double").alias("Total_USD")))


def summary_with_alerts(accepted: DataFrame, detail: DataFrame, summary: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """Each summary row flagged when its display name is in the alert set
    (a physician whose winning listing holds more than one identifier)."""
    flagged = multi_identifier(accepted, detail, searches).select(F.col("name").alias("_n")).distinct()
    name = join_name(F.col("First_Name"), F.col("Middle_Name"), F.col("Last_Name"))
    return (summary.join(flagged, name == F.col("_n"), "left")
            .withColumn("Has_Multiple_NPIs", F.col("_n").isNotNull()).drop("_n"))


def identifier_counts(accepted: DataFrame, detail: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """A9 + A12: dashboard counters in one row.

    ``total_unique_npis`` is the sum of per-physician distinct identifiers (as
    the disclosure tool reports it); ``global_unique_npis`` is the true distinct
    count across physicians.
    """
    winners = _by_search(last_query_wins(accepted).groupBy("query_id").agg(F.count(F.lit(1)).alias("_won")), searches)
    found = detail.withColumnRenamed("query_id", "search_id")
    # detail already holds one row per (search, identifier): a row is a distinct id
    ids = found.groupBy("search_id").agg(F.count(F.lit(1)).alias("_ids"))
    n = F.col("_ids") * F.col("_won")
    totals = winners.join(ids, "search_id").agg(F.struct(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("t"), F.count_if(n > 1).cast("bigint").alias("m"))).scalar()
    distinct = found.join(winners, "search_id", "left_semi").agg(F.count_distinct("NPI").cast("bigint")).scalar()
    return accepted.agg(F.count(F.lit(1)).cast("bigint").alias("physicians_processed")).select(
        "physicians_processed",
        totals["t"].alias("total_unique_npis"),
        distinct.alias("global_unique_npis"),
        totals["m"].alias("physicians_with_multiple_npis"),
    )


def year_totals(summary: DataFrame, years: Sequence[int]) -> DataFrame:
    """Payments per year over all physicians plus the overall total.

    (label, total_payment): one row per requested year and a final 'TOTAL'.
    """
    years = unique_years(years)
    sums = summary.agg(*[F.sum(F.col(payment_column(y)).cast("decimal(38,6)")).alias(str(y))
                         for y in years],
                       F.sum(F.col("Total_Payment").cast("decimal(38,6)")).alias("TOTAL"))
    labels = [str(y) for y in years] + ["TOTAL"]
    stacked = sums.select(F.explode(F.array(*[
        F.struct(F.lit(lab).alias("label"), F.col(f"`{lab}`").alias("v")) for lab in labels
    ])).alias("s"))
    return stacked.select("s.label",
                          F.coalesce(F.col("s.v"), F.lit(0)).cast("double").alias("total_payment"))


def top_physicians(summary: DataFrame, years: Sequence[int], k: int = 10) -> DataFrame:
    """The k largest Total_Payment rows (ties by names-file order)."""
    years = unique_years(years)
    name = join_name(F.col("First_Name"), F.col("Middle_Name"), F.col("Last_Name"))
    return (summary.orderBy(F.desc("Total_Payment"), "query_id").limit(k)
            .select("query_id", name.alias("Physician_Name"),
                    *[payment_column(y) for y in years], "Total_Payment", "Total_Entries"))


def summary_filter(summary: DataFrame, text: str) -> DataFrame:
    """summary rows whose display name contains the text, ignoring case."""
    name = join_name(F.col("First_Name"), F.col("Middle_Name"), F.col("Last_Name"))
    return summary.where(F.contains(F.upper(name), F.upper(F.lit(text))))


class BatchReport:
    """Every output of one batch run.

    The constructor parses and stores the names, matches them with the payments once
    and stores what is found -- one row per (search, identifier), however often a name is
    listed -- in the shared folder. Every output is a lazy DataFrame over those tables;
    none reads the payments again. Summaries, alerts and counters take each search once;
    only ``detail`` has its rows for every listing. ``years`` that cannot be read are given as ``errors`` (year -> reason).
    """

    def __init__(self, payments: DataFrame, names: DataFrame, years: Sequence[int], *,
                 case_sensitive: bool = False, merge: str = "reference", errors: dict[int, str] | None = None):
        self.years = unique_years(years)
        self.parsed = staged(parse_names(names), "batch-names")
        self.accepted = accepted_names(self.parsed)
        self.rejected = rejected_names(self.parsed)
        self.errors = {y: errors[y] for y in self.years if y in errors} if errors else {}
        rows = payments.where(F.lit(False)) if self.errors else payments
        self.searches = staged(shared_searches(self.accepted, case_sensitive), "batch-searches")
        own = self.searches.where(F.col("query_id").eqNullSafe(F.col("search_id"))).select(F.col("search_id").alias("_s"))
        asked = self.accepted.join(own, F.col("query_id").eqNullSafe(F.col("_s")), "left_semi")
        self.names_bytes = matching.table_bytes(asked)
        self.found = staged(batch_detail(rows, asked, self.years, case_sensitive=case_sensitive,
                                         merge=merge, names_bytes=self.names_bytes), "batch-detail")
        by_search = self.found.withColumnRenamed("query_id", "_s")
        listed = by_search.join(self.searches, F.col("_s").eqNullSafe(F.col("search_id")), "inner")
        self.exact_detail = listed.select(*self.found.columns)
        self.detail = report.as_doubles(self.exact_detail)
        self.summary = batch_summary(self.accepted, self.found, self.years, self.errors, self.searches)

    def ordered_summary(self) -> DataFrame:
        return order_summary(self.summary)

    def alerts(self) -> DataFrame:
        return multi_identifier(self.accepted, self.found, self.searches)

    def flagged_summary(self) -> DataFrame:
        return summary_with_alerts(self.accepted, self.found, self.summary, self.searches)

    def counters(self) -> DataFrame:
        return identifier_counts(self.accepted, self.found, self.searches)

    def totals_by_year(self) -> DataFrame:
        return year_totals(self.summary, self.years)

    def top(self, k: int = 10) -> DataFrame:
        return top_physicians(self.summary, self.years, k)


def report_years(spark: SparkSession, directory: str, names: DataFrame, years: Sequence[int], **options) -> BatchReport:
    """A batch over a folder of yearly files. The tool reads the years for each name
    and gives a name whose years cannot be read zeros and the reason; a year that is
    absent or lacks columns does so for every name, and is found before any row is
    read."""
    errors: dict[int, str] = {}
    for y in unique_years(years):
        try:
            check_exists(spark, year_file(directory, y))
        except FileNotFoundError as e:
            errors[y] = str(e)
    for y, known in year_headers(spark, directory, [y for y in unique_years(years) if y not in errors]).items():
        try:
            check_columns(year_file(directory, y), known)
        except ValueError as e:
            errors[y] = str(e)
    good = [y for y in unique_years(years) if y not in errors]
    if good and not errors:
        payments = read_payment_years(spark, directory, good)
    else:  # no name can be reported
        payments = spark.createDataFrame([], CANONICAL)
    return BatchReport(payments, names, years, errors=errors, **options)
