"""Searches and multi-year physician reports.

Stages after the match, all keyed by ``query_id`` so one plan serves one name or
a million:

1. ``year_search`` (D1): per (query, mode, year, identifier) the payment sum,
   the entry count and the identity of the first matching row in file order
   (``min_by`` over ``(source_file, row_pos)``). Hash aggregation with a
   map-side partial step, so a hot identifier costs one row per task.
2. ``merge_modes`` (D2): the narrow (with middle name) and wide searches of a
   year are merged. ``merge="reference"`` groups by (identifier, name,
   specialty) and takes the maximum of each measure, exactly as the disclosure
   tool does -- including its double counting when the two searches name the
   same identifier differently. ``merge="by_id"`` takes measures from the wide
   search and the name from the narrow one.
3. ``combine_years`` (D3): one row per (query, identifier) with a payment
   column per requested year (conditional sums, no pivot discovery job), the
   first name/specialty in request-year order, then by payment descending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.operators.matching import (
    SPEC, attach_queries, match_literal, match_specs, prepare_queries, search_specs, spec_size,
)
from paylens.plans.layouts import valid_payments


def unique_years(years: Sequence[int]) -> list[int]:
    """Q13: a year listed twice is reported once (request order kept)."""
    seen: list[int] = []
    for y in years:
        if int(y) not in seen:
            seen.append(int(y))
    return seen


def payment_column(year: int) -> str:
    return f"Payment_{year}_USD"


def year_search(matched: DataFrame, keys=("query_id", "mode"), meet=()) -> DataFrame:
    """D1 per year: (keys..., year, identifier, total, entries, name, specialty).

    Rows are summed by identity first -- fixed-width buffers, so a hash aggregate
    with a map-side step -- and the identity of the first row in file order is
    picked from those few groups (W1). ``meet``: keys that all later steps group by
    as well; the groups are exchanged once, by these."""
    keys = list(keys)
    by_identity = matched.groupBy(*keys, "year", "identifier", "source_file", "name", "specialty").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("entries"), F.min("row_pos").alias("first"))
    if meet:
        by_identity = by_identity.repartition(*meet)
    return (by_identity.groupBy(*keys, "year", "identifier")
            .agg(F.sum("total").alias("total"), F.sum("entries").alias("entries"),
                 F.min_by(F.struct("name", "specialty"), F.struct("source_file", "first")).alias("ident"))
            .select(*keys, "year", "identifier", "total", "entries",
                    "ident.name", "ident.specialty"))


def searched_years(payments: DataFrame, prepared: DataFrame, *, case_sensitive: bool = False,
                   query_bytes: int | None = None, single: bool = False) -> DataFrame:
    """Match + D1 aggregated per distinct search spec, then fanned out to the
    queries: (query_id, mode, year, identifier, total, entries, name, specialty).

    Aggregating before the fan-out keeps the large shuffle proportional to the
    distinct searches, not to the number of names asking them."""
    bound = spec_size(query_bytes)
    specs = search_specs(prepared, single_query=single)
    matched = match_specs(payments, specs, case_sensitive=case_sensitive, spec_bytes=bound)
    return attach_queries(year_search(matched, ["spec_hash", *SPEC]), prepared, bound)


def search_summary(payments: DataFrame, queries: DataFrame, *,
                   case_sensitive: bool = False, query_bytes: int | None = None,
                   single: bool = False) -> DataFrame:
    """One search of one payment set per query, exactly as given.

    (query_id, year, NPI, Physician_Name, Specialty, Entry_Count, Total_Payment_USD).
    """
    prepared = prepare_queries(queries, case_sensitive, dual=False)
    per_year = searched_years(valid_payments(payments), prepared,
                              case_sensitive=case_sensitive, query_bytes=query_bytes, single=single)
    return per_year.select(
        "query_id", "year", F.col("identifier").alias("NPI"),
        F.col("name").alias("Physician_Name"), F.col("specialty").alias("Specialty"),
        F.col("entries").alias("Entry_Count"),
        F.col("total").cast("double").alias("Total_Payment_USD"))


def merge_modes(per_year: DataFrame, merge: str = "reference") -> DataFrame:
    """(query_id, year, identifier, name, specialty, entries, total)."""
    if merge == "reference":
        return (per_year.groupBy("query_id", "year", "identifier", "name", "specialty")
                .agg(F.max("entries").alias("entries"), F.max("total").alias("total")))
    if merge == "by_id":
        wide = F.col("mode") == "wide"
        rank = F.when(F.col("mode") == "narrow", 0).otherwise(1)
        return (per_year.groupBy("query_id", "year", "identifier")
                .agg(F.max(F.when(wide, F.col("entries"))).alias("entries"),
                     F.max(F.when(wide, F.col("total"))).alias("total"),
                     F.min_by(F.struct("name", "specialty"), rank).alias("ident"))
                .select("query_id", "year", "identifier", "ident.name", "ident.specialty",
                        "entries", "total"))
    raise ValueError(f"merge must be 'reference' or 'by_id', not {merge!r}")


def combine_years(merged: DataFrame, years: Sequence[int]) -> DataFrame:
    """D3: one row per (query_id, identifier) with a payment column per year."""
    years = unique_years(years)
    pos = F.array_position(F.array(*[F.lit(y) for y in years]), F.col("year"))
    first_key = F.struct(pos.alias("p"), F.negate(F.col("total")).alias("t"),
                         F.col("name"), F.col("specialty"))
    year_sums = [F.sum(F.when(F.col("year") == y, F.col("total"))).alias(payment_column(y))
                 for y in years]
    agg = (merged.groupBy("query_id", "identifier")
           .agg(F.min_by(F.struct("name", "specialty"), first_key).alias("ident"),
                F.sum("entries").alias("Entry_Count"), *year_sums))
    pay = [F.coalesce(F.col(payment_column(y)), F.lit(0)) for y in years]
    total = pay[0]
    for c in pay[1:]:
        total = total + c
    return agg.select(
        "query_id",
        F.col("identifier").alias("NPI"),
        F.col("ident.name").alias("Physician_Name"),
        F.col("ident.specialty").alias("Specialty"),
        F.col("Entry_Count").cast("bigint").alias("Entry_Count"),
        *[p.alias(payment_column(y)) for p, y in zip(pay, years)],
        total.alias("Total_USD"),
    )


def as_doubles(report: DataFrame) -> DataFrame:
    """The money columns, exact decimals until here, as doubles for output."""
    money = [c for c, t in report.dtypes if t.startswith("decimal")]
    return report.withColumns({c: F.col(c).cast("double") for c in money}) if money else report


def physician_detail(payments: DataFrame, queries: DataFrame, years: Sequence[int], *,
                     case_sensitive: bool = False, merge: str = "reference",
                     query_bytes: int | None = None, single: bool = False) -> DataFrame:
    """Matched rows -> D1 -> D2 -> D3 for every query of ``queries``.

    ``payments`` is canonical (invalid amounts still present); rows outside the
    requested years are filtered before the match. Money stays decimal (see
    :func:`as_doubles`).
    """
    years = unique_years(years)
    scoped = valid_payments(payments).where(F.col("year").isin(years))
    prepared = prepare_queries(queries, case_sensitive)
    per_year = searched_years(scoped, prepared, case_sensitive=case_sensitive,
                              query_bytes=query_bytes, single=single)
    # At most 2 x years rows per (query, identifier) from here on: one small
    # exchange on those two keys serves both the merge and the combine.
    per_year = per_year.repartition("query_id", "identifier")
    return combine_years(merge_modes(per_year, merge), years)


def literal_detail(payments: DataFrame, first: str, middle: str | None, last: str,
                   years: Sequence[int], *, case_sensitive: bool = False,
                   merge: str = "reference") -> DataFrame:
    """:func:`physician_detail` of one literal name (query_id 0), without a query table:
    one exchange of the groups by identity, one by identifier for all the rest."""
    years = unique_years(years)
    scoped = valid_payments(payments).where(F.col("year").isin(years))
    hits = match_literal(scoped, first, middle, last, case_sensitive=case_sensitive)
    per_year = year_search(hits, ["mode"], meet=["identifier"]).withColumn("query_id", F.lit(0).cast("long"))
    return combine_years(merge_modes(per_year, merge), years)


QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("first_name", T.StringType(), True),
    T.StructField("middle_name", T.StringType(), True),
    T.StructField("last_name", T.StringType(), True),
])


#: What one literal name may take.
SINGLE_BYTES = 64 << 10


def single_query(spark: SparkSession, first: str, middle: str | None, last: str) -> DataFrame:
    """One name as a one-row query table (same path as a batch)."""
    return spark.createDataFrame([(0, first, middle, last)], QUERY_SCHEMA)


def physician_report(spark: SparkSession, payments: DataFrame, first: str,
                     middle: str | None, last: str, years: Sequence[int], *,
                     case_sensitive: bool = False, merge: str = "reference") -> DataFrame:
    """D3 for one person: NPI, Physician_Name, Specialty, Entry_Count,
    Payment_<y>_USD..., Total_USD, ordered by Total_USD descending (ties by NPI)."""
    detail = literal_detail(payments, first, middle, last, years, case_sensitive=case_sensitive, merge=merge)
    return as_doubles(detail).drop("query_id").orderBy(F.desc("Total_USD"), "NPI")


def physician_totals(detail: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """A5: per query the total payment and number of entries; with ``queries``, zeros
    for each that matched nothing."""
    totals = detail.groupBy("query_id").agg(
        F.sum(F.col("Total_USD").cast("decimal(38,6)")).alias("total_payment"),
        F.sum("Entry_Count").alias("total_entries"))
    if queries is not None:
        totals = queries.select("query_id").join(totals, "query_id", "left")
    return totals.select("query_id", F.coalesce("total_payment", F.lit(0)).cast("double").alias("total_payment"),
                         F.coalesce("total_entries", F.lit(0)).cast("bigint").alias("total_entries"))
