"""Sinks (K1-K4): report exports with money as text, and the appearance index.

A report is one CSV file under the name the disclosure tool would have used, or
numbered files where it is too large for one (:mod:`exports`). The details of a batch
are one job: a file for each name, or folders of part files, which need no step of the
driver per name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.text import money_text, safe_slug, year_range_label
from paylens.operators.appearances import index_order, serialized_index
from paylens.operators.exports import write_file, write_files
from paylens.operators.report import payment_column, unique_years


def _csv(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .partitionBy(*partition_by).csv(path))
    return path


def format_money(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P14 on the given columns (non-numeric -> '0.00')."""
    return df.select(*[money_text(F.col(c)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


# --- fixed values: column names and order of the exports ---
def detail_columns(years: Sequence[int]) -> list[str]:
    years = unique_years(years)
    return ["NPI", "Physician_Name", "Specialty", "Entry_Count",
            *[payment_column(y) for y in years], "Total_USD"]


def write_detail(detail: DataFrame, years: Sequence[int], destination: str) -> str:
    """K1: one physician's detail, ordered by Total_USD descending."""
    cols = detail_columns(years)
    ordered = detail.orderBy(F.desc("Total_USD"), "NPI").select(*cols)
    money = [c for c in cols if c.startswith("Payment_") or c == "Total_USD"]
    write_file(format_money(ordered, money), destination)
    return destination


def single_physician_file(directory: str, first: str, last: str, years: Sequence[int]) -> str:
    """K3: the export name ``research_payments_<last>_<first>_<years>.csv``."""
    return f"{directory.rstrip('/')}/research_payments_{last}_{first}_{year_range_label(unique_years(years))}.csv"


def save_physician_report(detail: DataFrame, first: str, last: str, years: Sequence[int],
                          directory: str) -> str:
    """K3: one physician's report under its conventional export name."""
    return write_detail(detail, years, single_physician_file(directory, first, last, years))


def save_batch_details(detail: DataFrame, accepted: DataFrame, years: Sequence[int],
                       directory: str) -> str:
    """K1 for a batch: every name's detail in one job, a folder for each name
    (``query_slug=<slug>/query_id=<id>``: names may share a slug) with its rows by
    Total_USD descending. Rows are dealt by ranges of (query_id, Total_USD): a name
    with many rows has several files, in order by file name."""
    rows = _batch_rows(detail, accepted, years)
    return _csv(rows, directory, partition_by=["query_slug", "query_id"])


def _batch_rows(detail: DataFrame, accepted: DataFrame, years: Sequence[int]) -> DataFrame:
    cols = detail_columns(years)
    slugs = accepted.select("query_id", safe_slug(F.col("raw")).alias("query_slug"))
    order = [F.col("query_slug"), F.col("query_id"), F.desc("Total_USD"), F.col("NPI")]
    rows = detail.join(slugs, "query_id").repartitionByRange(*order).sortWithinPartitions(*order)
    money = [c for c in cols if c.startswith("Payment_") or c == "Total_USD"]
    return format_money(rows.select("query_slug", "query_id", *cols), money)


def save_batch_files(detail: DataFrame, accepted: DataFrame, years: Sequence[int], directory: str) -> str:
    """K1 for a batch as files: ``<slug>-<query_id>.csv`` for each name that has rows."""
    rows = _batch_rows(detail, accepted, years)
    named = rows.withColumn("file", F.concat_ws("-", "query_slug", "query_id")).drop("query_slug", "query_id")
    write_files(named, "file", directory)
    return directory


def save_summary_csv(summary: DataFrame, years: Sequence[int], destination: str) -> str:
    """K2: ordered summary columns (plus ``Error`` when present), money as text,
    rows by Total_Payment descending."""
    years = unique_years(years)
    cols = ["Full_Name", "First_Name", "Middle_Name", "Last_Name",
            *[payment_column(y) for y in years], "Total_Payment", "Total_Entries"]
    if "Error" in summary.columns:
        cols.append("Error")
    ordered = summary.orderBy(F.desc("Total_Payment"), "query_id").select(*cols)
    money = [payment_column(y) for y in years] + ["Total_Payment"]
    write_file(format_money(ordered, money), destination)
    return destination


def save_index(index: DataFrame, path: str, fmt: str = "parquet") -> str:
    """K4: the grouped appearance index in year folders, each file sorted in
    index order (searchable at scale; ``fmt="json"`` for interchange). No
    repartition by year: every task writes its own slice of each year, so a
    dominant year is still spread over all tasks."""
    rec = serialized_index(index).drop("identifier_label")
    out = rec.sortWithinPartitions("year", *index_order())
    writer = out.write.mode("overwrite").partitionBy("year")
    (writer.parquet if fmt == "parquet" else writer.json)(path)
    return path
