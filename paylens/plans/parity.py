"""Named queries over the driver's test tables (the ``queries()`` registry).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle. Inputs come from the stand-in payment file
derived from ``orders`` (see :mod:`paylens.sources.bridge`); parameters below are
the fixed search requests of the parity suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.constants import NEW_LAYOUT, OLD_LAYOUT
from paylens.functions import text as T
from paylens.functions.text import money_label, money_text, safe_slug, year_range_label
from paylens.operators import appearances as A
from paylens.operators import batch, counts, matching, name_search, partials, report, sinks
from paylens.plans.layouts import valid_payments
from paylens.session import shared_dir, staged
from paylens.sources import csv_years, manifest, zip_source, zip_store
from paylens.sources.bridge import LISTED_SQL, bridge_payments, bridge_wide, register_tables

# --- fixed values: parity-suite requests ---
PERSON = ("Benjamin", "G", "Domb")
ABSENT = ("Nobody", "Q", "Here")
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
SEARCH_YEAR = 1996
TOP_LISTED = 7
ABSENT_YEAR = 2050
QUOTED_CELL = 'Phase "I",\nII'
BATCH_NAMES = ["Benjamin G Domb", "Ann Smith", "carla M Doe", "David (MD) Okafor",
               "Hugo Grant O'Neil", "Nobody Here", "Domb"]


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge_payments(spark, sf_dir)


def _person(spark: SparkSession) -> DataFrame:
    return report.single_query(spark, *PERSON)


def physician_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: multi-year report for one person (reference merge)."""
    return report.physician_report(spark, _payments(spark, sf_dir), *PERSON, YEARS)


def absent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the report of a name that nobody bears has its columns and no rows."""
    return report.physician_report(spark, _payments(spark, sf_dir), *ABSENT, YEARS)


def dual_search_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 with the by-identifier merge of the two searches."""
    return report.physician_report(spark, _payments(spark, sf_dir), *PERSON, YEARS,
                                   merge="by_id")


def physician_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: grand totals of the one-person report."""
    detail = report.literal_detail(_payments(spark, sf_dir), *PERSON, YEARS)
    return report.physician_totals(detail, _person(spark)).drop("query_id")


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search of one year's file, query as given."""
    pay = _payments(spark, sf_dir).where(F.col("year") == SEARCH_YEAR)
    return report.search_summary(pay, _person(spark), query_bytes=report.SINGLE_BYTES, single=True).drop("query_id", "year")


SUMMARY_FILTER = "dom"


def _batch(spark: SparkSession, sf_dir: str) -> batch.BatchReport:
    names = batch.names_frame(spark, BATCH_NAMES)
    return batch.BatchReport(_payments(spark, sf_dir), names, YEARS)


def batch_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows of every accepted name, one pass over the payments."""
    return _batch(spark, sf_dir).detail


def incremental_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same detail from stored search results: first some names and years,
    then the other names, then the last year, each scanning what is not held."""
    pay = _payments(spark, sf_dir)
    names = staged(batch.accepted_names(batch.parse_names(batch.names_frame(spark, BATCH_NAMES))), "listed")
    store = partials.PartialStore(spark, shared_dir(spark, "partials"))
    store.update(pay, names.where("query_id <= 3"), YEARS[:-1])
    store.update(pay, names, YEARS[:-1])
    store.update(pay, names, YEARS)
    return report.as_doubles(store.detail(names, YEARS))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per accepted name, zeros when nothing matched."""
    return _batch(spark, sf_dir).ordered_summary()


def _listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A names list as people keep them, a line per supplier: full names, single
    words, names that are only a remark, and the same person listed again."""
    register_tables(spark, sf_dir, ("supplier",))
    return spark.sql(LISTED_SQL)


def rejected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names that do not parse into first + last."""
    return batch.rejected_names(batch.parse_names(_listed_names(spark, sf_dir)))


def _listed_batch(spark: SparkSession, sf_dir: str) -> batch.BatchReport:
    return batch.BatchReport(_payments(spark, sf_dir), _listed_names(spark, sf_dir), YEARS)


def top_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven largest of the listed names; persons listed twice tie."""
    return _listed_batch(spark, sf_dir).top(TOP_LISTED)


def multi_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physicians with more than one identifier and their rows."""
    return _batch(spark, sf_dir).alerts()


def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed names, summed and global distinct identifiers."""
    return _batch(spark, sf_dir).counters()


def year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-year totals over all physicians plus TOTAL."""
    return _batch(spark, sf_dir).totals_by_year()


def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest physicians by total payment."""
    return _batch(spark, sf_dir).top(10)


def last_query_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a display name that is listed several times, the last listing."""
    return batch.last_query_wins(batch.accepted_names(batch.parse_names(_listed_names(spark, sf_dir))))


def summary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summary rows whose name contains a text, ignoring case."""
    b = _batch(spark, sf_dir)
    return batch.summary_filter(b.summary, SUMMARY_FILTER)


def alert_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows flagged when the physician is in the alert set."""
    b = _batch(spark, sf_dir)
    return b.flagged_summary()


def _data_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-name strings derived from every stand-in row: covered person with the
    first specialty in parentheses, as a names file would list them."""
    w = bridge_wide(spark, sf_dir)
    raw = F.concat(
        F.concat_ws(" ", "Covered_Recipient_First_Name", "Covered_Recipient_Middle_Name",
                    "Covered_Recipient_Last_Name"),
        F.coalesce(F.concat(F.lit(" ("), F.col("Covered_Recipient_Specialty_1"), F.lit(")")),
                   F.lit("")))
    return w.select(F.col("row_id").alias("query_id"), raw.alias("raw"))


def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name parsing over a full-name string per stand-in row."""
    return batch.parse_names(_data_names(spark, sf_dir))


def slug_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export file name per full-name string."""
    names = _data_names(spark, sf_dir)
    label = year_range_label(YEARS)
    return names.select(
        "query_id", "raw", safe_slug("raw").alias("slug"),
        F.concat(F.lit("research_payments_"), safe_slug("raw"),
                 F.lit(f"_{label}.csv")).alias("file_name"))


def batch_data_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 over every distinct covered-recipient name found in the payments."""
    w = bridge_wide(spark, sf_dir)
    raw = F.concat_ws(" ", "Covered_Recipient_First_Name", "Covered_Recipient_Middle_Name",
                      "Covered_Recipient_Last_Name")
    names = (w.select(raw.alias("raw")).distinct()
             .select(F.monotonically_increasing_id().alias("query_id"), "raw"))
    b = batch.BatchReport(_payments(spark, sf_dir), names, YEARS)
    return b.summary.drop("query_id")


# --- fixed values: further parity requests ---
MIDDLE_INITIAL_QUERY = "G."
MIDDLE_FULL_QUERY = "Grant"
ROLE_QUERY = ("Benjamin", None, "Domb")
CASE_QUERY = ("DAVID", None, "Okafor")
TOKEN_QUERY = "ben domb"
REPORT_QUERY = "benjamin g"
SHORT_QUERY, TOP_HITS = "a Do", 25
ZIP_CHUNK_ROWS = 2048


def _flat(canon: DataFrame) -> DataFrame:
    cov = F.get(F.col("persons"), 0)
    return canon.select(
        "source_file", "year", "row_pos", F.col("amount").cast("double").alias("amount"),
        cov["first"].alias("cov_first"), cov["middle"].alias("cov_middle"),
        cov["last"].alias("cov_last"), "cov_npi", "cov_profile", "specialty", "identifier")


def canonical_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows with a valid amount."""
    return _flat(valid_payments(_payments(spark, sf_dir)))


def invalid_amount_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per year whose amount is not a number."""
    return (_payments(spark, sf_dir).groupBy("year")
            .agg(F.count_if(F.col("amount").isNull()).cast("bigint").alias("invalid_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("total_rows")))


def clean_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and normalised name cells."""
    w = bridge_wide(spark, sf_dir)
    return w.select(
        "row_id",
        T.clean("Covered_Recipient_First_Name").alias("first_clean"),
        T.normalize("Covered_Recipient_First_Name", False).alias("first_norm"),
        T.normalize("Covered_Recipient_First_Name", True).alias("first_norm_cs"),
        T.normalize_value("Principal_Investigator_1_First_Name", False).alias("pi1_first_value"))


def middle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle-name rule for an initial and a full middle name."""
    cov = F.get(F.col("persons"), 0)
    return _payments(spark, sf_dir).select(
        "row_pos", cov["middle"].alias("middle"),
        T.middle_is_initial(cov["middle"]).alias("middle_is_initial"),
        matching.middle_rule(cov["middle"], MIDDLE_INITIAL_QUERY).alias("match_initial"),
        matching.middle_rule(cov["middle"], MIDDLE_FULL_QUERY).alias("match_full"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names of the covered person and PI slot 1."""
    p = F.col("persons")
    cov, pi1 = F.get(p, 0), F.get(p, 1)
    return _payments(spark, sf_dir).select(
        "row_pos", T.join_name(cov["first"], cov["middle"], cov["last"]).alias("covered_name"),
        T.join_name(pi1["first"], pi1["middle"], pi1["last"]).alias("pi1_name"))


def resolve_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of every row."""
    return _payments(spark, sf_dir).select("row_pos", "identifier")


def specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: specialty text of every row."""
    return _payments(spark, sf_dir).select("row_pos", "specialty")


def _matched(spark, sf_dir, queries, dual=True, case_sensitive=False, size=None, single=False):
    scoped = valid_payments(_payments(spark, sf_dir)).where(F.col("year").isin(YEARS))
    prepared = matching.prepare_queries(queries, case_sensitive, dual=dual)
    m = matching.match_rows(scoped, prepared, case_sensitive=case_sensitive, query_bytes=size, single=single)
    return m.select("query_id", "mode", "row_pos", "year", "identifier",
                    F.col("amount").cast("double").alias("amount"), "name", "specialty")


def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows of the dual search with their identity."""
    return _matched(spark, sf_dir, _person(spark), size=report.SINGLE_BYTES, single=True)


def batch_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names x payments join, one row per (name, mode, payment row)."""
    b = batch.accepted_names(batch.parse_names(batch.names_frame(spark, BATCH_NAMES)))
    return _matched(spark, sf_dir, b.select("query_id", "first_name", "middle_name",
                                            "last_name"))


def _role_search(spark, sf_dir, roles):
    rows = matching.row_filter(valid_payments(_payments(spark, sf_dir)), *ROLE_QUERY,
                               roles=roles)
    return rows.groupBy("year").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                    F.sum("amount").cast("double").alias("amount"))


def search_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows naming the person as covered recipient, per year."""
    return _role_search(spark, sf_dir, "covered")


def search_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows naming the person in any PI slot, per year."""
    return _role_search(spark, sf_dir, "pi")


def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows naming the person in any role, counted once, per year."""
    return _role_search(spark, sf_dir, "any")


def any_slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the any-role filter as an OR of six slot predicates."""
    rows = matching.any_slot_filter(valid_payments(_payments(spark, sf_dir)), *ROLE_QUERY)
    return rows.select("row_pos", "year", F.col("amount").cast("double").alias("amount"))


def search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a case-sensitive search, per year."""
    q = report.single_query(spark, *CASE_QUERY)
    return report.search_summary(valid_payments(_payments(spark, sf_dir)), q,
                                 case_sensitive=True, query_bytes=report.SINGLE_BYTES, single=True).drop("query_id")


def dual_search_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-year merge of the narrow and wide searches."""
    scoped = valid_payments(_payments(spark, sf_dir)).where(F.col("year").isin(YEARS))
    prepared = matching.prepare_queries(_person(spark))
    merged = report.merge_modes(report.searched_years(scoped, prepared, query_bytes=report.SINGLE_BYTES, single=True))
    return merged.select("year", F.col("identifier").alias("NPI"),
                         F.col("name").alias("Physician_Name"),
                         F.col("specialty").alias("Specialty"),
                         F.col("entries").cast("bigint").alias("Entry_Count"),
                         F.col("total").cast("double").alias("Total_Payment_USD"))


def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based position of each row within its year's file, found by the split
    CSV reader, beside the row's content."""
    rows = csv_years.read_payment_years(spark, _staged_csv(spark, sf_dir), YEARS, multi_line=False)
    cov = F.get(F.col("persons"), 0)
    return rows.select("year", F.col("row_pos").alias("ordinal"), cov["first"].alias("cov_first"), cov["last"].alias("cov_last"),
                       "cov_npi", F.col("amount").cast("double").alias("amount"))


def year_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year captured from a path (over page URLs)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.year_from_path(F.col("url")).alias("year"))


def currency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money as '0.00' text and '$1,234.50' labels."""
    return _payments(spark, sf_dir).select(
        "row_pos", money_text(F.col("amount")).alias("amount_text"),
        money_label(F.col("amount")).alias("amount_label"))


def summary_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as CSV with money as text, and read back."""
    b = _batch(spark, sf_dir)
    path = sinks.save_summary_csv(b.summary, YEARS, f"{shared_dir(spark, 'export')}/summary.csv")
    return spark.read.option("header", True).csv(path).withColumn("Total_Entries", F.col("Total_Entries").cast("bigint")).fillna("")


def detail_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: every name's detail written as CSV, a folder for each name, and read back."""
    b = _batch(spark, sf_dir)
    path = sinks.save_batch_details(b.exact_detail, b.accepted, YEARS, shared_dir(spark, "details"))
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return back.withColumns({"Entry_Count": F.col("Entry_Count").cast("bigint"), "query_id": F.col("query_id").cast("bigint")})


def physician_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: one person's report under its conventional name, read back."""
    detail = report.literal_detail(_payments(spark, sf_dir), *PERSON, YEARS)
    path = sinks.save_physician_report(detail, PERSON[0], PERSON[2], YEARS, shared_dir(spark, "person"))
    back = spark.read.option("header", True).csv(path)
    return back.withColumn("Entry_Count", F.col("Entry_Count").cast("bigint")).withColumn("file_name", F.col("_metadata.file_name"))


def detail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: every name's detail as a file of its own, read back."""
    b = _batch(spark, sf_dir)
    path = sinks.save_batch_files(b.exact_detail, b.accepted, YEARS, shared_dir(spark, "detail-files"))
    back = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return back.withColumn("Entry_Count", F.col("Entry_Count").cast("bigint")).withColumn("file_name", F.col("_metadata.file_name"))


def names_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed names written to a text file, a line each with stray blanks and
    blank lines between, and read back in order."""
    path = shared_dir(spark, "names")
    order = _listed_names(spark, sf_dir).orderBy("query_id")
    lines = order.select(F.explode(F.array(F.concat(F.lit("  "), "raw", F.lit("\t")), F.lit(" "))).alias("value"))
    lines.coalesce(1).write.text(path)  # one file: a person keeps one
    return batch.read_names(spark, path)


def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over yearly files of which one is absent: every name has zeros
    and the reason."""
    folder = _staged_csv(spark, sf_dir)
    b = batch.report_years(spark, folder, _listed_names(spark, sf_dir), [*YEARS, ABSENT_YEAR])
    return b.summary.withColumn("Error", F.regexp_extract("Error", r"[^/]*$", 0))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.appearance_index(_payments(spark, sf_dir))


def _typed(index: DataFrame) -> DataFrame:
    return index.withColumn("total_payment", F.col("total_payment").cast("double")) \
                .withColumn("instance_count", F.col("instance_count").cast("bigint"))


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per named person of each valid row."""
    return A.appearances(_payments(spark, sf_dir)).withColumn(
        "payment_amount", F.col("payment_amount").cast("double"))


def appearance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped appearance index."""
    return _typed(_index(spark, sf_dir)).orderBy(*A.index_order())


def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token search over the index."""
    return _typed(A.token_search(_index(spark, sf_dir), TOKEN_QUERY))


def _stored_index(spark: SparkSession, sf_dir: str) -> name_search.NameIndex:
    path = name_search.write_index(_index(spark, sf_dir), shared_dir(spark, "name-index"))
    return name_search.NameIndex(spark, path)


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over the stored inverted index."""
    return _typed(_stored_index(spark, sf_dir).search(TOKEN_QUERY))


def indexed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest hits of a search with short tokens, tier by tier."""
    return _typed(_stored_index(spark, sf_dir).search(SHORT_QUERY, TOP_HITS))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index size, distinct names and known years."""
    return A.index_stats(_index(spark, sf_dir))


def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, and distinct identifiers, from the bitmaps of each
    file: the files arrive in three steps, one of them twice."""
    index = staged(_index(spark, sf_dir).withColumn("total_payment", F.col("total_payment").cast("decimal(38,6)")), "stats-index")
    store = counts.DistinctCounts(spark, shared_dir(spark, "counts"))
    for some in ("year < '1994'", "year >= '1994' AND year < '1997'", "year >= '1997'", "year = '1995'"):
        store.add(index.where(some))
    return store.stats()


def missing_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grouped appearances without an identifier."""
    return _typed(A.missing_identifier(_index(spark, sf_dir)))


def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as one JSON object per grouped appearance."""
    return A.index_json(_index(spark, sf_dir))


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable records matching a name, with identifier labels."""
    hits = A.token_search(_index(spark, sf_dir), REPORT_QUERY)
    return A.serialized_index(hits).withColumn(
        "total_payment", F.col("total_payment").cast("double"))


def _staged_csv(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_dir(spark, "csv-years")
    csv_years.write_year_files(bridge_wide(spark, sf_dir), folder)
    return folder


def csv_roundtrip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in rows written as yearly CSV files by Spark,
    read back per year, canonicalised and unioned."""
    folder = _staged_csv(spark, sf_dir)
    return _flat(valid_payments(csv_years.read_payment_years(spark, folder, YEARS)))


def csv_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly CSV files read in splits, whatever number of them a file has."""
    folder = _staged_csv(spark, sf_dir)
    return _flat(valid_payments(csv_years.read_payment_years(spark, folder, YEARS, multi_line=False)))


def csv_quoted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly CSV files in which every third row has a cell with a quote, a
    comma and a line feed; such files are read in splits as well."""
    folder = shared_dir(spark, "csv-quoted")
    cell = F.when(F.col("row_id") % 3 == 0, F.lit(QUOTED_CELL)).otherwise(F.col("Covered_Recipient_Specialty_2"))
    csv_years.write_year_files(bridge_wide(spark, sf_dir).withColumn("Covered_Recipient_Specialty_2", cell), folder)
    return _flat(valid_payments(csv_years.read_payment_years(spark, folder, YEARS)))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of yearly files in both layouts, brought up to date when the
    last three years land; ``version`` tells in which refresh a header was read."""
    wide, folder = bridge_wide(spark, sf_dir), shared_dir(spark, "csv-listed")
    older = {NEW_LAYOUT[k]: OLD_LAYOUT[k] for k in ("first", "middle", "last", "npi", "profile")}
    store = f"{folder}/inventory"
    for landed in (YEARS[:-3], YEARS[-3:]):
        for odd, names in ((1, older), (0, {})):
            mine = wide.where(F.col("year").isin(landed) & (F.col("year") % 2 == odd)).withColumnsRenamed(names)
            csv_years.write_year_files(mine, folder)
        csv_years.read_payment_years(spark, folder, YEARS[:YEARS.index(landed[-1]) + 1], manifest=store)
    unit = F.regexp_extract("file", csv_years.unit_pattern(), 1)
    return manifest.read_manifest(spark, store).groupBy(unit.alias("source_file"), "layout", "lacks", "version").agg(
        F.max("columns").cast("bigint").alias("n_columns"), F.sum("records").alias("records"))


def mixed_layout_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd years in the older layout, even ones in the newer, and part files
    of every year with their columns in another order."""
    wide, folder = bridge_wide(spark, sf_dir), shared_dir(spark, "csv-mixed")
    older = {NEW_LAYOUT[k]: OLD_LAYOUT[k] for k in ("first", "middle", "last", "npi", "profile")}
    older |= {f"{NEW_LAYOUT['specialty']}_{j}": f"{OLD_LAYOUT['specialty']}_{j}" for j in (1, 2)}
    for kind, rows in (("old", wide.where("year % 2 = 1").withColumnsRenamed(older)), ("new", wide.where("year % 2 = 0"))):
        back = [c for c in reversed(rows.columns) if c not in ("year", "row_id")]
        csv_years.write_year_files(rows.where("row_id % 3 != 0"), f"{folder}/{kind}-a")
        csv_years.write_year_files(rows.where("row_id % 3 = 0").select("row_id", "year", *back), f"{folder}/{kind}-b")
    found = []
    for kind in ("old-a", "old-b", "new-a", "new-b"):
        for y in YEARS:
            path = csv_years.year_file(f"{folder}/{kind}", y)
            if (y % 2 == 1) == kind.startswith("old"):
                found += csv_years.data_files(spark, path)
    unit = F.regexp_extract("_file", csv_years.unit_pattern(), 1)
    rows = csv_years.read_files(spark, found, unit=unit, source_file=unit,
                                year=F.regexp_extract("_file", csv_years.unit_pattern(), 2).cast("int"))
    known = F.when(~F.col("identifier").startswith("UNKNOWN_"), F.col("identifier")).otherwise("UNKNOWN")
    return _flat(valid_payments(rows)).drop("row_pos").withColumn("identifier", known)


def unioned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-year search results, each year's total in its own column, the
    others empty: one scan and one search of all years, then a column per year."""
    pay = valid_payments(csv_years.read_payment_years(spark, _staged_csv(spark, sf_dir), YEARS))
    merged = report.merge_modes(report.searched_years(
        pay, matching.prepare_queries(_person(spark)), query_bytes=report.SINGLE_BYTES, single=True))
    return merged.select(
        "year", F.col("identifier").alias("NPI"), F.col("name").alias("Physician_Name"),
        F.col("specialty").alias("Specialty"), F.col("entries").cast("bigint").alias("Entry_Count"),
        *[F.when(F.col("year") == y, F.col("total").cast("double")).alias(report.payment_column(y)) for y in YEARS])


def _staged_zip(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_dir(spark, "zip-archive")
    w = bridge_wide(spark, sf_dir)
    member = F.format_string("%d/part-%05d.csv", F.col("year"),
                             F.floor(F.col("row_id") / ZIP_CHUNK_ROWS).cast("int"))
    zip_source.write_zip_members(w.withColumn("_member", member).drop("year"), folder,
                                 "_member", "row_id")
    return folder


def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every CSV member of ZIP archives, canonicalised."""
    canon = zip_source.read_zip_payments(spark, _staged_zip(spark, sf_dir))
    return _flat(valid_payments(canon))


def zip_year_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of the archives; the filter reaches the source, which opens that
    year's members only."""
    canon = zip_source.read_zip_payments(spark, _staged_zip(spark, sf_dir))
    return _flat(valid_payments(canon.where(F.col("year") == SEARCH_YEAR)))


def zip_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives' members decoded into the store, and their rows read from it
    after a second refresh that finds nothing to decode."""
    folder = _staged_zip(spark, sf_dir)
    zip_store.refresh(spark, folder, f"{folder}-store")
    again = zip_store.refresh(spark, folder, f"{folder}-store")
    return _flat(valid_payments(zip_store.read_store(spark, f"{folder}-store"))).where(F.lit(again) == 0)


def zip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 over a ZIP source: the appearance index of the archive members."""
    canon = zip_source.read_zip_payments(spark, _staged_zip(spark, sf_dir))
    return _typed(A.appearance_index(canon))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming ingest: the stand-in rows land as yearly CSV files (Spark part
    files); a file-source stream with an available-now trigger canonicalises
    them into the Parquet store and appends their index groups; the index is
    read back re-aggregated."""
    from paylens.streaming import read_index, start_ingest

    base = shared_dir(spark, "stream")
    landing = f"{base}/landing"
    csv_years.write_year_files(bridge_wide(spark, sf_dir), landing)
    q = start_ingest(spark, landing, f"{base}/store", f"{base}/index", f"{base}/ckpt",
                     available_now=True)
    q.awaitTermination()
    return _typed(read_index(spark, f"{base}/index"))


def republished_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming ingest of yearly files that land with every row twice, then as they
    should be; the superseded publications are deleted as the second ones arrive."""
    from paylens.streaming import read_index, start_ingest

    base = shared_dir(spark, "stream-again")
    wide = bridge_wide(spark, sf_dir)
    for name, rows in (("june", wide.unionByName(wide)), ("july", wide)):
        csv_years.write_year_files(rows, f"{base}/landing/{name}")
        start_ingest(spark, f"{base}/landing", f"{base}/store", f"{base}/index", f"{base}/ckpt",
                     available_now=True, compact_every=1).awaitTermination()
    return _typed(read_index(spark, f"{base}/index"))


QUERIES = {
    "physician_report": physician_report,
    "dual_search_by_id": dual_search_by_id,
    "absent_report": absent_report,
    "physician_totals": physician_totals,
    "search_summary": search_summary,
    "batch_detail": batch_detail,
    "incremental_detail": incremental_detail,
    "batch_summary": batch_summary,
    "rejected_names": rejected_names,
    "multi_identifier": multi_identifier,
    "identifier_counts": identifier_counts,
    "year_totals": year_totals,
    "top10": top10,
    "top_listed": top_listed,
    "last_query_wins": last_query_wins,
    "summary_filter": summary_filter,
    "alert_flags": alert_flags,
    "parse_names": parse_names,
    "slug_label": slug_label,
    "batch_data_names": batch_data_names,
    "canonical_payments": canonical_payments,
    "invalid_amount_count": invalid_amount_count,
    "clean_normalize": clean_normalize,
    "middle_match": middle_match,
    "display_names": display_names,
    "resolve_identifier": resolve_identifier,
    "specialty": specialty,
    "identity_rows": identity_rows,
    "batch_match_rows": batch_match_rows,
    "search_covered": search_covered,
    "search_pi": search_pi,
    "search_any": search_any,
    "any_slot_rows": any_slot_rows,
    "search_case_sensitive": search_case_sensitive,
    "dual_search_year": dual_search_year,
    "row_ordinal": row_ordinal,
    "year_from_path": year_from_path,
    "currency_text": currency_text,
    "summary_export": summary_export,
    "detail_export": detail_export,
    "detail_files": detail_files,
    "physician_export": physician_export,
    "names_file": names_file,
    "batch_errors": batch_errors,
    "appearances": appearances,
    "appearance_index": appearance_index,
    "token_search": token_search,
    "indexed_search": indexed_search,
    "indexed_top": indexed_top,
    "index_stats": index_stats,
    "merged_stats": merged_stats,
    "missing_identifier": missing_identifier,
    "index_json": index_json,
    "search_report": search_report,
    "csv_roundtrip_scan": csv_roundtrip_scan,
    "unioned_years": unioned_years,
    "csv_split_scan": csv_split_scan,
    "csv_quoted_scan": csv_quoted_scan,
    "file_manifest": file_manifest,
    "mixed_layout_years": mixed_layout_years,
    "zip_scan": zip_scan,
    "zip_year_scan": zip_year_scan,
    "zip_store_scan": zip_store_scan,
    "zip_index": zip_index,
    "stream_index": stream_index,
    "republished_index": republished_index,
}
