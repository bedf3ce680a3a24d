"""Appearance index and token search (D5, D6: P8, P9, P13, P17, P18, P23, A6,
A11, A12, O6, O7, F8, F10, F14).

Every named person of a payment row -- the covered recipient and each PI slot
with a non-empty first and last name -- is one *appearance* carrying the full
row amount (so summing over roles exceeds the money paid, as in the disclosure
tool). Appearances are grouped by ten descriptive keys; the grouped index is
the searchable table. One ``explode`` replaces six passes over the rows, and
the grouping is a hash aggregate with map-side partials, so a person present
on a third of all rows still costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.constants import (
    ID_TYPE_MISSING, ID_TYPE_NPI, ID_TYPE_PROFILE, MISSING_ID_LABEL, ROLE_COVERED, ROLE_PI,
    SPECIALTY_PI,
)
from paylens.functions.text import all_tokens_in, join_name, year_from_path
from paylens.plans.layouts import valid_payments

# --- fixed values: grouping keys of the searchable index, in output order ---
INDEX_KEYS = ["display_name", "first_name", "middle_name", "last_name", "role", "year",
              "identifier", "identifier_type", "specialty", "source_file"]


def appearances(canonical: DataFrame, keep=()) -> DataFrame:
    """P23 + P8 + P9 + F8: one row per named person of each valid payment row.

    (display_name, display_name_normalized, first_name, middle_name, last_name, role,
     year, source_file, payment_amount, identifier, identifier_type, specialty)
    """
    # people filtered inside the array (see matching.match_specs for why)
    named = F.filter(F.col("persons"), lambda p: (p["first"] != "") & (p["last"] != ""))
    rows = valid_payments(canonical).select(
        "source_file", "amount", "cov_npi", "cov_profile", "specialty", *keep,
        F.explode(named).alias("p"))
    covered = F.col("p.slot") == 0
    cov_id = (F.when(F.col("cov_npi") != "", F.struct(F.col("cov_npi").alias("v"),
                                                      F.lit(ID_TYPE_NPI).alias("t")))
              .when(F.col("cov_profile") != "", F.struct(F.col("cov_profile").alias("v"),
                                                         F.lit(ID_TYPE_PROFILE).alias("t")))
              .otherwise(F.struct(F.lit("").alias("v"), F.lit(ID_TYPE_MISSING).alias("t"))))
    pi_id = F.struct(F.col("p.npi").alias("v"),
                     F.when(F.col("p.npi") != "", F.lit(ID_TYPE_NPI))
                     .otherwise(F.lit(ID_TYPE_MISSING)).alias("t"))
    ident = F.when(covered, cov_id).otherwise(pi_id)
    display = join_name(F.col("p.first"), F.col("p.middle"), F.col("p.last"))
    role = F.when(covered, F.lit(ROLE_COVERED)).otherwise(
        F.concat(F.lit(ROLE_PI + " "), F.col("p.slot").cast("string")))
    return rows.select(
        display.alias("display_name"),
        F.lower(display).alias("display_name_normalized"),
        F.col("p.first").alias("first_name"),
        F.col("p.middle").alias("middle_name"),
        F.col("p.last").alias("last_name"),
        role.alias("role"),
        year_from_path(F.col("source_file")).alias("year"),
        "source_file",
        F.col("amount").alias("payment_amount"),
        ident["v"].alias("identifier"),
        ident["t"].alias("identifier_type"),
        F.when(covered, F.col("specialty")).otherwise(F.lit(SPECIALTY_PI)).alias("specialty"),
        *keep,
    )


def index_order() -> list[Column]:
    """Display name, year, role ascending, payment descending (then the
    remaining keys so that the order is total)."""
    return [F.col("display_name"), F.col("year"), F.col("role"), F.desc("total_payment"),
            F.col("identifier"), F.col("identifier_type"), F.col("specialty"),
            F.col("source_file")]


def appearance_index(canonical: DataFrame, keep=()) -> DataFrame:
    """Appearances grouped by ten keys (and ``keep``) with total_payment and instance_count.

    The total stays an exact decimal here; callers cast for output.
    """
    return (appearances(canonical, keep).groupBy(*INDEX_KEYS, *keep)
            .agg(F.sum("payment_amount").alias("total_payment"),
                 F.count(F.lit(1)).alias("instance_count")))


def serialized_index(index: DataFrame) -> DataFrame:
    """P17 + P18: the record shape of the searchable index (payment rounded to
    cents, lower-cased name for search, identifier label for display)."""
    label = F.when(F.col("identifier") == "", F.lit(MISSING_ID_LABEL)).otherwise(
        F.concat(F.col("identifier_type"), F.lit(": "), F.col("identifier")))
    return index.select(
        "display_name", F.lower("display_name").alias("display_name_normalized"),
        "first_name", "middle_name", "last_name", "role", "year", "identifier",
        "identifier_type", "specialty", "source_file",
        F.col("total_payment").cast("decimal(38,2)").alias("total_payment"),
        F.col("instance_count").cast("bigint").alias("instance_count"),
        label.alias("identifier_label"))


def index_json(index: DataFrame) -> DataFrame:
    """K4 payload: one JSON object per grouped appearance."""
    rec = serialized_index(index).drop("identifier_label")
    return rec.select(F.to_json(F.struct(*rec.columns)).alias("record"))


def token_search(index: DataFrame, text: str) -> DataFrame:
    """F10 + O7: grouped appearances whose name holds every token of ``text``,
    largest payment first (ties in index order). Blank text -> no rows."""
    hits = index.where(all_tokens_in(F.col("display_name"), text))
    order = index_order()
    return hits.orderBy(F.desc("total_payment"), *order[:3], *order[4:])


def index_stats(index: DataFrame) -> DataFrame:
    """A11 + A12: index size, distinct names, and the known years, sorted."""
    known = F.when(F.col("year") != "Unknown", F.col("year"))
    years = F.array_sort(F.collect_set(known))
    return index.agg(
        F.count(F.lit(1)).cast("bigint").alias("indexed_matches"),
        F.count_distinct("display_name").cast("bigint").alias("physicians"),
        F.when(F.size(years) > 0, F.array_join(years, ", ")).otherwise(F.lit("Unknown"))
        .alias("years"))


def missing_identifier(index: DataFrame) -> DataFrame:
    """grouped appearances without a unique identifier."""
    return index.where(F.col("identifier") == "")
