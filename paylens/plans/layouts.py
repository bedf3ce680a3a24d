"""Canonicalisation of a wide payment file into ``payments_canonical``.

Canonical schema (one row per payment line)::

    source_file STRING, year INT, row_pos BIGINT,
    amount DECIMAL(38,6)            -- NULL when the text is not a number
    persons ARRAY<STRUCT<slot INT, first, middle, last, npi STRING,
                         has_name BOOLEAN, has_middle BOOLEAN,
                         first_l, middle_l, last_l STRING>>   -- *_l: lower-cased
                                    -- slot 0 = covered recipient, 1-5 = PI slots
    cov_npi STRING, cov_profile STRING,
    specialty STRING                -- slots joined by '; ', else bare column, else 'Unknown'
    identifier STRING               -- covered NPI, first PI NPI, PROFILE_<id>, UNKNOWN_<row>

``has_name``/``has_middle`` record whether the *columns* exist: an absent middle
column is ignored by the row filter but an empty middle cell is not.

The same builder serves a DataFrame with real columns (CSV files, the bridge
view) and fixed slots with a bit mask per row (ZIP members with differing headers);
in the first case the layout choice is folded away at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.constants import (
    AMOUNT_TYPE, NEW_LAYOUT, OLD_LAYOUT, PAYMENT_COLUMN, PI_PREFIX, PI_SLOTS, UNKNOWN,
)
from paylens.functions.text import clean

#: Schema of canonical rows.
CANONICAL = (
    "source_file string, year int, row_pos bigint, amount decimal(38,6), "
    "persons array<struct<slot: int, first: string, middle: string, last: string, npi: string, has_name: boolean, "
    "has_middle: boolean, first_l: string, middle_l: string, last_l: string>>, "
    "cov_npi string, cov_profile string, specialty string, identifier string"
)


def _null_str():
    return F.lit(None).cast("string")


class _ColumnFields:
    """Field access over a DataFrame whose header is known on the driver."""

    def __init__(self, columns):
        self.columns = set(columns)
        self.old = {OLD_LAYOUT["first"], OLD_LAYOUT["last"]} <= self.columns

    def get(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.columns else _null_str()

    def has(self, name: str) -> Column:
        return F.lit(name in self.columns)

    def pick(self, kind: str) -> Column:
        return self.get((OLD_LAYOUT if self.old else NEW_LAYOUT)[kind])

    def pick_has(self, kind: str) -> Column:
        return self.has((OLD_LAYOUT if self.old else NEW_LAYOUT)[kind])

    def prefix_get(self, suffix: str) -> Column:
        base = (OLD_LAYOUT if self.old else NEW_LAYOUT)["specialty"]
        return self.get(base + suffix)


#: Every column that canonical rows are made of, in either layout.
NEEDED = [PAYMENT_COLUMN,
          *[lay[part] for lay in (OLD_LAYOUT, NEW_LAYOUT) for part in lay],
          *[f"{lay['specialty']}_{j}" for lay in (OLD_LAYOUT, NEW_LAYOUT) for j in PI_SLOTS],
          *[f"{PI_PREFIX}{j}_{part}" for j in PI_SLOTS for part in ("First_Name", "Middle_Name", "Last_Name", "NPI")]]


class _SlotFields:
    """Field access over rows with a fixed slot ``c<i>`` for each needed column; bit i
    of ``present`` tells whether the row's file has it (ZIP members differ)."""

    def __init__(self):
        self.old = self.has(OLD_LAYOUT["first"]) & self.has(OLD_LAYOUT["last"])

    def get(self, name: str) -> Column:
        return F.col(f"c{NEEDED.index(name)}")

    def has(self, name: str) -> Column:
        return F.col("present").bitwiseAND(F.lit(1 << NEEDED.index(name))) != 0

    def pick(self, kind: str) -> Column:
        return F.when(self.old, self.get(OLD_LAYOUT[kind])).otherwise(self.get(NEW_LAYOUT[kind]))

    def pick_has(self, kind: str) -> Column:
        return F.when(self.old, self.has(OLD_LAYOUT[kind])).otherwise(self.has(NEW_LAYOUT[kind]))

    def prefix_get(self, suffix: str) -> Column:
        return F.when(self.old, self.get(OLD_LAYOUT["specialty"] + suffix)).otherwise(
            self.get(NEW_LAYOUT["specialty"] + suffix))


def layout_of(columns) -> dict:
    """The older ``Physician_*`` layout when its first and last columns exist."""
    older = all(OLD_LAYOUT[part] in columns for part in ("first", "last"))
    return OLD_LAYOUT if older else NEW_LAYOUT


def absent_columns(columns) -> str:
    """The columns a report cannot do without that the header lacks, as text; empty if none."""
    layout = layout_of(columns)
    needed = (PAYMENT_COLUMN, layout["first"], layout["last"])
    return ", ".join(sorted(set(needed).difference(columns)))


def _person(slot: int, first, middle, last, npi, has_name, has_middle) -> Column:
    first, middle, last = clean(first), clean(middle), clean(last)
    return F.struct(
        F.lit(slot).alias("slot"),
        first.alias("first"),
        middle.alias("middle"),
        last.alias("last"),
        clean(npi).alias("npi"),
        has_name.alias("has_name"),
        has_middle.alias("has_middle"),
        # lower-cased once here, not once per (row, query) pair downstream
        F.lower(first).alias("first_l"),
        F.lower(middle).alias("middle_l"),
        F.lower(last).alias("last_l"),
    )


def _canonical_columns(f, source_file: Column, year: Column, row_pos: Column,
                       unknown_id: str) -> list[Column]:
    persons = [
        _person(0, f.pick("first"), f.pick("middle"), f.pick("last"), f.pick("npi"),
                f.pick_has("first") & f.pick_has("last"), f.pick_has("middle"))
    ]
    for j in PI_SLOTS:
        p = f"{PI_PREFIX}{j}_"
        persons.append(_person(
            j, f.get(p + "First_Name"), f.get(p + "Middle_Name"), f.get(p + "Last_Name"),
            f.get(p + "NPI"), f.has(p + "First_Name") & f.has(p + "Last_Name"),
            f.has(p + "Middle_Name")))
    persons_arr = F.array(*persons)

    cov_npi = clean(f.pick("npi"))
    cov_profile = clean(f.pick("profile"))

    # P10: non-empty specialty slots joined by '; ', else the bare column, else Unknown.
    # (concat_ws skips NULLs; plain expressions, no per-row lambda.)
    joined = F.concat_ws("; ", *[F.nullif(clean(f.prefix_get(f"_{j}")), F.lit(""))
                                 for j in PI_SLOTS])
    specialty = F.coalesce(F.nullif(joined, F.lit("")),
                           F.nullif(clean(f.prefix_get("")), F.lit("")),
                           F.lit(UNKNOWN))

    # Covered NPI -> first non-empty PI NPI in slot order -> PROFILE_ -> UNKNOWN_.
    pi_npis = [F.nullif(clean(f.get(f"{PI_PREFIX}{j}_NPI")), F.lit("")) for j in PI_SLOTS]
    if unknown_id == "row":
        unknown = F.concat(F.lit("UNKNOWN_"), row_pos.cast("string"))
    elif unknown_id == "file_row":
        unknown = F.concat(F.lit("UNKNOWN_"), source_file, F.lit("#"), row_pos.cast("string"))
    else:
        raise ValueError(f"unknown_id must be 'row' or 'file_row', not {unknown_id!r}")
    identifier = F.coalesce(
        F.nullif(cov_npi, F.lit("")),
        *pi_npis,
        F.concat(F.lit("PROFILE_"), F.nullif(cov_profile, F.lit(""))),
        unknown,
    )
    return [
        source_file.alias("source_file"),
        year.alias("year"),
        row_pos.cast("bigint").alias("row_pos"),
        f.get(PAYMENT_COLUMN).try_cast(AMOUNT_TYPE).alias("amount"),
        persons_arr.alias("persons"),
        cov_npi.alias("cov_npi"),
        cov_profile.alias("cov_profile"),
        specialty.alias("specialty"),
        identifier.alias("identifier"),
    ]


def canonicalize(wide: DataFrame, *, source_file: Column, year: Column, row_pos: Column,
                 unknown_id: str = "row", validate: bool = True, keep=()) -> DataFrame:
    """Wide payment rows (real columns) -> canonical rows, invalid amounts kept as
    NULL; ``keep`` adds columns of the input."""
    if validate and (gone := absent_columns(wide.columns)):
        raise ValueError(f"the rows lack the columns {gone}")
    fields = _ColumnFields(wide.columns)
    return wide.select(*_canonical_columns(fields, source_file, year, row_pos, unknown_id), *keep)


def canonicalize_slots(df: DataFrame, *, source_file: Column, year: Column,
                       row_pos: Column, unknown_id: str = "row") -> DataFrame:
    """Rows with a slot for each needed column -> canonical rows."""
    return df.select(*_canonical_columns(_SlotFields(), source_file, year, row_pos, unknown_id))


def valid_payments(canonical: DataFrame) -> DataFrame:
    """drop rows whose amount is not a number."""
    return canonical.where(F.col("amount").isNotNull())


def observe_invalid(canonical: DataFrame, name: str = "invalid_amounts"):
    """A13 as a side metric: ``(df, observation)``; after any action on ``df``,
    ``observation.get`` holds ``invalid_rows`` and ``rows`` counted during that
    same scan (the disclosure tool logged this count per file)."""
    from pyspark.sql import Observation

    obs = Observation(name)
    observed = canonical.observe(
        obs, F.count_if(F.col("amount").isNull()).alias("invalid_rows"),
        F.count(F.lit(1)).alias("rows"))
    return observed, obs
