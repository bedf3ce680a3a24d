"""String helpers as Spark Column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so that
it stays inside generated code. Python's ``str.strip`` removes all Unicode
whitespace while Spark's ``trim`` removes only spaces, so ``strip`` trims the
explicit whitespace set with ``btrim`` (no regex engine per cell).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens.constants import NULL_MARKERS, UNKNOWN, YEAR_IN_PATH

# --- fixed values: the characters Python's str.strip() removes (str.isspace) ---
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# --- fixed values: what a name's remark is, and what a file name may not hold ---
REMARK = r"\([^)]*\)"
NOT_IN_SLUG = r"(?U)[^\w\s-]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def clean(col) -> Column:
    """Missing -> '' else stripped text."""
    return F.coalesce(strip(col), F.lit(""))


def normalize(col, case_sensitive: bool) -> Column:
    """Clean, then lower-case unless the search is case sensitive."""
    cleaned = clean(col)
    return cleaned if case_sensitive else F.lower(cleaned)


def normalize_value(col, case_sensitive: bool) -> Column:
    """Like ``normalize`` but NULL stays NULL."""
    stripped = strip(col)
    return stripped if case_sensitive else F.lower(stripped)


def null_markers(col) -> Column:
    """Cells a pandas CSV read would treat as missing become NULL (exact match)."""
    c = _c(col)
    return F.when(c.isin(*NULL_MARKERS), F.lit(None).cast("string")).otherwise(c)


def middle_is_initial(col) -> Column:
    """P5: after removing dots a single character remains."""
    return F.length(strip(F.replace(_c(col), F.lit("."), F.lit("")))) == 1


def join_name(first, middle, last) -> Column:
    """first/middle/last joined by single spaces, empty parts skipped."""
    parts = [F.nullif(_c(p), F.lit("")) for p in (first, middle, last)]
    return F.concat_ws(" ", *parts)


def parse_name(raw) -> Column:
    """struct(first, middle, last) from a free-text full name.

    Parenthesised text is removed, the rest split on whitespace: one word gives
    only a last name (first NULL -> the name is rejected), two give first/last,
    three first/middle/last, more put the inner words together as the middle.
    """
    cleaned = strip(F.regexp_replace(_c(raw), REMARK, ""))
    parts = F.filter(F.split(cleaned, r"(?U)\s+"), lambda x: x != "")
    n = F.size(parts)
    first = F.when(n >= 2, F.get(parts, 0))
    last = F.when(n >= 1, F.element_at(parts, -1))
    middle = (
        F.when(n == 3, F.get(parts, 1))
        .when(n > 3, F.array_join(F.slice(parts, 2, n - 2), " "))
    )
    return F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"))


def year_from_path(path) -> Column:
    """First 19xx/20xx anywhere in the path, else 'Unknown'."""
    year = F.regexp_extract(_c(path), YEAR_IN_PATH, 1)
    return F.coalesce(F.nullif(year, F.lit("")), F.lit(UNKNOWN))


def money_text(col) -> Column:
    """Two-decimal text without grouping; non-numeric -> '0.00'."""
    value = F.coalesce(_c(col).try_cast("double"), F.lit(0.0))
    return F.call_function("format_number", value, F.lit("0.00"))


def money_label(col) -> Column:
    """P14b: '$1,234.50' form."""
    return F.concat(F.lit("$"), F.format_number(_c(col).try_cast("double"), 2))


def safe_slug(col) -> Column:
    """Keep word characters, blanks and hyphens; strip; blanks -> '_'."""
    kept = F.regexp_replace(_c(col), NOT_IN_SLUG, "")
    return F.replace(strip(kept), F.lit(" "), F.lit("_"))


def year_range_label(years) -> str:
    """The first and the last year with a hyphen between, or the only year."""
    first, *rest = sorted(set(years))
    return "-".join(map(str, [first, *rest[-1:]]))


def search_tokens(query: str | Column) -> Column:
    """Tokens of a free-text search: lower-case, split on whitespace, non-empty."""
    q = F.lit(query) if isinstance(query, str) else query
    return F.filter(F.split(F.lower(strip(q)), r"(?U)\s+"), lambda t: t != "")


def all_tokens_in(name, query: str | Column) -> Column:
    """every token is a substring of the lower-cased name; no tokens -> false."""
    tokens = search_tokens(query)
    lowered = F.lower(_c(name))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(lowered, t))
