"""Oracle SQL per parity query (DuckDB dialect, driver tables pre-registered)."""

from __future__ import annotations

from paylens.sources.bridge import LISTED_SQL
from oracle.base import (
    BRIDGE_SQL, CANON, jn, middle_ok, modes_cte, names_values, parsed_names, queries_values,
    report_ctes, sql_str, strip,
)
from paylens.plans.parity import (
    ABSENT, ABSENT_YEAR, BATCH_NAMES, PERSON, QUOTED_CELL, SEARCH_YEAR, SUMMARY_FILTER, TOP_LISTED, YEARS,
)

_ONE = queries_values([(0, *PERSON)])
_DETAIL_COLS = ("NPI, Physician_Name, Specialty, Entry_Count, "
                + ", ".join(f"Payment_{y}_USD" for y in YEARS) + ", Total_USD")


def _report(merge: str = "reference", asked: str = _ONE) -> str:
    return f"WITH {CANON}, {asked}{report_ctes(YEARS, merge)}\nSELECT {_DETAIL_COLS} FROM detail"


def _totals() -> str:
    return (f"WITH {CANON}, {_ONE}{report_ctes(YEARS)}\n"
            "SELECT CAST(sum(CAST(Total_USD AS DECIMAL(38,6))) AS DOUBLE) AS total_payment, "
            "CAST(sum(Entry_Count) AS BIGINT) AS total_entries FROM detail")


def _search_summary() -> str:
    f, m, l = PERSON
    return f"""WITH {CANON}, {_ONE}, {modes_cte()},
one AS (SELECT * FROM qm WHERE mode = CASE WHEN (SELECT count(*) FROM qm) > 1 THEN 'narrow' ELSE 'wide' END),
hits AS (
  SELECT DISTINCT p.row_id FROM people p JOIN one m ON lower(p.f) = m.kf AND lower(p.l) = m.kl
  WHERE p.f <> '' AND p.l <> '' AND (m.km IS NULL OR {middle_ok('p.m')})
), firstpi AS (
  SELECT p.row_id, min(p.slot) AS slot FROM people p JOIN one m ON lower(p.f) = m.kf AND lower(p.l) = m.kl
  WHERE p.slot >= 1 AND p.f <> '' AND p.l <> '' AND (m.km IS NULL OR {middle_ok('p.m')}) GROUP BY 1
), rows AS (
  SELECT x.row_id, x.amount, x.ident,
    CASE WHEN lower(x.cf) = m.kf AND lower(x.cln) = m.kl AND x.cf <> '' AND x.cln <> ''
              AND (m.km IS NULL OR {middle_ok('x.cm', 'm.km')}) THEN {jn('x.cf', 'x.cm', 'x.cln')}
         WHEN fp.slot IS NOT NULL THEN {jn('pp.f', 'pp.m', 'pp.l')}
         ELSE {jn('x.cf', 'x.cm', 'x.cln')} END AS name,
    CASE WHEN lower(x.cf) = m.kf AND lower(x.cln) = m.kl AND x.cf <> '' AND x.cln <> ''
              AND (m.km IS NULL OR {middle_ok('x.cm', 'm.km')}) THEN x.spec
         WHEN fp.slot IS NOT NULL THEN 'Principal Investigator' ELSE x.spec END AS specialty
  FROM hits h JOIN ci x ON x.row_id = h.row_id CROSS JOIN one m
  LEFT JOIN firstpi fp ON fp.row_id = h.row_id
  LEFT JOIN people pp ON pp.row_id = h.row_id AND pp.slot = fp.slot
  WHERE x.amount IS NOT NULL AND x.year = {SEARCH_YEAR}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY ident ORDER BY row_id) AS rn,
    sum(amount) OVER (PARTITION BY ident) AS tot, count(*) OVER (PARTITION BY ident) AS n FROM rows
)
SELECT ident AS NPI, name AS Physician_Name, specialty AS Specialty, CAST(n AS BIGINT) AS Entry_Count,
       CAST(tot AS DOUBLE) AS Total_Payment_USD FROM r WHERE rn = 1"""


_PAY = [f"Payment_{y}_USD" for y in YEARS]
_BQ = ("q AS (SELECT query_id, first_name AS qf, middle_name AS qm, last_name AS ql FROM parsed "
       "WHERE first_name IS NOT NULL AND last_name IS NOT NULL)")


_LISTED = parsed_names(LISTED_SQL)


def _batch_with(names: str | None = None) -> str:
    """Parsed names -> detail -> summary CTEs, for the parity names list by default."""
    names = names or parsed_names(names_values(BATCH_NAMES))
    pq = ", ".join(f"sum(CAST({c} AS DECIMAL(38,6))) AS {c}" for c in _PAY)
    sel = ", ".join(f"CAST(coalesce(s.{c}, 0) AS DOUBLE) AS {c}" for c in _PAY)
    return f"""WITH {CANON}, {names}, {_BQ}{report_ctes(YEARS)},
perq AS (
  SELECT query_id, {pq}, sum(CAST(Total_USD AS DECIMAL(38,6))) AS tp, sum(Entry_Count) AS te
  FROM detail GROUP BY query_id
), summary AS (
  SELECT a.query_id, a.raw AS Full_Name, a.first_name AS First_Name,
    coalesce(a.middle_name, '') AS Middle_Name, a.last_name AS Last_Name, {sel},
    CAST(coalesce(s.tp, 0) AS DOUBLE) AS Total_Payment, CAST(coalesce(s.te, 0) AS BIGINT) AS Total_Entries
  FROM parsed a LEFT JOIN perq s ON s.query_id = a.query_id
  WHERE a.first_name IS NOT NULL AND a.last_name IS NOT NULL
), winners AS (
  SELECT {jn('first_name', "coalesce(middle_name, '')", 'last_name')} AS display_name,
         max(query_id) AS query_id
  FROM parsed WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY 1
)"""


def _batch_detail() -> str:
    return _batch_with() + f"\nSELECT query_id, {_DETAIL_COLS} FROM detail"


def _batch_summary() -> str:
    return _batch_with() + "\nSELECT * FROM summary"


def _rejected() -> str:
    return (f"WITH {_LISTED} SELECT query_id, raw FROM parsed "
            "WHERE first_name IS NULL OR last_name IS NULL")


def _multi() -> str:
    return _batch_with() + """
SELECT w.display_name AS name, d.NPI, d.Specialty, d.Entry_Count, d.Total_USD
FROM detail d JOIN winners w ON w.query_id = d.query_id
WHERE d.query_id IN (SELECT query_id FROM detail GROUP BY query_id HAVING count(*) > 1)"""


def _counts() -> str:
    return _batch_with() + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM summary) AS physicians_processed,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT d.query_id, count(DISTINCT d.NPI) AS n
     FROM detail d JOIN winners w ON w.query_id = d.query_id GROUP BY d.query_id)) AS total_unique_npis,
  (SELECT CAST(count(DISTINCT d.NPI) AS BIGINT) FROM detail d JOIN winners w ON w.query_id = d.query_id)
     AS global_unique_npis,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT d.query_id FROM detail d JOIN winners w
     ON w.query_id = d.query_id GROUP BY d.query_id HAVING count(DISTINCT d.NPI) > 1))
     AS physicians_with_multiple_npis"""


def _year_totals() -> str:
    arms = " UNION ALL ".join(
        f"SELECT '{y}' AS label, CAST(coalesce(sum(CAST(Payment_{y}_USD AS DECIMAL(38,6))), 0) AS DOUBLE) "
        f"AS total_payment FROM summary" for y in YEARS)
    return _batch_with() + (f"\n{arms} UNION ALL SELECT 'TOTAL', CAST(coalesce(sum(CAST(Total_Payment "
                            "AS DECIMAL(38,6))), 0) AS DOUBLE) FROM summary")


def _top(names: str | None, k: int) -> str:
    cols = ", ".join(_PAY)
    return _batch_with(names) + f"""
SELECT query_id, {jn('First_Name', 'Middle_Name', 'Last_Name')} AS Physician_Name, {cols},
  Total_Payment, Total_Entries FROM summary ORDER BY Total_Payment DESC, query_id LIMIT {k}"""


def _last_wins() -> str:
    return f"""WITH {_LISTED}
SELECT {jn('first_name', "coalesce(middle_name, '')", 'last_name')} AS display_name, max(query_id) AS query_id
FROM parsed WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY 1"""


def _batch_errors() -> str:
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS Payment_{y}_USD" for y in [*YEARS, ABSENT_YEAR])
    return f"""WITH {_LISTED}
SELECT query_id, raw AS Full_Name, first_name AS First_Name, coalesce(middle_name, '') AS Middle_Name,
  last_name AS Last_Name, {zeros}, CAST(0 AS DOUBLE) AS Total_Payment, CAST(0 AS BIGINT) AS Total_Entries,
  '{ABSENT_YEAR}_rsh_payments.csv' AS Error
FROM parsed WHERE first_name IS NOT NULL AND last_name IS NOT NULL"""


def _names_file() -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY query_id) - 1 AS BIGINT) AS query_id, {strip('raw')} AS raw "
            f"FROM ({LISTED_SQL}) x")


_SLUG = "replace(" + strip(r"regexp_replace(raw, '[^\w\s-]', '', 'g')") + ", ' ', '_')"
_MONEY_TEXT = ", ".join(f"printf('%.2f', {c}) AS {c}" for c in [*_PAY, "Total_USD"])


def _detail_export() -> str:
    return _batch_with() + f"""
SELECT {_SLUG} AS query_slug, d.query_id, NPI, Physician_Name, Specialty, Entry_Count, {_MONEY_TEXT}
FROM detail d JOIN parsed p ON p.query_id = d.query_id"""


def _detail_files() -> str:
    return _batch_with() + f"""
SELECT {_SLUG} || '-' || d.query_id || '.csv' AS file_name, NPI, Physician_Name, Specialty, Entry_Count, {_MONEY_TEXT}
FROM detail d JOIN parsed p ON p.query_id = d.query_id"""


def _physician_export() -> str:
    return (f"WITH {CANON}, {_ONE}{report_ctes(YEARS)}\nSELECT NPI, Physician_Name, Specialty, Entry_Count, {_MONEY_TEXT}, "
            f"'research_payments_{PERSON[2]}_{PERSON[0]}_' || "
            f"(SELECT min(y) || '-' || max(y) FROM (VALUES {', '.join(f'({y})' for y in YEARS)}) t(y)) || '.csv' AS file_name FROM detail")


def _summary_filter() -> str:
    return _batch_with() + (f"\nSELECT * FROM summary WHERE contains(upper("
                            f"{jn('First_Name', 'Middle_Name', 'Last_Name')}), upper({sql_str(SUMMARY_FILTER)}))")


def _alert_flags() -> str:
    return _batch_with() + f"""
SELECT s.*, EXISTS (
  SELECT 1 FROM detail d JOIN winners w ON w.query_id = d.query_id
  WHERE w.display_name = {jn('s.First_Name', 's.Middle_Name', 's.Last_Name')}
    AND d.query_id IN (SELECT query_id FROM detail GROUP BY query_id HAVING count(*) > 1)
) AS Has_Multiple_NPIs
FROM summary s"""


_DATA_NAMES = f"""nm AS (
  SELECT row_id AS query_id,
    concat_ws(' ', Covered_Recipient_First_Name, Covered_Recipient_Middle_Name, Covered_Recipient_Last_Name)
    || coalesce(' (' || Covered_Recipient_Specialty_1 || ')', '') AS raw
  FROM ({BRIDGE_SQL}) w
)"""


def _parse_names() -> str:
    parts = (r"list_filter(string_split_regex("
             + strip(r"regexp_replace(raw, '\([^)]*\)', '', 'g')")
             + r", '\s+'), lambda x: x <> '')")
    return f"""WITH {_DATA_NAMES}, np AS (SELECT query_id, raw, {parts} AS parts FROM nm)
SELECT query_id, raw,
  CASE WHEN len(parts) >= 2 THEN parts[1] END AS first_name,
  CASE WHEN len(parts) = 3 THEN parts[2]
       WHEN len(parts) > 3 THEN array_to_string(parts[2:len(parts)-1], ' ') END AS middle_name,
  CASE WHEN len(parts) >= 1 THEN parts[len(parts)] END AS last_name
FROM np"""


def _slug_label() -> str:
    ends = ", ".join(f"({y})" for y in YEARS)
    lab = f"(SELECT CASE WHEN min(y) < max(y) THEN min(y) || '-' || max(y) ELSE '' || min(y) END FROM (VALUES {ends}) t(y))"
    slug = "replace(" + strip(r"regexp_replace(raw, '[^\w\s-]', '', 'g')") + ", ' ', '_')"
    return (f"WITH {_DATA_NAMES} SELECT query_id, raw, {slug} AS slug, "
            f"'research_payments_' || {slug} || '_' || {lab} || '.csv' AS file_name FROM nm")


def _batch_data_names() -> str:
    pq = ", ".join(f"sum(CAST({c} AS DECIMAL(38,6))) AS {c}" for c in _PAY)
    sel = ", ".join(f"CAST(coalesce(s.{c}, 0) AS DOUBLE) AS {c}" for c in _PAY)
    parts = (r"list_filter(string_split_regex("
             + strip(r"regexp_replace(raw, '\([^)]*\)', '', 'g')")
             + r", '\s+'), lambda x: x <> '')")
    return f"""WITH {CANON}, nm AS (
  SELECT row_number() OVER (ORDER BY raw) AS query_id, raw FROM (SELECT DISTINCT concat_ws(' ',
    Covered_Recipient_First_Name, Covered_Recipient_Middle_Name, Covered_Recipient_Last_Name) AS raw
    FROM ({BRIDGE_SQL}) w)
), np AS (SELECT query_id, raw, {parts} AS parts FROM nm
), parsed AS (
  SELECT query_id, raw,
    CASE WHEN len(parts) >= 2 THEN parts[1] END AS first_name,
    CASE WHEN len(parts) = 3 THEN parts[2]
         WHEN len(parts) > 3 THEN array_to_string(parts[2:len(parts)-1], ' ') END AS middle_name,
    CASE WHEN len(parts) >= 1 THEN parts[len(parts)] END AS last_name
  FROM np
), {_BQ}{report_ctes(YEARS)},
perq AS (
  SELECT query_id, {pq}, sum(CAST(Total_USD AS DECIMAL(38,6))) AS tp, sum(Entry_Count) AS te
  FROM detail GROUP BY query_id
)
SELECT a.raw AS Full_Name, a.first_name AS First_Name, coalesce(a.middle_name, '') AS Middle_Name,
  a.last_name AS Last_Name, {sel}, CAST(coalesce(s.tp, 0) AS DOUBLE) AS Total_Payment,
  CAST(coalesce(s.te, 0) AS BIGINT) AS Total_Entries
FROM parsed a LEFT JOIN perq s ON s.query_id = a.query_id
WHERE a.first_name IS NOT NULL AND a.last_name IS NOT NULL"""


ORACLE = {
    "physician_report": _report(),
    "absent_report": _report(asked=queries_values([(0, *ABSENT)])),
    "dual_search_by_id": _report("by_id"),
    "physician_totals": _totals(),
    "search_summary": _search_summary(),
    "batch_detail": _batch_detail(),
    "incremental_detail": _batch_detail(),
    "batch_summary": _batch_summary(),
    "rejected_names": _rejected(),
    "multi_identifier": _multi(),
    "identifier_counts": _counts(),
    "year_totals": _year_totals(),
    "top10": _top(None, 10),
    "top_listed": _top(_LISTED, TOP_LISTED),
    "batch_errors": _batch_errors(),
    "names_file": _names_file(),
    "detail_export": _detail_export(),
    "detail_files": _detail_files(),
    "physician_export": _physician_export(),
    "last_query_wins": _last_wins(),
    "summary_filter": _summary_filter(),
    "alert_flags": _alert_flags(),
    "parse_names": _parse_names(),
    "slug_label": _slug_label(),
    "batch_data_names": _batch_data_names(),
}


# ---------------------------------------------------------------- row level
from oracle.base import canon  # noqa: E402
from paylens.plans.parity import (  # noqa: E402
    CASE_QUERY, MIDDLE_FULL_QUERY, MIDDLE_INITIAL_QUERY, REPORT_QUERY, ROLE_QUERY,
    SHORT_QUERY, TOKEN_QUERY, TOP_HITS, ZIP_CHUNK_ROWS,
)

_FLAT = ("source_file, year, pos AS row_pos, CAST(amount AS DOUBLE) AS amount, cf AS cov_first, "
         "cm AS cov_middle, cln AS cov_last, cnpi AS cov_npi, cprof AS cov_profile, "
         "spec AS specialty, ident AS identifier")


def _canonical(kind: str = "bridge") -> str:
    return f"WITH {canon(kind, ZIP_CHUNK_ROWS)} SELECT {_FLAT} FROM ci WHERE amount IS NOT NULL"


def _quoted() -> str:
    cell = f"CASE WHEN row_id % 3 = 0 THEN {sql_str(QUOTED_CELL)} ELSE Covered_Recipient_Specialty_2 END"
    wide = f"SELECT * REPLACE ({cell} AS Covered_Recipient_Specialty_2) FROM ({BRIDGE_SQL}) b"
    return _canonical("csv").replace(f"FROM ({BRIDGE_SQL}) w", f"FROM ({wide}) w")


_MANIFEST = f"""SELECT CAST(year AS VARCHAR) || '_rsh_payments.csv' AS source_file,
  CASE WHEN year % 2 = 1 THEN 'older' ELSE 'newer' END AS layout, '' AS lacks,
  CASE WHEN year IN ({', '.join(map(str, YEARS[-3:]))}) THEN 3 ELSE 1 END::BIGINT AS version, CAST(28 AS BIGINT) AS n_columns,
  CAST(count(*) AS BIGINT) AS records
FROM ({BRIDGE_SQL}) w WHERE year IN ({', '.join(map(str, YEARS))}) GROUP BY year"""

_INVALID = (f"WITH {CANON} SELECT year, CAST(count(*) FILTER (WHERE amount IS NULL) AS BIGINT) "
            "AS invalid_rows, CAST(count(*) AS BIGINT) AS total_rows FROM ci GROUP BY year")

_CLEAN = f"""SELECT row_id,
  coalesce({strip("Covered_Recipient_First_Name")}, '') AS first_clean,
  lower(coalesce({strip("Covered_Recipient_First_Name")}, '')) AS first_norm,
  coalesce({strip("Covered_Recipient_First_Name")}, '') AS first_norm_cs,
  lower({strip("Principal_Investigator_1_First_Name")}) AS pi1_first_value
FROM ({BRIDGE_SQL}) w"""



def _lit_middle(cell: str, q: str) -> str:
    qn = q.strip().lower()
    return middle_ok(cell, sql_str(qn))


_MIDDLE = f"""WITH {CANON} SELECT row_id AS row_pos, cm AS middle,
  length({strip("replace(cm, '.', '')")}) = 1 AS middle_is_initial,
  {_lit_middle('cm', MIDDLE_INITIAL_QUERY)} AS match_initial,
  {_lit_middle('cm', MIDDLE_FULL_QUERY)} AS match_full
FROM ci"""

_DISPLAY = (f"WITH {CANON} SELECT row_id AS row_pos, {jn('cf', 'cm', 'cln')} AS covered_name, "
            f"{jn('p1f', 'p1m', 'p1l')} AS pi1_name FROM ci")
_RESOLVE = f"WITH {CANON} SELECT row_id AS row_pos, ident AS identifier FROM ci"
_SPEC = f"WITH {CANON} SELECT row_id AS row_pos, spec AS specialty FROM ci"

_NAMED_COLS = ("SELECT query_id, mode, row_id AS row_pos, year, ident AS identifier, "
               "CAST(amount AS DOUBLE) AS amount, name, specialty FROM named")


def _identity_rows() -> str:
    return f"WITH {CANON}, {_ONE}{report_ctes(YEARS)}\n{_NAMED_COLS}"


def _batch_match_rows() -> str:
    return _batch_with() + "\n" + _NAMED_COLS


def _role_rows(where_slot: str) -> str:
    f, _m, l = ROLE_QUERY
    return f"""WITH {CANON}, hit AS (
  SELECT DISTINCT row_id FROM people
  WHERE {where_slot} AND lower(f) = {sql_str(f.strip().lower())} AND lower(l) = {sql_str(l.strip().lower())}
)"""


def _role_search(where_slot: str) -> str:
    return _role_rows(where_slot) + """
SELECT x.year, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(x.amount) AS DOUBLE) AS amount
FROM hit JOIN ci x ON x.row_id = hit.row_id WHERE x.amount IS NOT NULL GROUP BY x.year"""


_ANY_SLOT = _role_rows("slot BETWEEN 0 AND 5") + """
SELECT x.row_id AS row_pos, x.year, CAST(x.amount AS DOUBLE) AS amount
FROM hit JOIN ci x ON x.row_id = hit.row_id WHERE x.amount IS NOT NULL"""


def _case_sensitive() -> str:
    f, _m, l = CASE_QUERY
    fq, lq = sql_str(f.strip()), sql_str(l.strip())
    return f"""WITH {CANON}, hit AS (
  SELECT DISTINCT row_id FROM people WHERE f = {fq} AND l = {lq}
), pi AS (
  SELECT row_id, min(slot) AS slot FROM people WHERE slot >= 1 AND f = {fq} AND l = {lq} GROUP BY 1
), rows AS (
  SELECT x.row_id, x.year, x.amount, x.ident,
    CASE WHEN x.cf = {fq} AND x.cln = {lq} THEN {jn('x.cf', 'x.cm', 'x.cln')}
         WHEN pi.slot IS NOT NULL THEN {jn('pp.f', 'pp.m', 'pp.l')}
         WHEN x.cf <> '' AND x.cln <> '' THEN {jn('x.cf', 'x.cm', 'x.cln')} ELSE 'Unknown' END AS name,
    CASE WHEN x.cf = {fq} AND x.cln = {lq} THEN x.spec
         WHEN pi.slot IS NOT NULL THEN 'Principal Investigator'
         WHEN x.cf <> '' AND x.cln <> '' THEN x.spec ELSE 'Unknown' END AS specialty
  FROM hit h JOIN ci x ON x.row_id = h.row_id
  LEFT JOIN pi ON pi.row_id = h.row_id LEFT JOIN people pp ON pp.row_id = h.row_id AND pp.slot = pi.slot
  WHERE x.amount IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY year, ident ORDER BY row_id) AS rn,
    sum(amount) OVER (PARTITION BY year, ident) AS tot, count(*) OVER (PARTITION BY year, ident) AS n
  FROM rows
)
SELECT year, ident AS NPI, name AS Physician_Name, specialty AS Specialty,
  CAST(n AS BIGINT) AS Entry_Count, CAST(tot AS DOUBLE) AS Total_Payment_USD FROM r WHERE rn = 1"""


def _dual_year() -> str:
    return (f"WITH {CANON}, {_ONE}{report_ctes(YEARS)}\n"
            "SELECT year, ident AS NPI, name AS Physician_Name, specialty AS Specialty, "
            "CAST(entries AS BIGINT) AS Entry_Count, CAST(total AS DOUBLE) AS Total_Payment_USD "
            "FROM merged")


_ORDINAL = (f"WITH {canon('csv')} SELECT year, pos AS ordinal, cf AS cov_first, cln AS cov_last, cnpi AS cov_npi, "
            "CAST(amount AS DOUBLE) AS amount FROM ci")

_MIXED = (f"WITH {canon('csv')} SELECT {_FLAT.replace(', pos AS row_pos', '').replace('ident AS', 'KNOWN AS')} FROM ci "
          "WHERE amount IS NOT NULL").replace(
    "KNOWN AS", "CASE WHEN starts_with(ident, 'UNKNOWN_') THEN 'UNKNOWN' ELSE ident END AS")

_YEAR_PATH = (r"SELECT page_id, coalesce(nullif(regexp_extract(url, '((?:19|20)\d{2})', 1), ''), "
              r"'Unknown') AS year FROM pages")

_CURRENCY = (f"WITH {CANON} SELECT row_id AS row_pos, "
             "printf('%.2f', coalesce(CAST(amount AS DOUBLE), 0)) AS amount_text, "
             "'$' || format('{:,.2f}', CAST(amount AS DOUBLE)) AS amount_label FROM ci")


def _summary_export() -> str:
    pays = ", ".join(f"printf('%.2f', {c}) AS {c}" for c in _PAY)
    return _batch_with() + (f"\nSELECT Full_Name, First_Name, Middle_Name, Last_Name, {pays}, "
                            "printf('%.2f', Total_Payment) AS Total_Payment, Total_Entries FROM summary")


# ---------------------------------------------------------- appearance index
def _apps_ctes(kind: str = "bridge") -> str:
    year = r"coalesce(nullif(regexp_extract(source_file, '((?:19|20)\d{2})', 1), ''), 'Unknown')"
    cov = f"""SELECT {jn('cf', 'cm', 'cln')} AS display_name, cf AS first_name, cm AS middle_name,
    cln AS last_name, 'Covered Recipient' AS role, {year} AS year, source_file, amount,
    CASE WHEN cnpi <> '' THEN cnpi WHEN cprof <> '' THEN cprof ELSE '' END AS identifier,
    CASE WHEN cnpi <> '' THEN 'NPI' WHEN cprof <> '' THEN 'Profile ID' ELSE 'Missing' END AS identifier_type,
    spec AS specialty
  FROM ci WHERE amount IS NOT NULL AND cf <> '' AND cln <> ''"""
    pis = " ".join(f"""UNION ALL SELECT {jn(f'p{j}f', f'p{j}m', f'p{j}l')}, p{j}f, p{j}m, p{j}l,
    'Principal Investigator {j}', {year}, source_file, amount, p{j}n,
    CASE WHEN p{j}n <> '' THEN 'NPI' ELSE 'Missing' END, 'Principal Investigator'
  FROM ci WHERE amount IS NOT NULL AND p{j}f <> '' AND p{j}l <> ''""" for j in SLOTS_)
    return f"""WITH {canon(kind, ZIP_CHUNK_ROWS)}, apps AS (
  {cov}
  {pis}
), idx AS (
  SELECT display_name, first_name, middle_name, last_name, role, year, identifier, identifier_type,
    specialty, source_file, sum(amount) AS total_payment, count(*) AS instance_count
  FROM apps GROUP BY ALL
)"""


SLOTS_ = (1, 2, 3, 4, 5)
_IDX_TYPED = ("SELECT display_name, first_name, middle_name, last_name, role, year, identifier, "
              "identifier_type, specialty, source_file, CAST(total_payment AS DOUBLE) AS total_payment, "
              "CAST(instance_count AS BIGINT) AS instance_count FROM idx")


def _tokens_match(q: str) -> str:
    toks = (rf"list_filter(string_split_regex(lower({strip(sql_str(q))}), '\s+'), "
            "lambda t: t <> '')")
    return (f"(len({toks}) > 0 AND list_bool_and(list_transform({toks}, "
            "lambda t: contains(lower(display_name), t))))")


def _appearances() -> str:
    return (_apps_ctes() + "\nSELECT display_name, lower(display_name) AS display_name_normalized, "
            "first_name, middle_name, last_name, role, year, source_file, "
            "CAST(amount AS DOUBLE) AS payment_amount, identifier, identifier_type, specialty FROM apps")


def _index_stats(more: str = "") -> str:
    return _apps_ctes() + """
SELECT CAST(count(*) AS BIGINT) AS indexed_matches, CAST(count(DISTINCT display_name) AS BIGINT) AS physicians,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list(year) FILTER (WHERE year <> 'Unknown'))), ', '), ''),
           'Unknown') AS years""" + more + "\nFROM idx"


def _index_json() -> str:
    def s(c):
        return f"to_json({c})"
    parts = [f'"display_name":\' || {s("display_name")}',
             f'"display_name_normalized":\' || {s("lower(display_name)")}']
    for c in ("first_name", "middle_name", "last_name", "role", "year", "identifier",
              "identifier_type", "specialty", "source_file"):
        parts.append(f'"{c}":\' || {s(c)}')
    parts.append('"total_payment":\' || CAST(CAST(total_payment AS DECIMAL(38,2)) AS VARCHAR)')
    parts.append('"instance_count":\' || CAST(instance_count AS VARCHAR)')
    body = " || \',".join(parts)
    return _apps_ctes() + f"\nSELECT '{{{body} || '}}' AS record FROM idx"


def _search_report() -> str:
    return _apps_ctes() + f"""
SELECT display_name, lower(display_name) AS display_name_normalized, first_name, middle_name, last_name,
  role, year, identifier, identifier_type, specialty, source_file,
  CAST(CAST(total_payment AS DECIMAL(38,2)) AS DOUBLE) AS total_payment,
  CAST(instance_count AS BIGINT) AS instance_count,
  CASE WHEN identifier = '' THEN 'Missing unique identifier' ELSE identifier_type || ': ' || identifier END
    AS identifier_label
FROM idx WHERE {_tokens_match(REPORT_QUERY)}"""


# ------------------------------------------------------------ file sources
def _unioned_years() -> str:
    sel = ", ".join(f"CASE WHEN year = {y} THEN CAST(total AS DOUBLE) END AS Payment_{y}_USD"
                    for y in YEARS)
    return (f"WITH {canon('csv')}, {_ONE}{report_ctes(YEARS)}\n"
            "SELECT year, ident AS NPI, name AS Physician_Name, specialty AS Specialty, "
            f"CAST(entries AS BIGINT) AS Entry_Count, {sel} FROM merged")


ORACLE.update({
    "canonical_payments": _canonical(),
    "invalid_amount_count": _INVALID,
    "clean_normalize": _CLEAN,
    "middle_match": _MIDDLE,
    "display_names": _DISPLAY,
    "resolve_identifier": _RESOLVE,
    "specialty": _SPEC,
    "identity_rows": _identity_rows(),
    "batch_match_rows": _batch_match_rows(),
    "search_covered": _role_search("slot = 0"),
    "search_pi": _role_search("slot >= 1"),
    "search_any": _role_search("slot BETWEEN 0 AND 5"),
    "any_slot_rows": _ANY_SLOT,
    "search_case_sensitive": _case_sensitive(),
    "dual_search_year": _dual_year(),
    "row_ordinal": _ORDINAL,
    "year_from_path": _YEAR_PATH,
    "currency_text": _CURRENCY,
    "summary_export": _summary_export(),
    "appearances": _appearances(),
    "appearance_index": _apps_ctes() + "\n" + _IDX_TYPED,
    "token_search": _apps_ctes() + "\n" + _IDX_TYPED + f" WHERE {_tokens_match(TOKEN_QUERY)}",
    "indexed_search": _apps_ctes() + "\n" + _IDX_TYPED + f" WHERE {_tokens_match(TOKEN_QUERY)}",
    "indexed_top": _apps_ctes() + "\n" + _IDX_TYPED + f" WHERE {_tokens_match(SHORT_QUERY)} ORDER BY idx.total_payment DESC, "
                   f"display_name, year, role, identifier, identifier_type, specialty, source_file LIMIT {TOP_HITS}",
    "index_stats": _index_stats(),
    "merged_stats": _index_stats(", CAST(count(DISTINCT nullif(identifier, '')) AS BIGINT) AS identifiers"),
    "missing_identifier": _apps_ctes() + "\n" + _IDX_TYPED + " WHERE identifier = ''",
    "index_json": _index_json(),
    "search_report": _search_report(),
    "csv_roundtrip_scan": _canonical("csv"),
    "csv_split_scan": _canonical("csv"),
    "csv_quoted_scan": _quoted(),
    "file_manifest": _MANIFEST,
    "mixed_layout_years": _MIXED,
    "unioned_years": _unioned_years(),
    "zip_scan": _canonical("zip"),
    "zip_year_scan": _canonical("zip") + f" AND year = {SEARCH_YEAR}",
    "zip_store_scan": _canonical("zip"),
    "zip_index": _apps_ctes("zip") + "\n" + _IDX_TYPED,
    "stream_index": _apps_ctes("csv") + "\n" + _IDX_TYPED,
    "republished_index": _apps_ctes("csv") + "\n" + _IDX_TYPED,
})
