"""Building blocks of the DuckDB oracle.

Only the stand-in file text (``BRIDGE_SQL``) is shared with the Spark side. The
rest restates the semantics directly in SQL: one UNION ALL branch per person
slot, DISTINCT for row de-duplication and ROW_NUMBER windows for "first row in
file order", so that a mistake in the Spark expressions is not mirrored here.
"""

from __future__ import annotations

from paylens.sources.bridge import BRIDGE_SQL

PAY = "Total_Amount_of_Payment_USDollars"
CR = "Covered_Recipient_"
PI = "Principal_Investigator_"
SLOTS = (1, 2, 3, 4, 5)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def cl(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def jn(f: str, m: str, l: str) -> str:
    return f"concat_ws(' ', nullif({f}, ''), nullif({m}, ''), nullif({l}, ''))"


def sql_str(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def canon(kind: str = "bridge", chunk: int = 2048) -> str:
    """CTEs ``c`` (flat cleaned columns), ``ci`` (+ identifier) and ``people``.

    kind: ``bridge`` -- file per year, position = row_id; ``csv`` -- the same
    rows read back from yearly CSV files, position = 0-based line number in the
    year; ``zip`` -- archive members of ``chunk`` row_id values per year,
    position = line number in the member. The stand-in has no specialty slots
    3-5 and no bare specialty column; they read as missing.
    """
    if kind == "bridge":
        src, pos = "CAST(year AS VARCHAR) || '_rsh_payments.csv'", "row_id"
    elif kind == "csv":
        src = "CAST(year AS VARCHAR) || '_rsh_payments.csv'"
        pos = "row_number() OVER (PARTITION BY year ORDER BY row_id) - 1"
    else:
        src = f"printf('%d/part-%05d.csv', year, CAST(floor(row_id / {chunk}) AS INTEGER))"
        pos = f"row_number() OVER (PARTITION BY year, floor(row_id / {chunk}) ORDER BY row_id) - 1"
    pi_cols = ", ".join(
        f"{cl(f'{PI}{j}_First_Name')} AS p{j}f, {cl(f'{PI}{j}_Middle_Name')} AS p{j}m, "
        f"{cl(f'{PI}{j}_Last_Name')} AS p{j}l, {cl(f'{PI}{j}_NPI')} AS p{j}n" for j in SLOTS)
    pi_npis = ", ".join(f"nullif(p{j}n, '')" for j in SLOTS)
    people = " ".join(f"UNION ALL SELECT row_id, {j}, p{j}f, p{j}m, p{j}l, p{j}n FROM ci"
                      for j in SLOTS)
    return f"""c AS MATERIALIZED (
  SELECT row_id, year, {src} AS source_file, CAST({pos} AS BIGINT) AS pos,
    TRY_CAST({PAY} AS DECIMAL(38,6)) AS amount,
    {cl(CR + 'First_Name')} AS cf, {cl(CR + 'Middle_Name')} AS cm,
    {cl(CR + 'Last_Name')} AS cln, {cl(CR + 'NPI')} AS cnpi,
    {cl(CR + 'Profile_ID')} AS cprof,
    coalesce(nullif(concat_ws('; ', nullif({cl(CR + 'Specialty_1')}, ''),
                              nullif({cl(CR + 'Specialty_2')}, '')), ''), 'Unknown') AS spec,
    {pi_cols}
  FROM ({BRIDGE_SQL}) w
), ci AS MATERIALIZED (
  SELECT *, coalesce(nullif(cnpi, ''), {pi_npis},
                     'PROFILE_' || nullif(cprof, ''), 'UNKNOWN_' || CAST(pos AS VARCHAR)) AS ident
  FROM c
), people AS MATERIALIZED (
  SELECT row_id, 0 AS slot, cf AS f, cm AS m, cln AS l, cnpi AS npi FROM ci
  {people}
)"""


CANON = canon("bridge")


def middle_ok(cell: str, km: str = "km") -> str:
    """Initial (one char once dots are gone) -> prefix test, else equality."""
    return (f"(CASE WHEN length({strip(f'replace({km}, {chr(39)}.{chr(39)}, {chr(39)}{chr(39)})')}) = 1 "
            f"THEN starts_with(lower({cell}), replace({km}, '.', '')) "
            f"ELSE lower({cell}) = {km} END)")


def queries_values(rows) -> str:
    """rows: (query_id, first, middle, last)."""
    vals = ", ".join(f"({int(i)}, {sql_str(f)}, {sql_str(m)}, {sql_str(l)})" for i, f, m, l in rows)
    return f"q AS (SELECT CAST(col0 AS BIGINT) AS query_id, col1 AS qf, col2 AS qm, col3 AS ql FROM (VALUES {vals}))"


def names_values(names) -> str:
    """A literal names list as a query (query_id, raw)."""
    vals = ", ".join(f"({i}, {sql_str(n)})" for i, n in enumerate(names, start=1))
    return f"SELECT CAST(col0 AS BIGINT) AS query_id, col1 AS raw FROM (VALUES {vals})"


def parsed_names(names_sql: str) -> str:
    """A names query -> (query_id, raw, first, middle, last) with the name-parsing rule."""
    parts = (r"list_filter(string_split_regex("
             + strip(r"regexp_replace(raw, '\([^)]*\)', '', 'g')")
             + r", '\s+'), lambda x: x <> '')")
    return f"""nm AS (
  {names_sql}
), np AS (SELECT query_id, raw, {parts} AS parts FROM nm
), parsed AS (
  SELECT query_id, raw,
    CASE WHEN len(parts) >= 2 THEN parts[1] END AS first_name,
    CASE WHEN len(parts) = 3 THEN parts[2]
         WHEN len(parts) > 3 THEN array_to_string(parts[2:len(parts)-1], ' ') END AS middle_name,
    CASE WHEN len(parts) >= 1 THEN parts[len(parts)] END AS last_name
  FROM np
)"""


def modes_cte() -> str:
    """Queries with a middle name search twice: narrow (with it) and wide (without)."""
    return """qs AS (
  SELECT query_id, trim(qf) AS qf, nullif(trim(qm), '') AS qm, trim(ql) AS ql FROM q
), qm AS (
  SELECT query_id, 'wide' AS mode, lower(qf) AS kf, lower(ql) AS kl, CAST(NULL AS VARCHAR) AS km FROM qs
  UNION ALL
  SELECT query_id, 'narrow', lower(qf), lower(ql), lower(qm) FROM qs WHERE qm IS NOT NULL
)"""


def report_ctes(years, merge: str = "reference") -> str:
    """From ``q`` (queries) to ``detail`` (query_id, NPI, ... Total_USD)."""
    ylist = ", ".join(str(y) for y in years)
    ypos = " ".join(f"WHEN {y} THEN {i}" for i, y in enumerate(years))
    pay_cols = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN m.year = {y} THEN m.total END), 0) AS DOUBLE) AS Payment_{y}_USD"
        for y in years)
    total = " + ".join(f"coalesce(sum(CASE WHEN m.year = {y} THEN m.total END), 0)" for y in years)
    if merge == "reference":
        merged = """merged AS (
  SELECT query_id, year, ident, name, specialty, max(entries) AS entries, max(total) AS total
  FROM firsts GROUP BY query_id, year, ident, name, specialty
)"""
    else:
        merged = """merged AS (
  SELECT w.query_id, w.year, w.ident, coalesce(n.name, w.name) AS name,
         coalesce(n.specialty, w.specialty) AS specialty, w.entries, w.total
  FROM firsts w LEFT JOIN firsts n
    ON n.mode = 'narrow' AND n.query_id = w.query_id AND n.year = w.year AND n.ident = w.ident
  WHERE w.mode = 'wide'
)"""
    return f""", {modes_cte()},
hits AS MATERIALIZED (
  SELECT DISTINCT m.query_id, m.mode, p.row_id
  FROM people p JOIN qm m ON lower(p.f) = m.kf AND lower(p.l) = m.kl
  WHERE p.f <> '' AND p.l <> '' AND (m.km IS NULL OR {middle_ok('p.m')})
), pihit AS MATERIALIZED (
  SELECT m.query_id, m.mode, p.row_id, min(p.slot) AS slot
  FROM people p JOIN qm m ON lower(p.f) = m.kf AND lower(p.l) = m.kl
  WHERE p.slot >= 1 AND p.f <> '' AND p.l <> '' AND (m.km IS NULL OR {middle_ok('p.m')})
  GROUP BY 1, 2, 3
), named AS MATERIALIZED (
  SELECT h.query_id, h.mode, x.year, x.row_id, x.amount, x.ident,
    CASE WHEN x.cf <> '' AND x.cln <> '' AND lower(x.cf) = m.kf AND lower(x.cln) = m.kl
              AND (m.km IS NULL OR {middle_ok('x.cm', 'm.km')}) THEN {jn('x.cf', 'x.cm', 'x.cln')}
         WHEN ph.slot IS NOT NULL THEN {jn('pp.f', 'pp.m', 'pp.l')}
         WHEN x.cf <> '' AND x.cln <> '' THEN {jn('x.cf', 'x.cm', 'x.cln')}
         ELSE 'Unknown' END AS name,
    CASE WHEN x.cf <> '' AND x.cln <> '' AND lower(x.cf) = m.kf AND lower(x.cln) = m.kl
              AND (m.km IS NULL OR {middle_ok('x.cm', 'm.km')}) THEN x.spec
         WHEN ph.slot IS NOT NULL THEN 'Principal Investigator'
         WHEN x.cf <> '' AND x.cln <> '' THEN x.spec
         ELSE 'Unknown' END AS specialty
  FROM hits h
  JOIN ci x ON x.row_id = h.row_id
  JOIN qm m ON m.query_id = h.query_id AND m.mode = h.mode
  LEFT JOIN pihit ph ON ph.query_id = h.query_id AND ph.mode = h.mode AND ph.row_id = h.row_id
  LEFT JOIN people pp ON pp.row_id = h.row_id AND pp.slot = ph.slot
  WHERE x.amount IS NOT NULL AND x.year IN ({ylist})
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id, mode, year, ident ORDER BY row_id) AS rn,
         sum(amount) OVER (PARTITION BY query_id, mode, year, ident) AS total,
         count(*) OVER (PARTITION BY query_id, mode, year, ident) AS entries
  FROM named
), firsts AS (
  SELECT query_id, mode, year, ident, name, specialty, total, entries FROM ranked WHERE rn = 1
), {merged},
pick AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, ident
      ORDER BY CASE year {ypos} END, total DESC, name, specialty) AS rn FROM merged
), detail AS (
  SELECT m.query_id, m.ident AS NPI, p.name AS Physician_Name, p.specialty AS Specialty,
    CAST(sum(m.entries) AS BIGINT) AS Entry_Count, {pay_cols},
    CAST({total} AS DOUBLE) AS Total_USD
  FROM merged m JOIN pick p ON p.query_id = m.query_id AND p.ident = m.ident AND p.rn = 1
  GROUP BY m.query_id, m.ident, p.name, p.specialty
)"""
