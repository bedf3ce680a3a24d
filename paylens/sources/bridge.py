"""Stand-in payment file derived from the driver's ``orders`` table.

The test tables hold no research payments, so parity checks run on a wide view
``rsh_wide`` in the newer column layout, built row by row from ``orders``. The
same SQL text runs in Spark and DuckDB. It only supplies rows in the schema the
jobs expect; every job treats it like any other payment file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.constants import FILE_NAME_PATTERN, PAYMENT_COLUMN
from paylens.plans.layouts import canonicalize
from paylens.session import limit_methods

# --- fixed values: name and specialty pools of the stand-in file ---
FIRST = ["Ann", "Benjamin", "carla", "DAVID", " Elena ", "Farid", "Grace", "Hugo"]
MIDDLE = ["G", "G.", "Grant", None, "M"]
LAST = ["Domb", "Smith", "Doe", "Okafor", "Li", "Garcia", "O'Neil"]
SPEC = ["Orthopedic Surgery", "Cardiology", "Oncology", None]


def _lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick(expr: str, pool: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(pool))
    return f"CASE ({expr}) % {len(pool)} {arms} END"


def bridge_select(source: str = "orders") -> str:
    """SQL producing the 30-column wide view from ``orders``."""
    o, c = "o_orderkey", "(o_custkey % 97)"
    cols = [
        f"{o} AS row_id",
        "CAST(year(o_orderdate) AS INT) AS year",
        f"CASE {o} % 50 WHEN 0 THEN 'N/A' WHEN 1 THEN '1,000.00' WHEN 2 THEN NULL "
        f"ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS {PAYMENT_COLUMN}",
        f"{_pick(c, FIRST)} AS Covered_Recipient_First_Name",
        f"{_pick(f'{c} + {o}', MIDDLE)} AS Covered_Recipient_Middle_Name",
        f"{_pick(c, LAST)} AS Covered_Recipient_Last_Name",
        f"CASE WHEN {o} % 3 <> 0 THEN CAST(1000000000 + {c} AS STRING) END AS Covered_Recipient_NPI",
        f"CASE WHEN {o} % 6 <> 0 THEN CAST(500000 + {c} AS STRING) END AS Covered_Recipient_Profile_ID",
        f"{_pick(c, SPEC)} AS Covered_Recipient_Specialty_1",
        f"CASE WHEN {c} % 9 = 0 THEN 'Research' END AS Covered_Recipient_Specialty_2",
    ]
    for j in range(1, 6):
        q = f"(({o} * {j} + {13 * j}) % 97)"
        present = f"({o} + {j}) % 4 = 0"
        pre = f"Principal_Investigator_{j}_"
        cols += [
            f"CASE WHEN {present} THEN {_pick(q, FIRST)} END AS {pre}First_Name",
            f"CASE WHEN {present} THEN {_pick(f'{q} + {o}', MIDDLE)} END AS {pre}Middle_Name",
            f"CASE WHEN {present} THEN {_pick(q, LAST)} END AS {pre}Last_Name",
            f"CASE WHEN {present} AND {o} % 5 <> 0 THEN CAST(1000000000 + {q} AS STRING) END AS {pre}NPI",
        ]
    return "SELECT " + ",\n  ".join(cols) + f"\nFROM {source}"


BRIDGE_SQL = bridge_select()

#: A names list, a line for each supplier; the same text runs in Spark and DuckDB.
_PERSON_NO = "s_suppkey % 40"
LISTED_SQL = f"""SELECT CAST(s_suppkey AS BIGINT) AS query_id,
  CASE WHEN s_suppkey % 11 = 0 THEN {_pick(_PERSON_NO, [x.strip() for x in LAST])}
       WHEN s_suppkey % 13 = 0 THEN '(retired)'
       ELSE concat_ws(' ', trim({_pick(_PERSON_NO, FIRST)}), {_pick(_PERSON_NO, MIDDLE)}, {_pick(_PERSON_NO, LAST)},
                      CASE WHEN s_suppkey % 4 = 1 THEN '(MD)' END) END AS raw
FROM supplier"""


def register_tables(spark: SparkSession, sf_dir: str, names=("orders",)) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def bridge_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide stand-in file over ``{sf_dir}/orders.parquet``."""
    limit_methods(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    view = f"orders_{abs(hash(sf_dir)) % 10**8}"
    orders.createOrReplaceTempView(view)
    return spark.sql(bridge_select(view))


def bridge_payments(spark: SparkSession, sf_dir: str, unknown_id: str = "row") -> DataFrame:
    """Canonical payments of the stand-in file: each year is its own
    ``<year>_rsh_payments.csv`` and ``row_id`` is the row's position."""
    wide = bridge_wide(spark, sf_dir)
    prefix, suffix = FILE_NAME_PATTERN.split("{year}")
    source_file = F.concat(F.lit(prefix), F.col("year").cast("string"), F.lit(suffix))
    return canonicalize(wide, source_file=source_file, year=F.col("year"),
                        row_pos=F.col("row_id"), unknown_id=unknown_id)
