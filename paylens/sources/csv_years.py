"""Yearly payment CSV files.

* Every cell is read as text (NPIs must stay strings) and the strings a pandas
  read treats as missing become NULL.
* The header of **every** data file is read, in tasks (``sources/manifest.py``), and
  files are grouped by it: columns never bind by position across files, years or
  layouts.
* Files are split: lines are read as text, checked for cells left open and parsed
  with ``from_csv``. A quoted line feed leaves a cell open at the end of a line; then
  ``multi_line=False`` raises, and the default reads the files that have such lines
  again, split by split (``sources/quoted.py``); the others stay as they were read.
  ``multi_line=True`` reads all files that way at once. No file is read as a whole.
* The CSV is parsed **once**: canonical rows are staged as Parquet in the shared
  folder, with each row's file, block and place in the block. Positions (W3) come
  from that table: lines of earlier blocks (a prefix sum over one row per block)
  plus the place in the block.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.constants import FILE_NAME_PATTERN
from paylens.functions.text import null_markers
from paylens.plans.layouts import absent_columns, canonicalize
from paylens.session import limit_methods, staged
from paylens.sources import quoted
from paylens.sources.manifest import Headers, columns_of, headers, with_records

OPEN_QUOTE = "a quoted cell holds a line feed; such files need multi_line=True"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of a file, or of the non-hidden, non-empty files of a folder."""
    fs, hpath = _fs(spark, path)
    status = fs.getFileStatus(hpath)
    found = [status] if not status.isDirectory() else [
        f for f in fs.listStatus(hpath) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(f.getPath().toString() for f in found if f.getLen() > 0)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file, or of the first data file of a folder."""
    return next((columns_of(line) for line in headers(spark, [path]).lines.values()), [])


def check_exists(spark: SparkSession, path: str) -> None:
    """Fail early, naming the absent file."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(f"no payment file at {path}")


def _parsed(rows: DataFrame, names: list[str], keep: Sequence[str]) -> DataFrame:
    """Records as text -> their cells under the header's names."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"'})
    parsed = rows.select(cells.alias("v"), *keep)
    return parsed.select(*[F.col(f"v.c{i}").alias(n) for i, n in enumerate(names)], *keep)


def _split_rows(spark: SparkSession, files: list[str], lines: set[str], names: list[str], strict: bool) -> DataFrame:
    """Rows of files that share a header, parsed line by line; ``_odd`` marks lines
    that end inside a quoted cell, whose file has to be read by ``quoted.records``."""
    text = spark.read.text(files).select("value", *quoted.place())
    is_row = (F.trim("value") != "") & ~((F.col("_block") == 0) & F.col("value").isin(*lines))
    odd = quoted.opens(F.col("value"))
    if strict:
        odd = F.when(odd, F.raise_error(F.lit(OPEN_QUOTE)).cast("boolean")).otherwise(False)
    rows = text.where(is_row).select("value", "_file", "_block", odd.alias("_odd"))
    return _parsed(rows, names, ["_file", "_block", "_odd"]).withColumn("_mid", F.monotonically_increasing_id())


#: Blocks whose offsets are sent to all tasks (a path and three numbers each); with more
#: of them, rows and offsets meet by an exchange that has a small share of them a task.
BLOCKS = 2**17


def numbered(rows: DataFrame, unit: str = "_unit") -> DataFrame:
    """``_pos``, the 0-based place of each row in its unit, over *stored* rows with
    ``_file``, ``_block`` and ``_mid`` (consecutive in a block): lines of earlier
    blocks plus the place in the block. Both sides read one stored table, so no row
    can be lost or moved. The offsets, a row per block, are sent to the rows: an exchange
    by block would gather whole splits, several where their hashes meet, in one task."""
    blocks = rows.groupBy(unit, "_file", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(unit).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "block-offsets")
    if offsets.count() <= BLOCKS:
        offsets = F.broadcast(offsets)
    return (rows.join(offsets, ["_file", "_block"])
            .withColumn("_pos", F.col("_before") + F.col("_mid") - F.col("_first")).drop("_first", "_before"))


def read_files(spark: SparkSession, files: Sequence[str], *, unit: Column, year: Column, source_file: Column,
               multi_line: bool | None = None, unknown_id: str = "row", known: Headers | None = None,
               manifest: str | None = None, keep_place: bool = False) -> DataFrame:
    """S1 + S5 + U2: data files of any headers -> canonical rows (invalid amounts as
    NULL). ``unit``, ``year`` and ``source_file`` are expressions of ``_file``, the
    path of a row's file; rows are numbered within a unit. The files are parsed and
    staged when this is called; ``known`` holds their headers if they were read before,
    and a ``manifest`` gets their numbers of records. ``keep_place`` keeps what rows are
    numbered by (``PLACE``), for tables whose parts come in turn."""
    limit_methods(spark)
    known = known or headers(spark, files, manifest)
    groups: dict[str, list[str]] = {}
    for path, line in known.lines.items():
        groups.setdefault(line.lstrip("\ufeff"), []).append(path)

    def canonical(rows: DataFrame, header: str) -> DataFrame:
        """Parsed records of files with that header -> what is staged of them."""
        names = _names(header)
        own = ["_file", "_block", "_mid", *[c for c in ("_odd", "_kind", "_part") if c in rows.columns]]
        cells = [null_markers(F.col(f"`{n}`")).alias(n) for n in names]
        return canonicalize(rows.select(*cells, *own), source_file=source_file, year=year, row_pos=F.lit(None).cast("bigint"),
                            unknown_id=unknown_id, validate=False, keep=[unit.alias("_unit"), *own])

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), parts)

    def open_cells(chosen: set[str]) -> DataFrame:
        """Rows of files whose cells may hold line feeds."""
        parts = []
        mine = [(header, [p for p in paths if known.files[p] in chosen]) for header, paths in groups.items()]
        for header, paths in mine:
            if paths:
                rows = quoted.records(spark, paths)
                whole = F.when(F.col("_kind") == quoted.WHOLE, F.col("value"))
                rest = F.when(F.col("_kind") != quoted.WHOLE, F.col("value"))
                told = rows.select(whole.alias("value"), "_file", "_block", "_mid", "_kind", rest.alias("_part"))
                parts.append(canonical(_parsed(told, _names(header), ["_file", "_block", "_mid", "_kind", "_part"]), header))
        stored = staged(union(parts), "csv-open")
        split = stored.where(F.col("_kind") != quoted.WHOLE).select("_file", "_block", "_mid", "_kind", F.col("_part").alias("value"))
        joined = staged(quoted.joined_parts(split), "csv-parts")
        mended = [canonical(_parsed(joined.where(F.col("_file").isin([known.files[p] for p in paths])), _names(header),
                                    ["_file", "_block", "_mid"]), header) for header, paths in mine if paths]
        return stored.where(F.col("_kind") == quoted.WHOLE).drop("_kind", "_part").unionByName(staged(union(mended), "csv-joined"))

    if multi_line:
        stored = open_cells(set(known.files.values()))
    else:
        parts = []
        for header, paths in groups.items():
            lines = {v for p in paths for v in (known.lines[p], known.lines[p].lstrip("\ufeff"))}
            parts.append(canonical(_split_rows(spark, paths, lines, _names(header), multi_line is False), header))
        stored = staged(union(parts), "csv-rows")
        odd = {r[0] for r in stored.where("_odd").select("_file").distinct().collect()}  # paths of files, as listed
        stored = stored.drop("_odd") if not odd else (
            stored.join(stored.where("_odd").select("_file").distinct(), "_file", "left_anti").drop("_odd").unionByName(open_cells(odd)))
    if manifest:
        with_records(spark, manifest, stored.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("records")))
    rows = identified(numbered(stored.withColumn("_unknown", F.col("identifier").isNull())), unknown_id)
    return rows.drop("_pos") if keep_place else rows.drop("_pos", *PLACE)


#: What tells a row's place in its unit, and whether its identifier follows from that.
PLACE = ["_unit", "_file", "_block", "_mid", "_unknown"]


def identified(rows: DataFrame, unknown_id: str = "row") -> DataFrame:
    """Numbered rows with their place as ``row_pos``, and ``UNKNOWN_<place>`` for those
    without an identifier of their own."""
    where = F.concat(F.col("source_file"), F.lit("#")) if unknown_id == "file_row" else F.lit("")
    unknown = F.concat(F.lit("UNKNOWN_"), where, F.col("_pos").cast("string"))
    return rows.withColumns({"row_pos": F.col("_pos"), "identifier": F.when(F.col("_unknown"), unknown).otherwise(F.col("identifier"))})


def _names(header: str) -> list[str]:
    """A header's names; a name that was there before gets its place."""
    names = columns_of(header)
    return [n if names.index(n) == i else f"{n}.{i}" for i, n in enumerate(names)]


def read_payment_file(spark: SparkSession, path: str, *, year: int | None = None, source_file: str | None = None,
                      multi_line: bool | None = None, unknown_id: str = "row", manifest: str | None = None) -> DataFrame:
    """S1 + S6: one yearly file (or a folder of its part files) -> canonical rows."""
    check_exists(spark, path)
    known = headers(spark, [path], manifest)
    check_columns(path, known)
    return read_files(spark, list(known.lines), unit=F.lit(path), year=F.lit(year).cast("int"), unknown_id=unknown_id,
                      source_file=F.lit(source_file or os.path.basename(path)), multi_line=multi_line, known=known, manifest=manifest)


def check_columns(path: str, known: Headers) -> None:
    """Every data file must have the columns that its layout needs."""
    if not known:
        raise ValueError(f"{path} holds no data")
    for f, gone in known.lacks.items():
        raise ValueError(f"{f} lacks the columns {gone}")


def year_file(directory: str, year: int) -> str:
    return os.path.join(directory, FILE_NAME_PATTERN.format(year=year))


def unit_pattern() -> str:
    """Regex over a data file's path capturing the yearly file name -- the file
    itself, or the folder holding Spark's part files -- and its year."""
    prefix, suffix = FILE_NAME_PATTERN.split("{year}")
    name = re.escape(prefix) + r"(\d{4})" + re.escape(suffix)
    return rf"^.*/({name})(?:/[^/]*)?$"


def year_headers(spark: SparkSession, directory: str, years: Sequence[int], manifest: str | None = None) -> dict[int, Headers]:
    """S2 + S9: the data files of each year, all headers by one job; an absent yearly
    file raises, naming it."""
    paths = {y: year_file(directory, y) for y in dict.fromkeys(int(v) for v in years)}
    for path in paths.values():
        check_exists(spark, path)
    known = headers(spark, list(paths.values()), manifest)
    names = {y: os.path.basename(p) for y, p in paths.items()}
    return {y: known.where(lambda p, n=names[y]: n in p.split("/")[-2:]) for y in paths}


def read_payment_years(spark: SparkSession, directory: str, years: Sequence[int], *, multi_line: bool | None = None,
                       unknown_id: str = "row", on_error: str = "raise", manifest: str | None = None) -> DataFrame:
    """S2 + U2: ``<year>_rsh_payments.csv`` per requested year, layouts mixed at will.

    Years and numbering units come from each row's file path. ``on_error="skip_year"``
    drops, with a warning, a year of which a file lacks required columns (an absent
    file always raises). ``manifest``: the folder of a stored inventory
    (``sources/manifest.py``), brought up to date and planned from."""
    good = Headers({}, {}, {})
    for y, known in year_headers(spark, directory, years, manifest).items():
        try:
            check_columns(year_file(directory, y), known)
        except ValueError as e:
            if on_error != "skip_year":
                raise
            warnings.warn(f"year {y} is left out: {e}", stacklevel=2)
            continue
        good = good.plus(known)
    if not good:
        raise ValueError("no readable year file")
    unit = F.regexp_extract("_file", unit_pattern(), 1)
    year = F.regexp_extract("_file", unit_pattern(), 2).cast("int")
    return read_files(spark, list(good.lines), unit=unit, year=year, source_file=unit, multi_line=multi_line, unknown_id=unknown_id,
                      known=good, manifest=manifest)


def write_year_files(wide: DataFrame, directory: str, year_col: str = "year", order_col: str = "row_id") -> list[int]:
    """Write a wide table as header-bearing CSV per year in one Spark job
    (stand-in fixtures and the K1 writer): rows range-partitioned and sorted on
    ``(year, order_col)``, written with ``partitionBy(year)`` so every task
    writes its own slice. Each year's folder is then named like a yearly file
    (``<year>_rsh_payments.csv``) so readers treat it as one input; a name that is
    taken raises."""
    staging = directory.rstrip("/") + "/_staging"
    (wide.repartitionByRange(F.col(year_col), F.col(order_col))
         .sortWithinPartitions(year_col, order_col).drop(order_col)
         .write.mode("overwrite").partitionBy(year_col).option("header", True)
         .option("quote", '"').option("escape", '"').csv(staging))
    spark = wide.sparkSession
    fs, hstaging = _fs(spark, staging)
    years = []
    for st in fs.listStatus(hstaging):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{year_col}="):
            y = int(name.split("=", 1)[1])
            target = _fs(spark, year_file(directory, y))[1]
            if fs.exists(target) or not fs.rename(st.getPath(), target):
                raise FileExistsError(f"cannot name the rows of {y} {target.toString()}")
            years.append(y)
    return sorted(years)
