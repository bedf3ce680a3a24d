"""Inventory of payment files (S2, S4): a stored table with a row per data file.

Path, length, modification time, header line and its digest, layout, the columns that
the layout lacks, number of records. Files are listed by Spark's file index, headers are
read in tasks, and a refresh reads the headers of new or changed files only: a file is
the same while path, length and modification time are. Each refresh that finds a change
writes a version of its own, complete before readers see it; the last two are kept.

``read_payment_years(..., manifest=<folder>)`` plans from it without opening a file.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.constants import OLD_LAYOUT
from paylens.plans.layouts import absent_columns
from paylens.session import arrow_fs, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = ("file string, path string, length long, modified timestamp, header string, digest string, layout string, "
          "columns int, lacks string, records long, version long")
BLANK = "﻿ \t\r\n"


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, path, length, modified) of the non-empty, non-hidden files that are at the
    paths or in folders there. ``file`` is what ``_metadata.file_path`` says of a row."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.where("length > 0").select(F.col("_metadata.file_path").alias("file"), "path", "length", F.col("modificationTime").alias("modified"))


def first_line(stream) -> str:
    """The first line that is not blank."""
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
        if line.strip(BLANK):
            return line.rstrip("\n")
    return ""


def _driver_line(spark: SparkSession, path: str) -> str:
    """The same through the Hadoop file system, for stores that only Spark can open."""
    fs, hpath = _fs(spark, path)
    stream = fs.open(hpath)
    try:
        jvm = spark.sparkContext._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip(BLANK):
            line = reader.readLine()
    finally:
        stream.close()
    return line or ""


def with_headers(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """``files`` with ``header``, read in the tasks that list them and stored; and the
    distinct headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                try:
                    filesystem, p = arrow_fs(path)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    lines.append(None)
                    continue
                with filesystem.open_input_file(p) as fh:
                    lines.append(first_line(fh))
            yield batch.append_column("header", pa.array(lines, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", header string"
    rows = staged(files.mapInArrow(read, fields), "file-headers")
    found = [r[0] for r in rows.select("header").distinct().collect()]  # layouts, few
    if None in found:  # stores that Python cannot open
        spark = files.sparkSession
        shut = [r[0] for r in rows.where("header IS NULL").select("path").collect()]
        more = spark.createDataFrame([(p, _driver_line(spark, p)) for p in shut], "path string, _line string")
        rows = rows.join(more, "path", "left").withColumn("header", F.coalesce("header", "_line")).select(*files.columns, "header")
        rows = staged(rows, "file-headers")
        found = [r[0] for r in rows.select("header").distinct().collect()]
    return rows, found


def columns_of(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]), [])


def _described(files: DataFrame, version: int) -> DataFrame:
    """The files' headers and what follows from them; each distinct header is looked at once."""
    rows, found = with_headers(files)
    told = []
    for line in found:
        names = columns_of(line)
        older = all(OLD_LAYOUT[part] in names for part in ("first", "last"))
        told.append((line, "older" if older else "newer", len(names), absent_columns(names)))
    known = files.sparkSession.createDataFrame(told, "header string, layout string, columns int, lacks string")
    return rows.join(F.broadcast(known), "header").select(
        "file", "path", "length", "modified", "header", F.sha2("header", 256).alias("digest"), "layout", "columns", "lacks",
        F.lit(None).cast("long").alias("records"), F.lit(version).cast("long").alias("version"))


def complete_versions(spark: SparkSession, store: str, prefix: str = "v=") -> list[int]:
    """Versions of a stored table that were written to their end."""
    fs, root = _fs(spark, store)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    done = [n for n in names if n.startswith(prefix) and fs.exists(_fs(spark, f"{store}/{n}/_SUCCESS")[1])]
    return sorted(int(n[len(prefix):]) for n in done)


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """The newest complete version; no rows where there is none."""
    versions = complete_versions(spark, store)
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{store.rstrip('/')}/v={versions[-1]}")


def _write(spark: SparkSession, store: str, rows: DataFrame, version: int) -> DataFrame:
    store = store.rstrip("/")
    rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(8).write.mode("overwrite").parquet(f"{store}/v={version}")
    for old in complete_versions(spark, store)[:-2]:
        fs, path = _fs(spark, f"{store}/v={old}")
        fs.delete(path, True)
    return read_manifest(spark, store)


def refresh(spark: SparkSession, store: str, paths: Sequence[str]) -> DataFrame:
    """The manifest brought up to date with what is at ``paths``; rows of other paths
    stay. ``version`` tells in which refresh a file's header was read."""
    known, now = read_manifest(spark, store), listed(spark, paths)
    same = ["file", "length", "modified"]
    fresh = now.join(known.select(*same), same, "left_anti")
    roots = [_fs(spark, p)[0].makeQualified(_fs(spark, p)[1]).toString() for p in paths]
    here = known.where(" OR ".join(f"path = {_quoted(r)} OR startswith(path, {_quoted(r.rstrip('/') + '/')})" for r in roots)) if roots else known.limit(0)
    gone = here.join(now.select(*same), same, "left_anti").select("file")
    n_fresh, n_gone = fresh.count(), gone.count()
    if not n_fresh and not n_gone:
        return known
    version = max(complete_versions(spark, store), default=0) + 1
    kept = known.join(gone, "file", "left_anti")
    rows = kept.unionByName(_described(fresh, version)) if n_fresh else kept
    return _write(spark, store, rows, version)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_records(spark: SparkSession, store: str, counts: DataFrame) -> DataFrame:
    """The manifest with the numbers of records of ``counts`` (file, records)."""
    known = read_manifest(spark, store)
    told = counts.select("file", F.col("records").cast("long").alias("_n"))
    rows = known.join(told, "file", "left").withColumn("records", F.coalesce("_n", "records")).drop("_n")
    return _write(spark, store, rows, max(complete_versions(spark, store), default=0) + 1)


class Headers:
    """What a reader needs of its files: their paths, headers and missing columns."""

    def __init__(self, lines: dict[str, str], files: dict[str, str], lacks: dict[str, str]):
        self.lines, self.files, self.lacks = lines, files, lacks

    def __bool__(self) -> bool:
        return bool(self.lines)

    def where(self, chosen) -> Headers:
        return Headers(*({p: v for p, v in d.items() if chosen(p)} for d in (self.lines, self.files, self.lacks)))

    def plus(self, other: Headers) -> Headers:
        return Headers(self.lines | other.lines, self.files | other.files, self.lacks | other.lacks)


def headers(spark: SparkSession, paths: Sequence[str], store: str | None = None) -> Headers:
    """Headers of the data files at ``paths``: from the manifest at ``store``, brought
    up to date, or read in one job. The driver holds a path and a digest a file."""
    if not paths:
        return Headers({}, {}, {})
    if store is None:
        rows = _described(listed(spark, paths), 0)
    else:
        rows = refresh(spark, store, paths).join(listed(spark, paths).select("file"), "file", "left_semi")
    texts = dict(tuple(r) for r in rows.select("digest", "header").distinct().collect())
    told = sorted(tuple(r) for r in rows.select("path", "file", "digest", "lacks").collect())
    return Headers({p: texts[d] for p, _, d, _ in told}, {p: f for p, f, _, _ in told}, {p: gone for p, _, _, gone in told if gone})
