"""A store of decoded ZIP members (S3): each member is decoded once.

Deflate has no entry points, so one large member is one task whenever it is decoded.
The store keeps the needed columns of a member's rows as Parquet, in folders by year,
and an inventory of members (archive, name, CRC, sizes). A refresh lists the archives'
directories in tasks, decodes the members that are new or changed, and writes an
inventory of its own; later scans of any member run in Parquet splits, and a year reads
its folders only.

A refresh that fails leaves the store as it was: rows count once an inventory names
their version, and an inventory counts once it is complete.
"""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import arrow_fs, limit_methods, qualified, ship_package, staged
from paylens.sources.manifest import complete_versions
from paylens.sources.zip_source import SCHEMA, canonical_members, csv_members, list_archives, member_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBERS = "archive string, member string, crc long, bytes long, packed long"
# Members decoded by one task, in uncompressed bytes: less than a scan's, for Python parses them.
DECODE_BYTES = 32 << 20
SAME = ["archive", "member", "crc", "bytes", "packed"]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            filesystem, p = arrow_fs(archive)
            with filesystem.open_input_file(p) as fh, zipfile.ZipFile(fh) as zf:
                told = [(archive, i.filename, i.CRC, i.file_size, i.compress_size) for i in csv_members(zf)]
            yield pa.RecordBatch.from_pylist([dict(zip(SAME, t, strict=True)) for t in told],
                                             pa.schema([(n, pa.string() if n in ("archive", "member") else pa.int64()) for n in SAME]))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            filesystem, p = arrow_fs(archive)
            with filesystem.open_input_file(p) as fh, zipfile.ZipFile(fh) as zf:
                for rows in member_rows(zf, member):
                    yield rows.add_column(0, "archive", pa.array([archive] * rows.num_rows, pa.string()))


def members(spark: SparkSession, path: str) -> DataFrame:
    """The CSV members of the archive(s) at ``path``, listed in tasks."""
    ship_package(spark)
    found = list_archives(qualified(spark, path))
    archives = spark.createDataFrame([(a,) for a in found], "archive string").repartition(max(1, min(len(found), 10_000)))
    return archives.mapInArrow(_list, MEMBERS)


def known_members(spark: SparkSession, store: str) -> DataFrame:
    """The newest complete inventory, with the version that holds each member's rows."""
    versions = complete_versions(spark, f"{store}/members")
    if not versions:
        return spark.createDataFrame([], f"{MEMBERS}, version long")
    return spark.read.parquet(f"{store}/members/v={versions[-1]}")


def refresh(spark: SparkSession, path: str, store: str) -> int:
    """Decode what is new or changed at ``path``; returns how many members that were.
    Members that are gone from the archives leave the inventory."""
    now, known = staged(members(spark, path), "zip-members"), known_members(spark, store)
    fresh = now.join(known.select(*SAME), SAME, "left_anti")
    n, size = fresh.agg(F.count("*"), F.sum("bytes")).first()
    kept = known.join(now.select(*SAME), SAME, "left_semi")
    if not n and kept.count() == known.count():
        return 0
    version = max(complete_versions(spark, f"{store}/members"), default=0) + 1
    if n:
        parts = max(1, min(n, -(-size // DECODE_BYTES)))
        rows = fresh.select("archive", "member").repartition(parts).mapInArrow(_decode, f"archive string, {SCHEMA}")
        rows.write.mode("overwrite").partitionBy("year").parquet(f"{store}/rows/version={version}")
    listed = kept.select(*SAME, "version").unionByName(fresh.withColumn("version", F.lit(version).cast("long")))
    listed.coalesce(8).write.mode("overwrite").parquet(f"{store}/members/v={version}")
    return n


def read_store(spark: SparkSession, store: str, unknown_id: str = "row") -> DataFrame:
    """Canonical payment rows of the members in the newest inventory. Filters on
    ``year`` read that year's folders."""
    limit_methods(spark)
    known = known_members(spark, store).select("archive", F.col("member").alias("source_file"), F.col("version").cast("int").alias("version"))
    if not complete_versions(spark, f"{store}/rows", prefix="version="):
        rows = spark.createDataFrame([], f"archive string, {SCHEMA}, version int")
    else:
        rows = spark.read.schema(f"archive string, {SCHEMA}, version int").parquet(f"{store}/rows")
    current = rows.join(known, ["archive", "source_file", "version"], "left_semi")
    return canonical_members(current, unknown_id)
