"""Incremental ingestion of yearly payment files with Structured Streaming.

The disclosure files arrive as whole CSV files, or as folders of part files, one per
program year, and again when a year is re-published. A file-source stream over the
landing folder discovers them; a micro-batch takes at most ``max_files`` paths, reads
those files with the batch reader (grouped by header), appends the canonical rows to
the Parquet store and, from the rows just stored, the groups of the appearance index.

Rows keep ``published``, the folder that their yearly file landed in. Readers take,
of each yearly file, the publication of the latest batch (of one batch, the folder
that sorts last), so a re-publication replaces what was there. Each batch writes its
own ``batch_id=<n>`` folder with overwrite: a batch replayed after a failure replaces
its own output. Rows keep their place in their part file, and are numbered when the
store is read, over all part files that the publication has by then, whichever batches
brought them.

Inside a batch each publication has a folder (``pub=<digest>``), so that
:func:`compact` drops superseded ones by deleting folders; no row is rewritten.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.constants import YEAR_IN_PATH
from paylens.operators.appearances import INDEX_KEYS, appearance_index
from paylens.sources.csv_years import PLACE, identified, numbered, read_files, unit_pattern
from paylens.sources.manifest import headers
from paylens.sources.store import write_canonical


def ingest_batch(spark: SparkSession, paths: list[str], store: str, index: str, batch_id: int,
                 multi_line: bool | None = None) -> None:
    """Canonicalise the given files and append them (one folder per batch)."""
    if not paths:
        return
    known = headers(spark, paths)
    for p, gone in known.lacks.items():
        raise ValueError(f"{p} lacks the columns {gone}")
    pattern = unit_pattern()
    name = F.regexp_extract("_file", r"[^/]*$", 0)
    unit = F.coalesce(F.nullif(F.regexp_extract("_file", pattern, 1), F.lit("")), name)
    year = F.coalesce(F.nullif(F.regexp_extract("_file", pattern, 2), F.lit("")),
                      F.nullif(F.regexp_extract(name, YEAR_IN_PATH, 1), F.lit(""))).cast("int")
    # The folder of the yearly file is what tells publications of a year apart.
    folder = F.regexp_replace("_file", re.sub(r"^\^\.\*/", "/", pattern), "/")
    rows = read_files(spark, sorted(paths), unit=F.concat(folder, unit), year=year, source_file=F.concat_ws("\u0001", unit, folder),
                      multi_line=multi_line, known=known, keep_place=True)
    parts = F.split("source_file", "\u0001")
    canonical = rows.withColumns({"published": F.element_at(parts, 2), "source_file": F.element_at(parts, 1)})
    canonical = canonical.withColumn("pub", publication(F.col("source_file"), F.col("published")))
    target = os.path.join(store, f"batch_id={batch_id}")
    write_canonical(canonical, target, mode="overwrite", by=["pub"])
    stored = spark.read.schema(canonical.schema).parquet(target)
    groups = appearance_index(stored, keep=["published", "pub"])
    (groups.withColumn("total_payment", F.col("total_payment").cast("decimal(38,6)")).hint("rebalance", F.col("pub"))
     .write.mode("overwrite").partitionBy("pub").parquet(os.path.join(index, f"batch_id={batch_id}")))


def publication(source_file: Column, published: Column) -> Column:
    """The name of a publication's folder; never one that reads as a number."""
    return F.concat(F.lit("p"), F.lower(F.lpad(F.hex(F.xxhash64(source_file, published)), 16, "0")))


def versions(rows: DataFrame) -> DataFrame:
    """(_f, _p): each yearly file and the folder of its latest publication."""
    return rows.groupBy("source_file").agg(F.max(F.struct("batch_id", "published")).alias("v")).select(
        F.col("source_file").alias("_f"), F.col("v.published").alias("_p"))


def latest(rows: DataFrame) -> DataFrame:
    """Rows of each yearly file's latest publication."""
    return rows.join(versions(rows), (F.col("source_file") == F.col("_f")) & (F.col("published") == F.col("_p"))).drop("_f", "_p")


def compact(spark: SparkSession, store: str, index: str) -> int:
    """Delete the folders of publications that a later one has replaced, in store and
    index; returns how many. Reads then cost what one publication of each file costs.

    The driver takes one name per yearly file. A call that is cut off is run again. A
    query planned before the call may miss files that it listed: run it again as well."""
    kept = versions(spark.read.parquet(store)).select(publication(F.col("_f"), F.col("_p")).alias("pub"))
    live = {f"pub={r.pub}" for r in kept.collect()}
    jvm, gone = spark.sparkContext._jvm, 0
    for base in (index, store):  # the store tells what is live, so it goes last
        path = jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for batch in fs.listStatus(path):
            if not batch.getPath().getName().startswith("batch_id="):
                continue
            inside = [s.getPath() for s in fs.listStatus(batch.getPath()) if s.getPath().getName().startswith("pub=")]
            dead = [p for p in inside if p.getName() not in live]
            for p in dead:
                gone += fs.delete(p, True)
            if dead and len(dead) == len(inside):
                fs.delete(batch.getPath(), True)
    return gone


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The streamed canonical rows, latest publications only."""
    rows = latest(spark.read.parquet(store))
    return identified(numbered(rows)).drop("batch_id", "published", "pub", "_pos", *PLACE)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The streamed index, re-aggregated so that a group whose files arrived in
    different micro-batches is still one exact row."""
    return (latest(spark.read.parquet(index)).groupBy(*INDEX_KEYS)
            .agg(F.sum("total_payment").alias("total_payment"),
                 F.sum("instance_count").alias("instance_count")))


def start_ingest(spark: SparkSession, landing: str, store: str, index: str, checkpoint: str, *,
                 available_now: bool = False, glob: str = "*.[cC][sS][vV]", multi_line: bool | None = None,
                 max_files: int = 1000, compact_every: int = 0):
    """Start the stream; returns the ``StreamingQuery``. With ``compact_every``, superseded
    publications are deleted after each so many batches.

    Only the paths of a micro-batch, ``max_files`` at most, travel through the driver
    (``binaryFile`` with its ``content`` column pruned); executors read the rows.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files: DataFrame = (spark.readStream.format("binaryFile").schema(schema)
                        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
                        .option("recursiveFileLookup", "true")
                        .load(landing).select("path"))

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        ingest_batch(batch.sparkSession, paths, store, index, batch_id, multi_line)
        if compact_every and paths and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, store, index)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
