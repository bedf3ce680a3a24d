"""Session construction and the shared scratch location.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by the
cluster owner). Only when it is unset -- local tests and benchmarks -- do we
create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "paylens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # AQE merges small shuffle partitions up to this size and splits skewed
        # ones above it; scan splits use the same unit.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        # Stages whose generated methods exceed the JIT's 8000-byte limit run as
        # interpreted bytecode; above it, fall back to per-operator codegen.
        .config("spark.sql.codegen.hugeMethodLimit", JIT_METHOD)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. Only a local master gets one of its
    own where none is set: on a cluster it must be a folder that all executors share."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="paylens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


#: The JIT leaves methods beyond so many bytes of code to the interpreter.
JIT_METHOD = "8000"


def limit_methods(spark: SparkSession) -> None:
    """Let stages whose generated methods exceed the JIT's limit fall back to code per
    operator, as :func:`build_session` does; a session's own setting stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, JIT_METHOD)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint location for staged tables."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")
    _MADE.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete the staged tables that this driver has made so far; call it when no
    DataFrame that reads them is needed any more. Returns how many were deleted."""
    jvm, n = spark.sparkContext._jvm, 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: lineage
    ends there, and a lost executor costs only the tasks that it ran."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would give it (``fs.defaultFS``
    for one without)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hpath).toString()


def arrow_fs(path: str):
    """(pyarrow FileSystem, path) for a ``file:`` URI or any URI pyarrow understands
    (hdfs://, s3://, ...). Callers qualify paths without a scheme first."""
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        local = path[len("file:"):]
        while local.startswith("//"):
            local = local[1:]
        return pafs.LocalFileSystem(), local
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``paylens`` importable in Python workers (what ``--py-files`` does).

    Needed only by the Python-side pieces (ZIP reader, ZIP writer). The archive
    of the package sources is written once per SparkContext into the shared
    folder (any file system ``pyarrow`` can reach) and added with ``addPyFile``.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    folder = shared_dir(spark, "pyfiles")
    target = folder.rstrip("/") + "/paylens.zip"
    filesystem, path = arrow_fs(target)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED[key] = target
