"""CSV exports as files under their own names (K1-K3).

Spark writes the parts into a hidden folder beside the destination with its own
commit protocol, so a lost or retried task leaves no half part. Only when all parts are
there does the driver publish them: up to ``ONE_FILE`` bytes they are put together, in
order and under one header, and renamed over the destination in one step; beyond that
each part, at most ``ROWS`` rows, becomes a file ``name.part-00001.csv``, ... with a
header of its own. Bytes stream through a buffer of the file system's client, never through
Python, and a failure before the rename leaves the former export as it was.

An empty table is a file of the header alone. A folder of part files under the same
name, as Spark's own writer makes, is replaced; any other folder raises. Column names may hold no quote, comma or line break.
"""

from __future__ import annotations

import os
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from paylens.session import qualified

#: Greatest size in bytes of an export that is put together in one file.
ONE_FILE = 256 << 20
#: Rows of a part, header aside: what a spreadsheet opens.
ROWS = 1_048_575
BUFFER = 1 << 20


class _Files:
    """The file system of a folder, through the session's client."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) in the order of names."""
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(folder)))

    def replace(self, source: str, target: str) -> None:
        if self.fs.exists(self.path(target)) and self.fs.getFileStatus(self.path(target)).isDirectory():
            if not all(n.startswith(("part-", "_", ".")) for n, _ in self.listed(target)):
                raise FileExistsError(f"{target} is a folder of other files")
            self.fs.delete(self.path(target), True)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.context.rename(self.path(source), self.path(target), how)

    def put_together(self, parts: list[str], header: bytes, target: str) -> None:
        out = self.fs.create(self.path(target), True)
        try:
            out.write(header)
            for part in parts:
                read = self.fs.open(self.path(part))
                try:
                    start = bytearray(len(header))
                    if self.fs.getFileStatus(self.path(part)).getLen() >= len(header):
                        start = self.jvm.org.apache.commons.io.IOUtils.toByteArray(read, len(header))
                    read.seek(len(header) if bytes(start) == header else 0)
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, BUFFER, False)
                finally:
                    read.close()
        finally:
            out.close()


def _header(columns: list[str]) -> bytes:
    if bad := [c for c in columns if re.search(r'[",\r\n]', c)]:
        raise ValueError(f"no export under the column names {bad}")
    return (",".join(columns) + "\n").encode()


def _publish(files: _Files, folder: str, header: bytes, target: str, one_file: int) -> list[str]:
    """The parts in ``folder`` as ``target``, or as numbered files beside it."""
    parts = [(f"{folder}/{n}", size) for n, size in files.listed(folder) if n.startswith("part-")]
    if sum(size for _, size in parts) <= one_file:
        files.put_together([p for p, _ in parts], header, f"{folder}/whole")
        parts, made = [(f"{folder}/whole", 0)], [target]
    else:
        stem, end = os.path.splitext(target)
        made = [f"{stem}.part-{i:05d}{end}" for i in range(1, len(parts) + 1)]
    for (part, _), to in zip(parts, made, strict=True):
        files.replace(part, to)
    return made


def _drop_former(files: _Files, folder: str, targets: set[str], made: set[str]) -> None:
    """Delete what former exports of ``targets`` left in the other form, or in a longer series."""
    for name, _ in files.listed(folder):
        whole = f"{folder}/{re.sub(r'[.]part-[0-9]{5,}(?=[.][^.]*$|$)', '', name)}"
        if whole in targets and f"{folder}/{name}" not in made:
            files.fs.delete(files.path(f"{folder}/{name}"), True)


def _staged_parts(df: DataFrame, folder: str, rows: int, by: list[str]) -> None:
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"').option("maxRecordsPerFile", rows)
    (writer.partitionBy(*by) if by else writer).csv(folder)


def write_file(df: DataFrame, target: str, *, one_file: int = ONE_FILE, rows: int = ROWS) -> list[str]:
    """``df``, in its order, as the file ``target``; returns the files made."""
    target = qualified(df.sparkSession, target.rstrip("/"))
    parent, name = target.rsplit("/", 1)
    files, header = _Files(df.sparkSession, parent), _header(df.columns)
    folder = f"{parent}/.{name}-{uuid.uuid4().hex}"
    try:
        _staged_parts(df, folder, rows, [])
        made = _publish(files, folder, header, target, one_file)
        _drop_former(files, parent, {target}, set(made))
        return made
    finally:
        files.fs.delete(files.path(folder), True)


def write_files(df: DataFrame, file: str, directory: str, *, one_file: int = ONE_FILE, rows: int = ROWS) -> int:
    """``df`` as a file ``<value>.csv`` for each value of its column ``file`` (word
    characters and ``-``), one job for all, rows in the order of each partition;
    returns the number of values. The driver lists and renames, a value at a time."""
    directory = qualified(df.sparkSession, directory.rstrip("/"))
    files, header = _Files(df.sparkSession, directory), _header([c for c in df.columns if c != file])
    folder = f"{directory}/.parts-{uuid.uuid4().hex}"
    try:
        _staged_parts(df, folder, rows, [file])
        names = [n for n, _ in files.listed(folder) if n.startswith(f"{file}=")]
        values = [n.split("=", 1)[1] for n in names]
        if bad := [v for v in values if not re.fullmatch(r"[\w-]+", v)]:
            raise ValueError(f"no file names: {bad[:5]}")
        with ThreadPoolExecutor(8) as pool:
            made = list(pool.map(lambda n, v: _publish(files, f"{folder}/{n}", header, f"{directory}/{v}.csv", one_file), names, values))
        _drop_former(files, directory, {f"{directory}/{v}.csv" for v in values}, {f for one in made for f in one})
        return len(names)
    finally:
        files.fs.delete(files.path(folder), True)
