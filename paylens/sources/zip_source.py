"""ZIP archives of payment CSVs (S3, F9) as a Python data source.

CSV members of each archive are packed into input partitions of about
``targetPartitionBytes`` (a large member is a partition of its own) and parsed
inside the task by pyarrow's streaming CSV reader in bounded blocks: only the
columns that reports need, straight into Arrow batches. Members the reader rejects
(ragged rows) go on with the ``csv`` module from the first row not yet given out.

Members carry their own header, so a row has a slot ``c<i>`` for each needed column
and a bit mask of those that its member has. Blank lines before the header are
skipped, as pandas does. Members without the payment column are skipped, as are
folders and names that do not end in ``.csv`` (in any case). Paths are qualified as
Spark would, and archives opened through ``pyarrow.fs``, so the same code reads
local, HDFS or object-store paths.

Filters on ``source_file`` and on ``year`` (of the member's name) are pushed down: they
hold for whole members, so others are neither planned nor opened.

A member is one task here (deflate cannot be entered in the middle); callers that do
heavy work per row should ``repartition`` right after the scan. ``zip_store.py`` decodes
each member once, and its rows are read in splits ever after.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paylens.constants import NULL_MARKERS, PAYMENT_COLUMN, YEAR_IN_PATH
from paylens.plans.layouts import NEEDED, canonicalize_slots
from paylens.session import arrow_fs, limit_methods, qualified, ship_package

FORMAT = "paylens_zip"
SCHEMA = "source_file string, year int, row_no bigint, present bigint, " + ", ".join(f"c{i} string" for i in range(len(NEEDED)))

# Members are packed into one input partition up to this many uncompressed bytes.
TARGET_PARTITION_BYTES = 128 << 20


def list_archives(path: str) -> list[str]:
    from pyarrow import fs as pafs
    filesystem, root = arrow_fs(path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no archive at {path}")
    if info.type == pafs.FileType.File:
        return [path]
    sel = pafs.FileSelector(root, recursive=True)
    found = [i.path for i in filesystem.get_file_info(sel)
             if i.type == pafs.FileType.File and i.path.lower().endswith(".zip")]
    prefix = path[: len(path) - len(root)] if "://" in path else (
        "file:" if path.startswith("file:") else "")
    return sorted(prefix + p for p in found)


def member_year(member: str) -> int | None:
    """P13 for a member: the first year in its name."""
    found = re.search(YEAR_IN_PATH, member)
    return int(found.group(1)) if found else None


def csv_members(zf: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in zf.infolist() if not i.filename.endswith("/") and i.filename.lower().endswith(".csv")]


#: Comparisons that are decided for a member as a whole.
COMPARED: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a is not None and a == b, ds.EqualNullSafe: lambda a, b: a == b,
    ds.In: lambda a, b: a is not None and a in b, ds.GreaterThan: lambda a, b: a is not None and a > b,
    ds.GreaterThanOrEqual: lambda a, b: a is not None and a >= b, ds.LessThan: lambda a, b: a is not None and a < b,
    ds.LessThanOrEqual: lambda a, b: a is not None and a <= b, ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


class MemberPartition(InputPartition):
    """A run of members of one archive, read by one task."""

    def __init__(self, archive: str, members: list[str]):
        super().__init__((archive, tuple(members)))
        self.archive = archive
        self.members = list(members)


def _pack(archive: str, infos, target: int) -> list[MemberPartition]:
    parts, run, size = [], [], 0
    for info in infos:
        if run and size + info.file_size > target:
            parts.append(MemberPartition(archive, run))
            run, size = [], 0
        run.append(info.filename)
        size += info.file_size
    if run:
        parts.append(MemberPartition(archive, run))
    return parts


def _rows(fh):
    return csv.reader(io.TextIOWrapper(fh, encoding="utf-8-sig", newline=""))


def _header(rows) -> list[str]:
    """The first row that is not blank; a repeated name stands for its first column."""
    for row in rows:
        if any(cell.strip() for cell in row):
            return [n if row.index(n) == i else f"{n}.{i}" for i, n in enumerate(row)]
    return []


def _batch(member: str, first: int, n: int, present: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    none = pa.nulls(n, pa.string())
    slots = [columns.get(name, none) for name in NEEDED]
    return pa.record_batch(
        [pa.array([member] * n, pa.string()), pa.array([member_year(member)] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()),
         pa.array([present] * n, pa.int64()), *slots],
        names=["source_file", "year", "row_no", "present", *[f"c{i}" for i in range(len(NEEDED))]])


def _arrow_member(zf: zipfile.ZipFile, member: str, header: list[str], lines: int, present: int):
    """Stream one member through pyarrow's CSV reader in bounded blocks."""
    from pyarrow import csv as pacsv

    names = [h for h in header if h in NEEDED]
    first = 0
    with zf.open(member) as fh:
        reader = pacsv.open_csv(
            fh,
            read_options=pacsv.ReadOptions(column_names=header, skip_rows=lines, block_size=8 << 20),
            parse_options=pacsv.ParseOptions(newlines_in_values=True),
            convert_options=pacsv.ConvertOptions(
                include_columns=names, column_types={h: pa.string() for h in names}, null_values=list(NULL_MARKERS),
                strings_can_be_null=True, quoted_strings_can_be_null=True))
        for block in reader:
            if block.num_rows:
                yield _batch(member, first, block.num_rows, present, {n: block.column(n) for n in names})
                first += block.num_rows


def _python_member(zf: zipfile.ZipFile, member: str, present: int, skip: int, chunk: int = 8192):
    """Row by row, for members that pyarrow rejects: short rows read the absent cells
    as NULL, like pandas. The ``skip`` rows already given out are not repeated."""
    markers = set(NULL_MARKERS)
    with zf.open(member) as fh:
        rows = _rows(fh)
        header = _header(rows)
        at = [(i, h) for i, h in enumerate(header) if h in NEEDED]
        data = itertools.islice((r for r in rows if r), skip, None)
        first = skip
        while part := list(itertools.islice(data, chunk)):
            columns = {h: pa.array([None if i >= len(r) or r[i] in markers else r[i] for r in part], pa.string()) for i, h in at}
            yield _batch(member, first, len(part), present, columns)
            first += len(part)


def member_rows(zf: zipfile.ZipFile, member: str):
    """Batches of a member's rows (see ``SCHEMA``); none without the payment column."""
    with zf.open(member) as head:
        rows = _rows(head)
        header, lines = _header(rows), rows.line_num
    if PAYMENT_COLUMN not in header:
        return
    present = sum(1 << i for i, n in enumerate(NEEDED) if n in header)
    given = 0
    try:
        for batch in _arrow_member(zf, member, header, lines, present):
            given += batch.num_rows
            yield batch
    except pa.ArrowInvalid:  # a row the parser rejects; other errors are raised
        yield from _python_member(zf, member, present, given)


class ZipCsvReader(DataSourceReader):
    def __init__(self, path: str, target: int = TARGET_PARTITION_BYTES):
        self.path = path
        self.target = target
        self.wanted: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if isinstance(f, ds.IsNotNull) and f.attribute in (("year",), ("source_file",)):
                self.wanted.append((f.attribute[0], ds.IsNotNull, None))
            elif type(f) in COMPARED and f.attribute in (("year",), ("source_file",)) and value is not None:
                self.wanted.append((f.attribute[0], type(f), value))
            else:
                yield f

    def _chosen(self, member: str) -> bool:
        told = {"source_file": member, "year": member_year(member)}
        return all(told[name] is not None if kind is ds.IsNotNull else COMPARED[kind](told[name], value)
                   for name, kind, value in self.wanted)

    def partitions(self):
        parts = []
        for archive in list_archives(self.path):
            filesystem, p = arrow_fs(archive)
            with filesystem.open_input_file(p) as fh, zipfile.ZipFile(fh) as zf:
                infos = [i for i in csv_members(zf) if self._chosen(i.filename)]
            parts.extend(_pack(archive, infos, self.target))
        return parts or [MemberPartition("", [])]

    def read(self, partition):
        if not partition.archive:
            return
        filesystem, p = arrow_fs(partition.archive)
        with filesystem.open_input_file(p) as fh, zipfile.ZipFile(fh) as zf:
            for member in partition.members:
                yield from member_rows(zf, member)


class ZipCsvDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        target = int(self.options.get("targetPartitionBytes", TARGET_PARTITION_BYTES))
        return ZipCsvReader(self.options["path"], target)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    limit_methods(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipCsvDataSource)


def read_zip_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: raw member rows (see ``SCHEMA``)."""
    whole = qualified(spark, path)
    list_archives(whole)  # S9: fail early when the archive is absent
    register(spark)
    return spark.read.format(FORMAT).load(whole)


def canonical_members(rows: DataFrame, unknown_id: str = "row") -> DataFrame:
    """Member rows -> canonical payment rows."""
    return canonicalize_slots(rows, source_file=F.col("source_file"), year=F.col("year"), row_pos=F.col("row_no"), unknown_id=unknown_id)


def read_zip_payments(spark: SparkSession, path: str, unknown_id: str = "row") -> DataFrame:
    """S3 + S5: canonical payment rows of every CSV member of the archive(s). A filter
    on ``year`` or ``source_file`` opens the members that it names only."""
    return canonical_members(read_zip_rows(spark, path), unknown_id)


def _write_archive(batches, directory: str, member_col: str, order_col: str):
    """mapInArrow body: one archive per task. The task's rows come sorted by member,
    and each batch is written on as it comes; a retried task rewrites its archive."""
    from pyspark import TaskContext

    target = f"{directory.rstrip('/')}/archive-{TaskContext.get().partitionId():05d}.zip"
    filesystem, path = arrow_fs(target)
    out = zf = sheet = member = None
    names: list[str] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if zf is None:
            out = filesystem.open_output_stream(path)
            zf = zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED)
        columns = [c for c in batch.schema.names if c not in (member_col, order_col)]
        cells = [batch.column(c).to_pylist() for c in columns]
        for i, name in enumerate(batch.column(member_col).to_pylist()):
            if name != member:
                if sheet:
                    sheet.close()
                member = name
                names.append(name)
                sheet = io.TextIOWrapper(zf.open(name, "w", force_zip64=True), encoding="utf-8", newline="")
                writer = csv.writer(sheet, lineterminator="\n")
                writer.writerow(columns)
            writer.writerow(["" if col[i] is None else col[i] for col in cells])
    if zf:
        sheet.close()
        zf.close()
        out.close()
    yield pa.record_batch([pa.array([target] * len(names), pa.string()), pa.array(names, pa.string())], names=["archive", "member"])


def write_zip_members(wide: DataFrame, directory: str, member_col: str, order_col: str) -> int:
    """Pack a wide table into ZIP archives, one CSV member per ``member_col``
    value (rows in ``order_col`` order). Members are hash-spread over tasks and
    each task streams its own archive into ``directory`` (any file system pyarrow
    reaches), so no member list or data passes through the driver."""
    spark = wide.sparkSession
    whole = qualified(spark, directory)
    filesystem, root = arrow_fs(whole)
    filesystem.create_dir(root, recursive=True)
    ship_package(spark)
    out = wide.repartition(member_col).sortWithinPartitions(member_col, order_col).mapInArrow(
        lambda it: _write_archive(it, whole, member_col, order_col), "archive string, member string")
    return out.count()
