"""Records of CSV files whose quoted cells hold line feeds, read in splits.

A split of a text file begins at a line, but that line may lie inside a quoted cell.
What a line does to the state "inside a quoted cell" depends on the line alone: it
keeps it, flips it, or leaves it set or unset whatever it was. These compose, so

1. ``split_states``: one scan tells, for each split and for both states that it may
   begin in, the state that it ends in; a prefix composition over that small table
   (a row per split) gives the state in which each split does begin;
2. ``records``: a second scan cuts each split into its records with that state. Lines of a
   cell are put together again, and a record that goes on in later splits leaves its
   parts (``TAIL``, ``HEAD``), which ``joined_parts`` puts together.

Each scan streams through its splits in order; no line is shuffled, and no task reads
more than its splits. Lines end at a line feed (a carriage return before it belongs to
the line end); quotes count as a CSV reader counts them: at the start of a cell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A line that begins outside a quoted cell and ends inside one: whole cells, then a
#: cell that is opened and not closed. Possessive throughout, so linear in the line.
OPENS = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+\z'
#: Kinds of rows: whole records; the begin of one that goes on in a later split; lines
#: of one that began in an earlier split.
WHOLE, TAIL, HEAD = 0, 1, 2
#: Splits whose states are sent to all tasks (17 bytes each).
SPLITS = 2**21


def opens(line: Column) -> Column:
    """A line that begins outside a quoted cell ends inside one."""
    return F.contains(line, F.lit('"')) & line.rlike(OPENS)


def _stays(line: Column) -> Column:
    """A line that begins inside a quoted cell ends inside one."""
    return F.when(F.contains(line, F.lit('"')), F.concat(F.lit('"'), line).rlike(OPENS)).otherwise(True)


def place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(files).select("value", *place())
    return lines.select("*", F.xxhash64("_file").alias("_key"), opens(F.col("value")).alias("_o"), _stays(F.col("value")).alias("_s"))


def states_after(opened: np.ndarray, stayed: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line, from what the lines do to it."""
    fixed = opened == stayed
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(opened)), -1))
    flips = np.cumsum(opened & ~stayed)
    base = np.where(at >= 0, opened[at], start)
    return base ^ (((flips - np.where(at >= 0, flips[at], 0)) & 1) == 1)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal keys."""
    if not len(keys[0]):
        return []
    new = np.logical_or.reduce([np.diff(k) != 0 for k in keys])
    edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: its end state from either begin."""
    now, ends = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v]) for v in (*now, *ends)], names=["_key", "_block", "_o", "_s"])

    for batch in batches:
        key, block = (batch.column(i).to_numpy() for i in (0, 1))
        o, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for a, b in _runs(key, block):
            if (key[a], block[a]) != now:
                if now is not None:
                    yield row()
                now, ends = (key[a], block[a]), (False, True)
            ends = tuple(bool(states_after(o[a:b], s[a:b], e)[-1]) for e in ends)
    if now is not None:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """(_key, _block, _start): whether a split begins inside a quoted cell."""
    ends = lines.select("_key", "_block", "_o", "_s").mapInArrow(_summarised, "_key long, _block long, _o boolean, _s boolean")
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("_o") == F.col("_s")
    upto = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    flips = ends.withColumn("_flips", F.sum((F.col("_o") & ~F.col("_s")).cast("int")).over(upto))
    last = F.last(F.when(fixed, F.struct(F.col("_o").alias("v"), F.col("_flips").alias("f"))), ignorenulls=True).over(before)
    told = flips.withColumn("_last", last).withColumn("_n", F.coalesce(F.max("_flips").over(before), F.lit(0)))
    since = (F.col("_n") - F.coalesce(F.col("_last.f"), F.lit(0))) % 2 == 1
    start = F.coalesce(F.col("_last.v"), F.lit(False)) != since
    return told.select("_key", "_block", start.alias("_start"))


class _Split:
    """One split's records, as its lines come in."""

    def __init__(self, file: str, block: int, start: bool):
        self.file, self.block, self.inside, self.header = file, block, start, block == 0
        self.held: list[str] = []  # lines of the record that is not complete
        self.begun, self.n = not start, 0

    def rows(self, values: list, kinds: list[int]) -> pa.RecordBatch:
        n = len(values)
        mids = np.where(np.array(kinds) == HEAD, -1, self.n + np.cumsum(np.array(kinds) != HEAD) - 1)
        self.n += sum(k != HEAD for k in kinds)
        return pa.record_batch([pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array(mids, pa.int64()),
                                pa.array(kinds, pa.int32()), pa.array(values, pa.string())], names=["_file", "_block", "_mid", "_kind", "value"])

    def take(self, lines: pa.Array, opened: np.ndarray, stayed: np.ndarray) -> Iterator[pa.RecordBatch]:
        after = states_after(opened, stayed, self.inside)
        starts = np.flatnonzero(~np.concatenate([[self.inside], after[:-1]]))
        self.inside = bool(after[-1])
        lead = int(starts[0]) if len(starts) else len(lines)
        if lead:
            self.held += lines[:lead].to_pylist()
        if not len(starts):
            return
        values, kinds = [], []
        if self.held:
            values.append("\n".join(self.held))
            kinds.append(WHOLE if self.begun else HEAD)
        self.held, self.begun = [], True
        stops = np.concatenate([starts[1:], [len(lines)]])
        done = len(starts) - int(self.inside)
        if self.inside:
            self.held = lines[int(starts[-1]):].to_pylist()
        many = np.flatnonzero(stops[:done] - starts[:done] > 1).tolist()
        whole = lines.take(pa.array(starts[:done])).to_pylist()
        for i in many:
            whole[i] = "\n".join(lines[int(starts[i]):int(stops[i])].to_pylist())
        values += whole
        kinds += [WHOLE] * done
        yield from self._kept(values, kinds)

    def _kept(self, values: list[str], kinds: list[int]) -> Iterator[pa.RecordBatch]:
        texts = pc.utf8_rtrim(pa.array(values, pa.string()), characters="\r")
        blank = pc.equal(pc.utf8_trim(texts, characters=" ﻿"), "").to_numpy(zero_copy_only=False)
        keep = (~blank | (np.array(kinds) != WHOLE)).nonzero()[0].tolist()
        if self.header and keep:  # the first record of a file is its header
            keep, self.header = keep[1:], False
        if keep:
            texts = texts.to_pylist()
            yield self.rows([values[i] if kinds[i] == HEAD else texts[i] for i in keep], [kinds[i] for i in keep])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.inside and self.held:
            yield self.rows(["\n".join(self.held)], [TAIL if self.begun else HEAD])
        elif self.held:
            yield from self._kept(["\n".join(self.held)], [WHOLE if self.begun else HEAD])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, now = None, None
    for batch in batches:
        value = batch.column(0)
        key, block = (batch.column(i).to_numpy() for i in (2, 3))
        o, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        for a, b in _runs(key, block):
            if (key[a], block[a]) != now:
                if split:
                    yield from split.close()
                now = (key[a], block[a])
                split = _Split(batch.column(1)[a].as_py(), int(block[a]), batch.column(6)[a].as_py())
            yield from split.take(value.slice(a, b - a), o[a:b], s[a:b])
    if split:
        yield from split.close()


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(_file, _block, _mid, _kind, value): records of the files, header and blank
    lines left out, numbered within their split. A split that the first scan did not
    see (splits follow the session's settings) raises."""
    lines = _lines(spark, files)
    states = staged(split_states(lines), "split-states")
    if states.count() > SPLITS:
        raise ValueError(f"more than {SPLITS} splits at once; read fewer files, or larger splits (spark.sql.files.maxPartitionBytes)")
    known = F.broadcast(states.withColumnsRenamed({"_key": "_k", "_block": "_b"}))
    both = lines.join(known, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    start = F.coalesce("_start", F.raise_error(F.lit("the splits of the files changed between two scans")).cast("boolean"))
    told = both.select("value", "_file", "_key", "_block", "_o", "_s", start.alias("_start"))
    return told.mapInArrow(_cut, "_file string, _block long, _mid long, _kind int, value string")


def joined_parts(parts: DataFrame) -> DataFrame:
    """The records that lie in several splits, from their parts: (_file, _block,
    _mid, value), placed where they begin."""
    order = Window.partitionBy("_file").orderBy("_block", "_mid").rowsBetween(Window.unboundedPreceding, 0)
    chains = parts.withColumn("_chain", F.sum(F.when(F.col("_kind") == TAIL, 1).otherwise(0)).over(order))
    whole = chains.groupBy("_file", "_chain").agg(F.min(F.struct("_block", "_mid")).alias("_at"),
                                                  F.sort_array(F.collect_list(F.struct("_block", "_mid", "value"))).alias("_p"))
    return whole.select("_file", "_at._block", "_at._mid", F.rtrim(F.array_join("_p.value", "\n"), F.lit("\r")).alias("value"))
