"""Repeated windows of documents, found through anchors.

A text is a sequence of units (words, or bytes). Of the k-grams of a window of W
units, the one with the smallest hash is the window's anchor (leftmost of equals):
it depends on the window's content alone. Neighbouring windows with one anchor
occurrence form a *run*; equal windows lie in runs with equal anchors, at equal
offsets.

1. Each document gives a row per run: anchor, hash of the run's whole content,
   document, place. Tasks collapse equal runs before the shuffle.
2. Runs meet by anchor. Equal runs settle each other: all but the first are
   repeats as a whole. Runs whose anchor also has runs of another content are
   left open (at the ends of repeats, and for anchors that recur by chance).
3. Open runs go back to their documents for their content, meet again by anchor,
   and ``extend`` tells how far each repeats an earlier one. Where an anchor has
   more than ``HOT`` open runs, these are cut into single windows instead, which
   meet by content, so that no anchor gathers in one task.
4. The repeats of a document are put together on its text.

Texts are shuffled once (both joins read one exchange). Texts and runs are keyed by
doc_id and 64 bits of the text's hash, so that a null or repeated doc_id is no group;
doc_id alone tells which is earlier. Rows that are equal in both share one set of
places. Places are packed: the first unit, and 7 bits of the number of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import ordering_id, staged

HOT = 64
#: Runs that a task gathers before it collapses equal ones.
GATHERED = 2**19
#: Rows of a batch that goes back to the JVM.
SENT = 2**16
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2**17)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)])) for b in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def anchored_runs(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Unit hashes -> (anchor, content, start, windows, place of the anchor) of each run."""
    n, parts = len(h), []
    step = 2**22
    for a in range(0, max(n - window + 1, 0), step):
        parts.append(_runs(h[a:a + step + window - 1], window, gram, a))
    if not parts:
        return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(h: np.ndarray, window: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    n = len(h)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(h * power[:n], out=total[1:])
    grams = mixed((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    low = U(2**23 - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=U)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[:have - width], best[width - have:])
    place = (best & low).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    end = np.concatenate([start[1:], [len(place)]])
    place = place[start]
    content = (total[end + window - 1] - total[start]) * inverse[start]
    content = mixed(content ^ mixed(((place - start) * 128 + (end - start)).astype(U)))
    return grams[place], content, start + base, end - start, place + base


def packed(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start << 7) | (windows - 1)


def unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows of the spans."""
    return span >> 7, (span & 127) + 1


FIELDS = ["key", "content", "d", "t", "span", "done"]
RUN_SCHEMA = "key long, content long, d long, t long, span long, done boolean"


def settle(key, content, d, t, span, done, by_place: bool):
    """Sorted columns with ``done`` set for each run that repeats an earlier one of
    equal content: of a smaller document or, ``by_place``, of the same text too."""
    order = np.lexsort((span, t, d, content, key))
    key, content, d, t, span, done = (x[order] for x in (key, content, d, t, span, done))
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    done = done | (same & (d > d[first]))
    if by_place:
        again = same & np.concatenate([[False], (d[1:] == d[:-1]) & (t[1:] == t[:-1])])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
        done = done | (again & (span >> 7 > span[first] >> 7))  # equal rows have equal places
    return key, content, d, t, span, done


class Gather:
    """Runs of a task, given out with equal ones collapsed; settled runs travel by
    document instead of by anchor."""

    def __init__(self, by_place: bool):
        self.by_place, self.parts, self.size = by_place, [], 0

    def add(self, key, content, d: int, t: int, span) -> None:
        self.parts.append((key.view(np.int64), content.view(np.int64), np.full(len(key), d), np.full(len(key), t), span))
        self.size += len(key)

    def flush(self) -> Iterator[tuple]:
        if self.size:
            cols = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            key, content, d, t, span, done = settle(*cols, np.zeros(self.size, bool), self.by_place)
            away = mixed((d * 31 + t + (span >> 7)).view(U)).view(np.int64)
            yield np.where(done, away, key), np.where(done, 0, content), d, t, span, done
        self.parts, self.size = [], 0


def _sent(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded size."""
    whole = pa.record_batch(columns, names=names)
    for a in range(0, whole.num_rows, SENT):
        yield whole.slice(a, SENT)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """All rows of a partition as arrays (its size is the shuffle partition's)."""
    parts = list(batches)
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in parts]) if parts else np.zeros(0, np.int64)
            for n in names]


def repeats(docs: DataFrame, hashes: Callable, window: int, gram: int, by_place: bool, content_of: Callable,
            extend: Callable) -> DataFrame:
    """``docs`` with ``__spans``: packed places of the windows that repeat an earlier
    one, over the whole table, of the row's text.

    ``hashes(bytes)`` gives the unit hashes of a text, ``content_of(bytes)`` a
    function (start, place, end) -> (left, right) contents around an anchor, and
    ``extend(list of (d, place, left, right, first))`` the (row, offset, windows) that
    repeat; ``first`` is the number of units on the left, place >> 32 the text's hash."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__d", ordering_id()).withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(by_place)
        for batch in batches:
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                h = hashes(data)
                if len(h) < window:
                    continue
                key, content, start, windows, _ = anchored_runs(h, window, gram)
                gather.add(key, content, d, t, packed(start, windows))
                if gather.size >= GATHERED:
                    for x in gather.flush():
                        yield from _sent(list(x), FIELDS)
        for x in gather.flush():
            yield from _sent(list(x), FIELDS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, content, d, t, span, done = _columns(batches, FIELDS)
        if not len(key):
            return
        names, old = ["d", "t", "span", "open"], done.astype(bool)
        new = ~old
        k, c, e, f, s, settled = settle(key[new], content[new], d[new], t[new], span[new], old[new], by_place)
        yield from _sent([d[old], t[old], span[old], np.full(old.sum(), 0)], names)
        yield from _sent([e[settled], f[settled], s[settled], np.full(settled.sum(), 0)], names)
        k, c, e, f, s = (x[~settled] for x in (k, c, e, f, s))
        if not len(k):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
        size = np.diff(np.concatenate([starts, [len(k)]]))
        group = np.repeat(np.arange(len(starts)), size)
        other = c if by_place else e
        several = np.zeros(len(starts), bool)
        several[group[1:][(group[1:] == group[:-1]) & (other[1:] != other[:-1])]] = True
        pick = several[group]
        yield from _sent([e[pick], f[pick], s[pick], np.where(size[group[pick]] > HOT, 2, 1)], names)

    found = keyed.select("__d", "__t", "text").mapInArrow(seeds, RUN_SCHEMA).repartition(n, "key")
    met = staged(found.mapInArrow(meet, "d long, t long, span long, open long"), "runs-met")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*FIELDS, "left", "right", "first"]
        gather = Gather(by_place)

        def windows_out() -> Iterator[pa.RecordBatch]:
            for x in gather.flush():
                none = pa.nulls(len(x[0]), pa.binary())
                yield from _sent([*x, none, none, pa.nulls(len(x[0]), pa.int64())], names)

        rows: list[tuple] = []
        types = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.binary(), pa.int64()]

        def contents_out() -> Iterator[pa.RecordBatch]:
            if rows:
                yield from _sent([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows.clear()

        for batch in batches:
            for d, t, text, spans, hot in zip(*(batch.column(i) for i in range(5)), strict=True):
                d, t, data = d.as_py(), t.as_py(), (text.as_py() or "").encode()
                h = hashes(data)
                if len(h) < window:
                    continue
                key, _, start, windows, place = anchored_runs(h, window, gram)
                at, _ = unpacked(spans.values.to_numpy())
                cold = ~hot.values.to_numpy(zero_copy_only=False).astype(bool)
                i = np.searchsorted(start, at)
                content = content_of(data)
                for j in i[cold]:
                    left, right = content(start[j], place[j], start[j] + windows[j] - 1 + window)
                    rows.append((int(key[j].view(np.int64)), 0, d, t, int(packed(start[j], windows[j])), False, left, right,
                                 int(place[j] - start[j])))
                if (~cold).any():
                    single = np.concatenate([np.arange(start[j], start[j] + windows[j]) for j in i[~cold]])
                    power, inverse = _powers(len(h))
                    total = np.zeros(len(h) + 1, U)
                    np.cumsum(h * power[:len(h)], out=total[1:])
                    whole = (total[single + window] - total[single]) * inverse[single]
                    second = h ^ U(0x5851F42D4C957F2D)
                    np.cumsum(mixed(second) * power[:len(h)], out=total[1:])
                    again = (total[single + window] - total[single]) * inverse[single]
                    gather.add(mixed(whole), mixed(again), d, t, packed(single, np.ones(len(single), np.int64)))
                    if gather.size >= GATHERED:
                        yield from windows_out()
                if len(rows) >= SENT:
                    yield from contents_out()
        yield from contents_out()
        yield from windows_out()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        single = whole.filter(whole["left"].is_null())
        key, content, d, t, span, done = (single[n].to_numpy() for n in FIELDS)
        key, content, d, t, span, done = settle(key, content, d, t, span, done.astype(bool), by_place)
        yield from _sent([d[done], t[done], span[done]], ["d", "t", "span"])
        rest = whole.filter(whole["left"].is_valid()).sort_by([(x, "ascending") for x in ("key", "d", "t", "span")])
        key = rest["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        d, t, span, left, right, first = (rest[n].to_pylist() for n in ("d", "t", "span", "left", "right", "first"))
        out_d, out_t, out_span = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            members = [(d[i], (t[i] << 32) | (span[i] >> 7), left[i], right[i], first[i]) for i in range(a, b)]
            for i, offset, windows in extend(members):
                out_d.append(d[a + i])
                out_t.append(t[a + i])
                out_span.append((span[a + i] & ~0x7F) + (offset << 7) + windows - 1)
        yield from _sent([pa.array(x, pa.int64()) for x in (out_d, out_t, out_span)], ["d", "t", "span"])

    texts = keyed.repartition(n, "__d", "__t")
    of_text, here = (F.col("d").alias("__o"), F.col("t").alias("__u")), (F.col("__d") == F.col("__o")) & (F.col("__t") == F.col("__u"))
    # Sets: equal rows of one doc_id give equal places, which are wanted once.
    is_open = met.where("open > 0").groupBy(*of_text).agg(
        F.collect_set(F.struct("span", (F.col("open") == 2).alias("hot"))).alias("__open"))
    # All columns, so that both joins read one exchange of the texts.
    asked = texts.join(is_open, here).select(
        "__d", "__t", "text", F.col("__open.span").alias("spans"), F.col("__open.hot").alias("hot"),
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    fields = f"{RUN_SCHEMA}, left binary, right binary, first long"
    extended = asked.mapInArrow(fetch, fields).repartition(n, "key").mapInArrow(finish, "d long, t long, span long")
    spans = met.where("open = 0").select("d", "t", "span").union(extended).groupBy(*of_text).agg(
        F.collect_set("span").alias("__spans"))
    return texts.join(spans, here, "left").drop("__d", "__t", "__o", "__u")


def covered(spans: np.ndarray | None, n: int, window: int) -> np.ndarray:
    """Which of a text's n units lie in a repeated window."""
    change = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        start, windows = unpacked(spans)
        np.add.at(change, start, 1)
        np.add.at(change, start + windows - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0
