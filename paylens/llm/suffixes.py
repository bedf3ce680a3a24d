"""Operator 9: suffix-array dedup with a common-prefix interval tree, over bytes.

The suffix array is sparse: of the 20-byte grams of each window of 100 bytes, the
one with the smallest hash begins a suffix that is taken (``runs``), so that each
window holds the start of a taken suffix, and equal windows hold it at equal
places. Equal stretches around a suffix are collapsed first. The suffixes that
share an anchor are sorted with their common-prefix lengths (an enhanced suffix
array of that shard). A stack scan gives the intervals of the prefix tree; within
each, the bytes to the left, sorted backwards and scanned alike, give the groups
whose occurrences agree that far and then differ: left-diverse, hence maximal
repeats, each with all its occurrences, not only neighbours in the array.

Of each group with a string of ``WINDOW`` bytes or more, all occurrences but the
first (smallest doc_id, then start) are removed; repeats are judged on the texts
as given.

Defined results: a null text is empty; shorter texts than ``WINDOW`` stay. Matches
do not cross documents. Of rows with equal doc_id and unlike texts, neither is
earlier; equal rows are treated alike. A null doc_id comes last. What is left of a
text may not be UTF-8, so it is binary. Extra columns pass through, and ones named
like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import table
from paylens.llm.runs import BASE, covered, mixed, repeats

WINDOW, GRAM = 100, 20
RESULTS = ["n_bytes", "n_removed", "kept_bytes", "removed"]


def byte_hashes(data: bytes) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    return values[np.frombuffer(data, np.uint8)]


def around(data: bytes):
    return lambda start, place, end: (data[start:place], data[place:end])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of the prefix lengths of neighbours in sorted order: (length, first,
    last) of each interval of the prefix tree."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*shared, -1]):
        low = i
        while stack and stack[-1][0] > v:
            length, low = stack.pop()
            yield length, low, i
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, low))


def tree(strings: list[bytes], members: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(prefix length, members) for each interval of the members' sorted strings."""
    order = sorted(members, key=strings.__getitem__)
    shared = [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    for length, a, b in intervals(shared):
        yield length, order[a:b + 1]


def extend(members: list[tuple], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """Occurrences (d, place, left, right, left bytes) of an anchor, in order ->
    (occurrence, offset, windows) that repeat an earlier one."""
    right = [m[3] for m in members]
    back = [m[2][::-1] for m in members]
    found = set()
    for length, here in tree(right, list(range(len(members)))):
        need = max(window - length, 0)
        for most, group in tree(back, here):
            if most < need:
                continue
            group = sorted(group)
            d, starts = members[group[0]][0], {}
            for i in group:
                place = members[i][1]  # equal rows have equal places
                if members[i][0] > d or starts.setdefault(place >> 32, place) < place:
                    found.add((i, members[i][4] - most, most - need + 1))
    yield from sorted(found)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_bytes, n_removed, kept_bytes and removed (array of the maximal
    removed runs of bytes: start, end)."""
    docs = docs.drop(*RESULTS)
    spans = repeats(docs, byte_hashes, window, gram, True, around, lambda m: extend(m, window))

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, kept_bytes: binary, removed: array<struct<start: bigint, end: bigint>>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            rows = []
            for text, place in zip(texts, places, strict=True):
                data = (text.as_py() or "").encode()
                if not place.is_valid:
                    rows.append({"n_bytes": len(data), "n_removed": 0, "kept_bytes": data, "removed": []})
                    continue
                gone = covered(place.values.to_numpy(), len(data), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                rows.append({"n_bytes": len(data), "n_removed": int(gone.sum()),
                             "kept_bytes": np.frombuffer(data, np.uint8)[~gone].tobytes(),
                             "removed": [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]})
            yield pa.array(rows, cut_type)

    cut_type = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_bytes", pa.binary()),
                          ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    done = spans.withColumn("__cut", cut(F.col("text"), F.col("__spans"))).drop("__spans")
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__cut.{c}") for c in RESULTS])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                                        F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op9_sql() -> str:
    """Every window of 100 bytes by its MD5; pieces of 199 bytes keep the slicing linear."""
    return r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT r, d, c, n, substring(h, CAST(2 * c + 1 AS BIGINT), 398) AS part
  FROM (SELECT r, d, h, length(h) // 2 - 99 AS n, unnest(range(0, length(h) // 2 - 99, 100)) AS c FROM t WHERE length(h) >= 200)
), w AS (
  SELECT r, d, c + o AS p, md5(substring(part, CAST(2 * o + 1 AS BIGINT), 200)) AS k
  FROM (SELECT r, d, c, part, unnest(range(0, least(100, n - c))) AS o FROM c)
), f AS (
  SELECT k, min(d) AS d FROM w GROUP BY k HAVING count(*) > 1
), e AS (
  SELECT w.r, min(w.p) AS p, w.k FROM w JOIN f ON f.k = w.k AND f.d = w.d GROUP BY w.r, w.k
), s AS (
  SELECT w.r, w.p FROM w JOIN f ON f.k = w.k LEFT JOIN e ON e.r = w.r AND e.k = w.k WHERE w.d > f.d OR w.p > e.p
), i AS (
  SELECT r, p, sum(CASE WHEN p <= q + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS island
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM s)
), spans AS (
  SELECT r, island, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY r, island
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY r ORDER BY a) AS nxt FROM spans
), cut AS (
  SELECT g.r, sum(b - a) AS gone, count(*) AS n,
         string_agg(substring(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a)
         || any_value(substring(h, CAST(2 * last_b + 1 AS BIGINT))) AS kept
  FROM (SELECT *, max(b) OVER (PARTITION BY r) AS last_b FROM gaps) g JOIN t ON t.r = g.r GROUP BY g.r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN cut ON cut.r = t.r"""
