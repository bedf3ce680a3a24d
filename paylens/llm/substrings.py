"""Operator 6: substring dedup by seed and extend.

Seeds are winnowed anchors: of the word 5-grams of each window of 13 words, the one
with the smallest hash (``runs``). Documents meet on equal anchors; the match is
extended from the anchor to the left and to the right, word by word, with every
earlier document that has it, and what stays at ``WINDOW`` or more words is a
repeat. Repeats of neighbouring anchors join to maximal ones on the text.

A word is removed where a repeat with a document of smaller id covers it; repeats
are judged on the texts as given, so the smallest document keeps its copy.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words
stay. Words are compared as they are. Rows with equal doc_id do not repeat each
other; a null doc_id comes after all others. Extra columns pass through, and ones
named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import table
from paylens.llm.runs import covered, repeats

WINDOW, GRAM = 13, 5
RESULTS = ["n_words", "n_removed", "kept_text", "removed"]


def word_hashes(data: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = data.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def around(data: bytes):
    words = data.split()
    return lambda start, place, end: (b" ".join(words[start:place]), b" ".join(words[place:end]))


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extend(members: list[tuple], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """Occurrences (d, place, left, right, left words) of an anchor, by document ->
    (occurrence, offset, windows) that repeat a smaller document's words."""
    split = [(left.split()[::-1], right.split()) for _, _, left, right, _ in members]
    for i, (d, _, _, _, first) in enumerate(members):
        found = set()
        for j in range(i):
            if members[j][0] < d:
                left, right = _common(split[i][0], split[j][0]), _common(split[i][1], split[j][1])
                if left + right >= window:
                    found.add((left, max(window - right, 0)))
        for most, least in found:
            yield i, first - most, most - least + 1


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by a space) and
    removed (array of the removed runs of words: start, end)."""
    docs = docs.drop(*RESULTS)
    spans = repeats(docs, word_hashes, window, gram, False, around, lambda m: extend(m, window))

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_text: string, removed: array<struct<start: bigint, end: bigint>>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            rows = []
            for text, place in zip(texts, places, strict=True):
                data = (text.as_py() or "").encode()
                words = data.split()
                if not place.is_valid:
                    rows.append({"n_words": len(words), "n_removed": 0, "kept_text": b" ".join(words).decode(), "removed": []})
                    continue
                gone = covered(place.values.to_numpy(), len(words), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                rows.append({"n_words": len(words), "n_removed": int(gone.sum()),
                             "kept_text": b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode(),
                             "removed": [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]})
            yield pa.array(rows, cut_type)

    cut_type = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                          ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    done = spans.withColumn("__cut", cut(F.col("text"), F.col("__spans"))).drop("__spans")
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__cut.{c}") for c in RESULTS])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sql() -> str:
    return r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)
), f AS (
  SELECT s, min(doc_id) AS d FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM (SELECT r, p FROM g JOIN f ON g.s = f.s AND g.doc_id > f.d)
), kept AS (
  SELECT u.r, string_agg(u.x, ' ' ORDER BY u.p) AS t, count(*) AS n
  FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) u LEFT JOIN gone ON gone.r = u.r AND gone.p = u.p
  WHERE gone.r IS NULL GROUP BY u.r
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r"""
