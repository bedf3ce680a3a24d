"""Operator 13: ranked lexical search over a length-stratified index.

A term of a document weighs ``w * ((10^9 tf) div (1000 tf + 8 m))``: w falls with the
number of documents that hold the term, m, the normaliser, grows with the document's
number of terms. Documents with equal m are a stratum, so that an impact depends on
the stratum and tf alone.

1. One scan counts the terms of every whole text: its length, and tf of those terms
   that the queries hold (``forward``). N, L and the document frequencies come from it.
2. Index: a row per stratum -- or per part of a stratum of more than ``PART`` postings
   -- with its posting lists, one per term and tf, best tf first (``index``).
3. Search: a list's impact is computed once. The best list of each term gives a bound
   for each query, and the rows are visited by falling bound until no bound reaches
   the query's k-th best score. A first round visits each task's best rows only; the
   k-th best scores over all tasks then hold as thresholds for the second.
4. What the tasks found is ranked by query.

Queries are taken in blocks of about ``QUERY_BYTES``; a block's terms and weights are
all that the driver holds. Scores are exact 64-bit integers.

Defined results: a null or empty text has no terms and is not found; a query without
terms finds nothing. Equal scores rank by doc_id, null last; rows that share a doc_id
are documents of their own. Query rows are queries of their own, a null or repeated id
too. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import staged, table

K, PART, QUERY_BYTES = 10, 2**17, 8 << 20
#: Strata of an index that are joined by broadcast (two numbers each).
STRATA = 2**20
#: Fixed values of the score.
BASE, SLOPE = 100 - 75, 75
NO_ID = 2**63 - 1
FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "m long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, places array<int>"
FOUND = "query long, doc_id long, score long"
#: Bytes that belong to terms; A-Z become a-z, all others a space.
_TERM = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b if b in _TERM else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): every document's number of terms, and how often it
    holds each term of the vocabulary that it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs, sizes = [], [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                had = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                n.append(len(words))
                sizes.append(len(had))
                terms += [t for t, _ in had]
                tfs += [c for _, c in had]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), _lists(np.array(terms, np.int32), sizes),
                                   _lists(np.array(tfs, np.int32), sizes)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, FORWARD)


def _stratum(group: pa.Table) -> pa.Table:
    """One row: posting lists by term, and by falling tf in a term."""
    lists = group.column("terms").combine_chunks()
    place = np.repeat(np.arange(len(group), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    term = lists.flatten().to_numpy()
    tf = group.column("tfs").combine_chunks().flatten().to_numpy()
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    last = np.flatnonzero(np.concatenate([(np.diff(term) != 0) | (np.diff(tf) != 0), [True]]))
    docs = group.column("doc_id").combine_chunks()
    return pa.table({"m": group.column("m")[:1], "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                     "terms": _lists(term[last], [len(last)]), "tfs": _lists(tf[last], [len(last)]),
                     "ends": _lists((last + 1).astype(np.int32), [len(last)]), "places": _lists(place, [len(place)])})


def index(counted: DataFrame, n_docs: int, n_terms: int, part: int = PART) -> DataFrame:
    """Forward rows -> index rows, of about ``part`` postings at most."""
    wide = F.col("n").cast("decimal(20,0)") * F.lit(SLOPE).cast("decimal(2,0)") * F.lit(n_docs).cast("decimal(15,0)")
    m = F.lit(BASE) + F.call_function("div", wide, F.lit(n_terms).cast("decimal(18,0)"))
    rows = counted.where(F.size("terms") > 0).withColumn("m", m.cast("long"))
    strata = staged(rows.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / part).alias("parts")), "rank-strata")
    known = strata.withColumnRenamed("m", "__m")
    known = F.broadcast(known) if strata.count() <= STRATA else known
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).join(known, F.col("m") == F.col("__m"))
    return dealt.withColumn("part", F.pmod("__at", "parts")).groupBy("m", "part").applyInArrow(_stratum, INDEX)


class Block:
    """Queries of a block: the terms of each (numbers of the vocabulary) and what a
    term's impact is multiplied by."""

    def __init__(self, queries: list[tuple[int, Counter]], vocabulary: dict[bytes, int], weights: np.ndarray):
        self.ids = [q for q, _ in queries]
        sizes = [len(c) for _, c in queries]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.terms = np.array([vocabulary[t] for _, c in queries for t in c], np.int64)
        self.times = np.array([n for _, c in queries for n in c.values()], np.int64) * weights[self.terms]
        self.vocabulary = len(vocabulary)


class Stratum:
    """An index row, opened for a block of queries."""

    def __init__(self, m: int, docs: pa.Array, terms, tfs, ends, places, block: Block):
        self.docs = docs
        self.ids = docs.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.places = places
        impact = (1_000_000_000 * tfs.astype(np.int64)) // (1000 * tfs.astype(np.int64) + 8 * m)
        first = np.flatnonzero(np.concatenate([[True], np.diff(terms) != 0]))
        at = np.full(block.vocabulary, -1, np.int64)
        at[terms[first]] = np.arange(len(first))
        self.of = at[block.terms]  # a query term's place among the terms here
        self.begin = np.concatenate([[0], ends])[first]
        self.end = np.concatenate([ends[first[1:] - 1], ends[-1:]])
        self.impact = np.repeat(impact, np.diff(np.concatenate([[0], ends])))
        best = np.where(self.of >= 0, impact[first][self.of], 0) * block.times
        self.bounds = np.add.reduceat(best, block.start[:-1])

    def scores(self, q: int, block: Block) -> np.ndarray:
        a, b = block.start[q], block.start[q + 1]
        here = np.flatnonzero(self.of[a:b] >= 0) + a
        of = self.of[here]
        cuts = list(zip(self.begin[of].tolist(), self.end[of].tolist(), block.times[here].tolist(), strict=True))
        place = np.concatenate([self.places[x:y] for x, y, _ in cuts])
        gain = np.concatenate([self.impact[x:y] * t for x, y, t in cuts])
        if self.bounds[q] < 2**53:  # sums of whole numbers, exact in doubles
            return np.bincount(place, gain, len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, place, gain)
        return out


def _visit(batches: Iterator[pa.RecordBatch], block: Block, least: np.ndarray, k: int, first_only: bool) -> Iterator[pa.RecordBatch]:
    """The k best documents of the task's rows for each query, by (-score, doc_id).
    ``least``: a score that each query's k-th best over all rows is known to reach."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(block.ids)
    least = least.copy()
    for batch in batches:
        cells = {c: batch.column(c) for c in ("docs", "terms", "tfs", "ends", "places")}
        rows = [Stratum(m, cells["docs"][i].values, *(cells[c][i].values.to_numpy() for c in ("terms", "tfs", "ends", "places")), block)
                for i, m in enumerate(batch.column("m").to_pylist())]
        if not rows:
            continue
        bounds = np.stack([r.bounds for r in rows])
        order = np.argsort(-bounds, axis=0, kind="stable")
        for q in range(len(block.ids)):
            for r in order[:1 if first_only else None, q].tolist():
                if bounds[r, q] < least[q]:
                    break
                score = rows[r].scores(q, block)
                sure = np.flatnonzero(score >= least[q])
                if not len(sure):
                    continue
                ids, score = np.concatenate([best[q][0], rows[r].ids[sure]]), np.concatenate([best[q][1], score[sure]])
                top = np.lexsort((ids, -score))[:k]
                best[q] = ids[top], score[top]
                if len(top) == k:
                    least[q] = max(least[q], score[top[-1]])
    for a in range(0, len(block.ids), 4096):
        some = range(a, min(a + 4096, len(block.ids)))
        ids = np.concatenate([best[q][0] for q in some])
        yield pa.record_batch([pa.array(np.repeat([block.ids[q] for q in some], [len(best[q][0]) for q in some]), pa.int64()),
                               pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([best[q][1] for q in some]), pa.int64())],
                              names=["query", "doc_id", "score"])


def _found(rows: DataFrame, block: Block, least: np.ndarray, k: int, first_only: bool) -> DataFrame:
    return rows.mapInArrow(lambda batches: _visit(batches, block, least, k, first_only), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, queries: list[tuple[int, Counter]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in queries))))}
    counted = staged(forward(docs, vocabulary), "rank-forward")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms
        held[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    block = Block(queries, vocabulary, weights)
    if not n_docs:
        return counted.sparkSession.createDataFrame([], FOUND)
    rows = staged(index(counted, n_docs, n_terms), "rank-index")
    least = np.ones(len(block.ids), np.int64)
    seeds = _ranked(_found(rows, block, least, k, True), k).where(F.col("rank") == k).select("query", "score").collect()  # a row a query
    at = {q: i for i, q in enumerate(block.ids)}
    for q, score in seeds:
        least[at[q]] = score
    return _found(rows, block, least, k, False)


def search(docs: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, text) queries against all of ``docs`` -> item_id, rank, doc_id, score."""
    asked = staged(queries.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "rank-queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text").collect()
        counted = [(q, Counter(terms_of(text))) for q, text in mine]
        if counted := [(q, c) for q, c in counted if c]:
            parts.append(staged(_search_block(docs, counted, k), "rank-found"))
    spark = docs.sparkSession
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)
    return _ranked(found, k).join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {terms} AS w FROM benchmark),
a AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w)) AS total FROM d),
q AS (SELECT i, t, count(*) AS qf FROM (SELECT i, unnest(w) AS t FROM b) GROUP BY i, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, a GROUP BY t, docs),
m AS (SELECT r, doc_id, {BASE} + (({SLOPE} * len(w) * docs) // CAST(total AS BIGINT)) AS m FROM d, a WHERE len(w) > 0),
s AS (
  SELECT q.i, m.r, m.doc_id, CAST(sum(qf * f.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN p ON p.t = q.t JOIN f ON f.t = q.t JOIN m ON m.r = p.r GROUP BY q.i, m.r, m.doc_id
), k AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b ON b.i = k.i WHERE rank <= {K}"""
