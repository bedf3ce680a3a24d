"""Operator 1: approximate nearest neighbours by inner product, hierarchical k-means
tree with best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_MB`` at most) by
splitting nodes with k-means into ``BRANCHES`` children until a leaf holds about
``LEAF`` rows; every row is then put into its leaf. A query walks the tree through a
priority queue of children, best inner product with their centres first, and visits
the leaves in the order in which they come off. How many is calibrated: for
``CALIBRATION`` rows the exact neighbours over all rows are found, and leaf visits
widen until their mean recall reaches ``RECALL``; visits go on, in any case, until the
leaves hold enough rows.

Rows with equal vectors are one entry with their smallest ids (as many as a result
can show), so a vector that a third of all rows share weighs like any other. Leaves
are dealt into buckets of about ``BUCKET`` rows; a leaf above that is cut into
several, and a bucket that many queries visit is copied for parts of them. A query
goes once to each bucket with the leaves that it visits there.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without id, nor vectors whose length is not the
most frequent one (of equally frequent ones, the smallest). Of rows with equal id the
smallest vector counts. Scores are inner products in double precision; ties go to the
smaller id. With fewer candidates than k, all are given. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import staged, table

K, EVERY = 20, 20
SAMPLE, SAMPLE_MB, BRANCHES, LEAF, CALIBRATION, RECALL = 16384, 32, 16, 100, 256, 0.97
BUCKET, QUERIES, SEED = 16384, 32768, 5
#: Found rows that a task gathers before it keeps each query's best.
MERGED = 2**20


class Tree:
    """Nodes with the centres of their children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # centres, child (node number, or -1 - leaf)
        self.leaves = 0
        rng = np.random.default_rng(SEED)
        self.root = self._grow(sample, rows / max(len(sample), 1), rng)

    def _grow(self, x: np.ndarray, weight: float, rng) -> int:
        if len(x) * weight <= LEAF or len(x) < 16:
            self.leaves += 1
            return -self.leaves
        k = int(min(BRANCHES, max(2, np.ceil(len(x) * weight / LEAF))))
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            near = _nearest(x, centres)
            centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        near = _nearest(x, centres)
        parts = [j for j in range(k) if (near == j).any()]
        if len(parts) < 2:
            self.leaves += 1
            return -self.leaves
        me = len(self.nodes)
        self.nodes.append((centres[parts], []))
        self.nodes[me][1].extend(self._grow(x[near == j], weight, rng) for j in parts)
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: nearest centre at each node."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                centres, children = self.nodes[node]
                near = _nearest(x[rows], centres)
                todo += [(c, rows[near == j]) for j, c in enumerate(children)]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves off the priority queue, best inner product first."""
        queue, n = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            centres, children = self.nodes[node]
            for score, child in zip((-(centres @ q)).tolist(), children, strict=True):
                heapq.heappush(queue, (score, n, child))
                n += 1

    def visits(self, q: np.ndarray, least: int, held: np.ndarray, enough: int) -> list[int]:
        out, rows = [], 0
        for leaf in self.best_first(q):
            out.append(leaf)
            rows += held[leaf]
            if len(out) >= least and rows >= enough:
                break
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed alike wherever it stands."""
    return np.einsum("ij,ij->i", q, x)


def usable(v: Column) -> Column:
    return (v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
            & F.exists(v, lambda x: x != 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(id, v) -> distinct vectors: rep (smallest id), ids (the smallest k + 1), v."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("__n") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def _top(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[np.ndarray]:
    """Of (query, id, score) arrays, the best k of each query."""
    q, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return [z[place < k] for z in (q, i, s)]


def _pairs(q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int):
    """The best k + 1 ids of rows x for each query, before merging."""
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    offsets = offsets - offsets[0]
    rough = q @ x.T
    some = min(k + 1, x.shape[0])
    # Rows within twice the rounding error of the (k + 1)-th best may be among the best.
    error = 4 * x.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.sqrt((x * x).sum(axis=1).max(initial=0))
    least = -np.partition(-rough, some - 1, axis=1)[:, some - 1] - 2 * error
    who, row = np.nonzero(rough >= least[:, None])
    score = _exact(q[who], x[row])
    # An entry's first id is its smallest: more entries than k + 1 by score and id cannot count.
    smallest = values[ids.offsets[0].as_py() + offsets[row]]
    order = np.lexsort((smallest, -score, who))
    who, row, score = who[order], row[order], score[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1])
    kept = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate([first, [len(who)]]))) <= k
    who, row, score = who[kept], row[kept], score[kept]
    n = (offsets[1:] - offsets[:-1])[row]
    each = np.repeat(np.arange(len(row)), n)
    inside = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    return who[each], values[ids.offsets[0].as_py() + offsets[row[each]] + inside], score[each]


def search(vectors: DataFrame, queries: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(id, v) -> for the ids that satisfy ``queries`` (an expression of ``id``): query_id,
    rank, vec_id, score of the k nearest found."""
    spark = vectors.sparkSession
    v = F.col("v").cast("array<double>")
    clean = vectors.where(F.col("id").isNotNull() & usable(v)).groupBy("id").agg(F.min(v).alias("v"))
    clean = staged(clean, "ann-vectors")
    size = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], result)
    dim = size.n
    clean = clean.where(F.size("v") == dim)
    found = staged(entries(clean, k), "ann-entries")
    n = found.count()
    limit = max(64, min(SAMPLE, SAMPLE_MB * 2**20 // (8 * dim)))
    some = found.orderBy(F.xxhash64("rep")).limit(limit).select("v").toArrow()
    tree = Tree(_matrix(some["v"], dim), n)
    # The tree travels with the functions below; the sample bounds its size.

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(2), dim))
            yield pa.record_batch([pa.array(leaf), *batch.columns], names=["leaf", "rep", "ids", "v"])

    placed = staged(found.mapInArrow(place, "leaf long, rep long, ids array<long>, v array<double>"), "ann-leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row per leaf
        held[r.leaf] = r["count"]

    # Calibration: exact neighbours of some rows, and the place of their leaves in the queue's order.
    tried = _matrix(found.orderBy(F.xxhash64(F.lit(SEED), "rep")).limit(CALIBRATION).select("v").toArrow()["v"], dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                leaf, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                score = tried @ x.T
                pick = np.argsort(-score, axis=1)[:, :k]
                q = np.repeat(np.arange(len(tried)), pick.shape[1])
                got = (q, leaf[pick.ravel()], np.take_along_axis(score, pick, axis=1).ravel())
                best = _top([got] if best is None else [got, tuple(best)], k)
        if best is not None:
            yield pa.record_batch([pa.array(z) for z in best], names=["q", "leaf", "score"])

    exact = placed.select("leaf", "v").mapInArrow(nearest, "q long, leaf long, score double")
    place_of = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    truth = exact.withColumn("__n", place_of).where(F.col("__n") <= k).select("q", "leaf").collect()  # CALIBRATION * k rows
    order = [{leaf: i for i, leaf in enumerate(tree.best_first(q))} for q in tried]
    needed = np.sort([order[r.q][r.leaf] for r in truth]) + 1
    least = int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * recall)) - 1)])

    # Buckets: neighbouring leaves together, large leaves apart in pieces.
    bucket_of, pieces_of, bucket, filled = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for leaf, rows in enumerate(held.tolist()):
        pieces = max(1, -(-rows // BUCKET))
        if filled and filled + rows > BUCKET:
            bucket, filled = bucket + 1, 0
        bucket_of[leaf], pieces_of[leaf] = bucket, pieces
        filled += rows
        if pieces > 1:
            bucket, filled = bucket + pieces, 0

    chosen = clean.where(queries).join(found.select(F.col("v").alias("__v"), "rep"), F.col("v") == F.col("__v")).select("id", "rep")
    asked = staged(chosen, "ann-queries")
    asking = found.join(asked.select(F.col("rep").alias("__r")).distinct(), F.col("rep") == F.col("__r"), "left_semi")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"bucket": [], "q": [], "leaves": [], "v": []}
            for q, own in zip(_matrix(batch.column(1), dim), batch.column(0).to_pylist(), strict=True):
                visits: dict[int, list[int]] = {}
                for leaf in tree.visits(q, least, held, k + 1):
                    for piece in range(pieces_of[leaf]):
                        visits.setdefault(int(bucket_of[leaf]) + piece, []).append(leaf)
                for b, leaves in visits.items():
                    for name, x in zip(out, (b, own, leaves, q), strict=True):
                        out[name].append(x)
            yield pa.record_batch([pa.array(out["bucket"], pa.int64()), pa.array(out["q"], pa.int64()),
                                   pa.array(out["leaves"], pa.list_(pa.int64())), pa.array(out["v"], pa.list_(pa.float64()))], names=list(out))

    routed = staged(asking.select("rep", "v").mapInArrow(route, "bucket long, q long, leaves array<long>, v array<double>"), "ann-routes")
    parts = staged(routed.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), "ann-parts")
    left = routed.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("q"), "parts"))
    first = F.element_at(F.lit(bucket_of), (F.col("leaf") + 1).cast("int"))
    spread = F.element_at(F.lit(pieces_of), (F.col("leaf") + 1).cast("int"))
    dealt = placed.withColumn("bucket", first + F.pmod(F.xxhash64("rep"), spread))
    right = dealt.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        leaf = rows["leaf"].to_numpy()
        rows = rows.take(np.argsort(leaf, kind="stable")).combine_chunks()
        leaf = rows["leaf"].to_numpy()
        x, ids = _matrix(rows["v"], dim), rows["ids"].combine_chunks()
        found, held_rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        q, names = _matrix(asked["v"], dim), asked["q"].to_numpy()
        lists = asked["leaves"].combine_chunks()
        owner = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten().to_numpy()
        for one in np.unique(leaf):
            a, b = np.searchsorted(leaf, [one, one + 1])
            mine = owner[wanted == one]
            for s in range(0, len(mine), 2048):
                who, i, score = _pairs(q[mine[s:s + 2048]], x[a:b], ids.slice(a, b - a), k)
                found.append((mine[s + who], i, score))
                held_rows += len(i)
                if held_rows > MERGED:  # the best so far and what came since
                    found = [tuple(_top(found, k + 1))]
                    held_rows = len(found[0][0]) // 2
        best = _top(found, k + 1)
        return pa.table({"q": names[best[0]], "vec_id": best[1], "score": best[2]})

    columns = ["bucket", "part", "q", "leaves", "v"]
    met = left.select(*columns).groupBy("bucket", "part").cogroup(
        right.select("bucket", "part", "leaf", "ids", "v").groupBy("bucket", "part")).applyInArrow(
        meet, "q long, vec_id long, score double")
    nearness = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = staged(met.withColumn("__n", F.row_number().over(nearness)).where(F.col("__n") <= k + 1).drop("__n"), "ann-best")
    shown = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("__r")).join(best, F.col("__r") == F.col("q"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (shown.where("vec_id != query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(vectors, F.col("id") % EVERY == 0)
