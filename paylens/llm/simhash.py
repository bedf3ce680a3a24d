"""Operator 7: SimHash near-duplicates by vantage-point trees, exact.

Fingerprint bit i is 1 if it is set in over half of a text's shingle hashes. Two
fingerprints link at ``distance`` or fewer differing bits. Distinct fingerprints
are cut into ``SEGMENTS`` segments; of two linked ones, at least one segment
differs in distance // SEGMENTS bits or fewer. Each segment has a vantage-point
tree over Hamming distance: a level has one vantage point (of a bounded sample)
and its median radius, shared by the level's nodes, and a fingerprint falls
inside or outside. By the triangle bound a link crosses a sphere only from the
shell that is no wider than the segment's radius, so a fingerprint of that shell
visits the inner branch as well. Leaves, the shards of the search, therefore hold
every link whole; the depth grows with the number of fingerprints.

Inside a leaf, fingerprints are ordered by distance to a vantage point, blocks are
compared only within the triangle bound of ``distance``, and the found links are
merged at once: a leaf gives a star for each class, never its pairs. A leaf of more
than ``TILE`` rows (a dense group) is worked as tiles, each pair of tiles a group
of its own. Stars are joined to components by alternating large and small stars.

Defined results: lower-casing is A-Z only. A null text, and one without words, has
fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Rows with equal id are documents of their own; a
component's id is its smallest id (null only if all are null). An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from paylens.llm.common import staged, table

SHINGLE, DISTANCE, SEGMENTS = 4, 4, 3
#: Fingerprints a leaf aims at, rows a group holds at most (twice), size of the sample
#: that vantage points and radii come from.
LEAF, TILE, SAMPLE, SEED = 256, 4096, 4096, 7
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)),
                             np.uint64, len(words) - shingle + 1)
    set_bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[a:a + 65536]).view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fingerprint`` (long)."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(x.as_py(), shingle) for x in batch], pa.int64())

    return docs.withColumn("fingerprint", run(F.col(text)))


def _segments(n: int) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _forest(sample: np.ndarray, levels: int, segments: int) -> list[list[tuple[int, int]]]:
    """For each segment, the levels' vantage points and median radii."""
    rng = np.random.default_rng(SEED)
    out = []
    for shift, width in _segments(segments):
        values = (sample >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        points = rng.choice(np.unique(values), size=levels, replace=levels > len(np.unique(values))) if levels else []
        out.append([(int(v), int(np.median(np.bitwise_count(values ^ v)))) for v in points])
    return out


def _routed(prints: DataFrame, forest, segments: int, distance: int) -> DataFrame:
    """(leaf, fingerprint): the leaves that each fingerprint lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = distance // segments
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s, (shift, width) in enumerate(_segments(segments)):
                own = np.arange(len(whole))
                leaf = np.zeros(len(whole), np.int64)
                value = (whole >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                for point, radius in forest[s]:
                    d = np.bitwise_count(value[own] ^ np.uint64(point)).astype(np.int64)
                    both = np.flatnonzero((d > radius) & (d <= radius + reach))
                    leaf = np.concatenate([leaf * 2 + (d > radius), leaf[both] * 2])
                    own = np.concatenate([own, own[both]])
                yield pa.record_batch([pa.array(leaf * segments + s), pa.array(whole[own].view(np.int64))],
                                      names=["leaf", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, "leaf long, fingerprint long")


def leaf_classes(prints: np.ndarray, distance: int, block: int = 256) -> np.ndarray:
    """For distinct fingerprints, the position of each one's class representative
    (the smallest print) under links within these."""
    first = np.bitwise_count(prints ^ prints[0])
    order = np.argsort(first, kind="stable")
    prints, first = prints[order], first[order].astype(np.int64)
    label = np.arange(len(prints))
    for a in range(0, len(prints), block):
        b = min(a + block, len(prints))
        # Sorted by distance to a vantage point: beyond its triangle bound nothing links.
        end = np.searchsorted(first, first[b - 1] + distance, side="right")
        i, j = np.nonzero(np.bitwise_count(prints[a:b, None] ^ prints[None, a:end]) <= distance)
        i, j = label[i + a], label[j + a]
        while len(keep := np.flatnonzero(i != j)):
            i, j = i[keep], j[keep]
            root = np.arange(len(prints))
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
            label, i, j = root[label], root[i], root[j]
    smallest = np.full(len(prints), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, prints.view(np.int64))
    out = np.empty(len(prints), np.int64)
    out[order] = smallest[label]
    return out


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Distinct fingerprints -> stars (u, v): u links, over links of its leaf, to
    the smaller v. Their connected components are those of all links."""
    n = prints.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    some = prints.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).toPandas()["fingerprint"].to_numpy(np.int64)
    forest = _forest(some.view(np.uint64), levels, segments) if n else [[] for _ in range(segments)]
    routed = staged(_routed(prints, forest, segments, distance), "simhash-leaves")
    large = staged(routed.groupBy("leaf").count().where(F.col("count") > TILE).select(
        "leaf", F.ceil(F.col("count") / TILE).alias("k")), "simhash-large")
    tiled = routed.join(large, "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long")))
    mine = tiled.withColumn("t", F.pmod(F.xxhash64("fingerprint"), "k"))
    other = mine.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    parts = other.select("leaf", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fingerprint")

    def run(rows: pa.Table) -> pa.Table:
        own = np.unique(rows.column("fingerprint").to_numpy())
        root = leaf_classes(own.view(np.uint64), distance)
        far = own != root
        return pa.table({"u": own[far], "v": root[far]})

    return parts.groupBy("leaf", "a", "b").applyInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v -> (u, root): the smallest node of each node's component,
    for nodes that are not that themselves. Large and small stars alternate until
    the edges are stable; each round's edges are written to the shared folder."""

    def star(directed: DataFrame, pick) -> DataFrame:
        least = staged(directed.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m")), "star")
        near = directed.join(least, F.col("u") == F.col("__u"))
        return pick(near.withColumn("m", F.least("u", "__m")))

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = staged(edges, "edges")
    seen = total(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, lambda x: x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = staged(large.distinct(), "edges")
        small = star(large, lambda x: x.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            x.select("u", F.col("m").alias("v"))).where("u != v"))
        edges = staged(small.distinct(), "edges")
        now = total(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))


def with_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, ...) -> the same with ``component_id``. ``prints`` is
    read several times: give it staged."""
    groups = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = staged(components(links(groups.select("fingerprint"), distance)), "simhash-roots")
    joined = staged(groups.join(roots, groups["fingerprint"] == roots["u"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "simhash-joined")
    ids = staged(joined.groupBy(F.col("root").alias("__r")).agg(F.min("first").alias("component_id")), "simhash-ids")
    named = staged(joined.join(ids, F.col("root") == F.col("__r")).select(
        F.col("fingerprint").alias("__f"), "component_id"), "simhash-named")
    return prints.join(named, F.col("fingerprint") == F.col("__f")).drop("__f")


def without_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, columns as given: the one with the smallest
    id (null last), of equal ids the one with the smallest text hash, of equal
    rows the first."""
    key = F.xxhash64("text", "lang", "source")
    prints = staged(with_fingerprint(docs.select("doc_id", "text", key.alias("__k"))).drop("text"), "simhash-docs")
    named = with_components(prints.withColumn("__id", F.coalesce("doc_id", F.lit(2**63 - 1))).drop("doc_id")
                            .withColumnRenamed("__id", "doc_id"), distance)
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__k")).alias("s")).select(
        F.col("s.doc_id").alias("__d"), F.col("s.__k").alias("__k"))
    kept = staged(kept, "simhash-kept")
    given = docs.select(F.struct("*").alias("__row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("__id"), key.alias("__key"))
    stay = given.join(kept, (F.col("__id") == F.col("__d")) & (F.col("__key") == F.col("__k")))
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__d"))
    return stay.withColumn("__n", first).where("__n = 1").select("__row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = staged(with_fingerprint(docs).drop("text"), "simhash-docs")
    return with_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
