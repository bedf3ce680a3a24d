"""Operator 12: benchmark decontamination. DataFrame functions only.

Texts are lower-cased (A-Z alone) and cut into words. The windows of ``N`` words of
the benchmark's items (an item of fewer words is one window) become a set of hashes,
broadcast where its measured size allows. Training texts are scanned once: each
token window's hash is looked up, and a hit is verified on the words themselves.
Hits of a document become spans of words, and those or the documents are removed.

One scan gives one row per document and one per hit; texts are not shuffled. A set of
more than ``BROADCAST_BYTES`` is joined by shuffle instead, on hashes and places
alone; the hits then read their texts again to be verified.

Defined results: a null or empty text has no words; a null item id is an item whose
id is the empty string; items that share an id are one item. Documents are told apart
by doc_id and 128 bits of the text's hash, so rows that are equal in both (or share a
null id) have equal results, a row each. No document or no item: no hits. Extra
columns pass through ``decontaminated`` and are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import staged, table

N = 10
BROADCAST_BYTES = 64 << 20
#: Fixed value: what separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text as it stands, with what follows up to the next.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
RAW_LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
KEY = ["__d", "__a", "__b"]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.col("doc_id").alias("__d"), F.xxhash64(F.lit(1), "text").alias("__a"),
                       F.xxhash64(F.lit(2), "text").alias("__b"))


def same_key(left: str = "", right: str = "__r") -> Column:
    cond = F.col(f"{left}__d").eqNullSafe(F.col(f"{right}__d"))
    return cond & (F.col(f"{left}__a") == F.col(f"{right}__a")) & (F.col(f"{left}__b") == F.col(f"{right}__b"))


def item_windows(bench: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(gram, size, words, hash) of the distinct windows, and (gram, item) pairs."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    cut = (items.where(F.size("w") > 0).select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("p"))
           .select("item", "size", F.slice("w", F.col("p"), F.col("size")).alias("g")))
    pairs = staged(cut.select("item", "size", F.concat_ws(" ", "g").alias("words"), F.xxhash64("g").alias("hash")).distinct(), "clean-pairs")
    grams = staged(pairs.select("size", "words", "hash").distinct().withColumn("gram", F.monotonically_increasing_id()), "clean-grams")
    return grams, pairs.join(grams.select("gram", "words"), "words").select("gram", "item")


def hits(docs: DataFrame, grams: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document (``place`` 0) and one per verified window hit: its key,
    n_words, place (from 1), size and gram."""
    told = grams.agg(F.sort_array(F.collect_set("size")), F.sum(F.length("words") * 4 + 40)).first()  # sizes: n at most
    sizes = [int(s) for s in told[0]] or [1]
    words = keyed(docs.select("doc_id", "text")).select(*KEY, words_of(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - F.col("z") + 1, F.lit(0))
    first = F.when(F.col("z") == sizes[0], 0).otherwise(1)  # place 0, once a document
    scan = (words.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("z"))
            .select("*", F.explode(F.when(last >= first, F.sequence(first, last))).alias("place")))
    mine = F.slice("w", F.greatest("place", F.lit(1)), F.col("z"))
    known = grams.select("gram", F.col("words").alias("__words"), F.col("hash").alias("__hash"))
    n_words = F.size("w").cast("long").alias("n_words")
    if (told[1] or 0) <= broadcast_bytes:
        look = scan.withColumn("__h", F.when(F.col("place") > 0, F.xxhash64(mine)))
        found = look.join(F.broadcast(known), (F.col("__h") == F.col("__hash")) & (F.concat_ws(" ", mine) == F.col("__words")), "left")
        return found.where("place = 0 OR gram IS NOT NULL").select(*KEY, n_words, "place", F.col("z").alias("size"), "gram")
    marks = scan.where("place = 0").select(*KEY, n_words, "place", F.lit(0).alias("size"), F.lit(None).cast("long").alias("gram"))
    narrow = scan.where("place > 0").select(*KEY, "place", "z", F.xxhash64(mine).alias("__h"))
    met = narrow.join(known, F.col("__h") == F.col("__hash")).select(*KEY, "place", "z", "gram", "__words").distinct()
    text = words.dropDuplicates(KEY).select(*[F.col(c).alias(f"__r{c}") for c in KEY], "w")
    sure = met.join(text, same_key()).where(F.concat_ws(" ", mine) == F.col("__words"))
    return marks.unionByName(sure.select(*KEY, n_words, "place", F.col("z").alias("size"), "gram"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: __d, __a, __b (its key), n_words, n_hit, spans (array of
    start, end in words, from 0) and items (sorted array of item ids as strings)."""
    grams, items = item_windows(bench, n)
    found = staged(hits(docs, grams, broadcast_bytes), "clean-hits")
    marks = found.where("place = 0").select(*KEY, "n_words")
    once = found.where("place > 0").select(*KEY, "place", "size", "gram").distinct()
    order = Window.partitionBy(*KEY).orderBy("place", "__end")
    ends = once.select(*KEY, F.col("place") - 1, (F.col("place") - 1 + F.col("size")).alias("__end")).toDF(*KEY, "place", "__end")
    reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("place") <= F.col("__reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = (ends.withColumn("__reach", reach).withColumn("__i", island)
            .groupBy(*KEY, "__i").agg(F.min("place").alias("start"), F.max("__end").alias("end")))
    spans = runs.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
                                   F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = (once.select(*KEY, "gram").distinct().join(items, "gram").select(*KEY, "item").distinct()
             .groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items")))
    right = [F.col(c).alias(f"__r{c}") for c in KEY]
    both = spans.select(*right, "n_hit", "spans").join(named, F.col("__r__d").eqNullSafe(F.col("__d")) & (F.col("__r__a") == F.col("__a"))
                                                       & (F.col("__r__b") == F.col("__b"))).drop(*KEY)
    return marks.join(both, same_key(), "left").select(
        *KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: int, end: int>>)")).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def decontaminated(docs: DataFrame, bench: DataFrame, remove: str = "spans", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without what the benchmark holds: ``remove="documents"`` leaves out
    each document with a hit, ``"spans"`` the words hit, with what separates them from
    the next word; the rest of a text stays as it is, and ``n_chars`` follows."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    dirty = contamination(docs, bench, n, broadcast_bytes).where("n_hit > 0").select(*KEY, F.col("spans").alias("__spans")).dropDuplicates(KEY)
    right = dirty.select(*[F.col(c).alias(f"__r{c}") for c in KEY], "__spans")
    both = keyed(docs).join(right, same_key(), "left_anti" if remove == "documents" else "left")
    if remove == "documents":
        return both.select(*[F.col(f"`{c}`") for c in docs.columns])
    kept = F.filter(F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0)),
                    lambda _, i: ~F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    text = F.when(F.col("__spans").isNotNull(), F.concat(F.regexp_extract("text", RAW_LEAD, 0), F.concat_ws("", kept))).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("__d").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_sql() -> str:
    """Windows as lists of words, joined by equality of the lists."""
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAP}'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, z, w[p:p + z - 1] AS s FROM (
    SELECT item, w, z, unnest(range(1, len(w) - z + 2)) AS p FROM (SELECT item, w, least(len(w), {N}) AS z FROM i WHERE len(w) > 0))
), t AS (
  SELECT r, z, p, w[p:p + z - 1] AS s
  FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS p FROM d, (SELECT DISTINCT z FROM g) WHERE len(w) >= z)
), h AS (SELECT t.r, t.z, t.p, g.item FROM t JOIN g ON t.z = g.z AND t.s = g.s),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + z)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r"""
