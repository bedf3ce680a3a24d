"""Operator 2: mixing sources to target weights by Sainte-Lague apportionment.
DataFrame functions only.

Sources by code point (null last) weigh ``WEIGHTS``, repeating, and share all
words; a target stops at ``CAP`` times its source's words, and the excess is
shared again by weight until no target is above.

The words of a source are a stream of its documents in seeded order, in cells of
about ``CELL`` words (documents fall into cells by hash; no source is one task's
work). Cells are grouped into shards. In each shard, blocks of ``BLOCK`` words are
allocated to the cells by the highest quotients target / (2 k + 1): rounding at
the shard's mean divisor gives all but a few seats, and only the quotients that
can win or lose those are ranked. A cell's quota of blocks is then selected from
the start of its seeded stream, and again from the start when it is used up.

Defined results: a null or empty text has size 0 and gives none. A null source is
a source of its own. Rows with equal id and text are documents of their own with
neighbouring places in the stream. All sizes 0: nothing is taken. An empty table
gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import staged, table, word_array, word_count

WEIGHTS, CAP, BLOCK, CELL, SEED = (5, 2, 1), 3, 8, 2**18, 20240


def sources_with_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """A row per source: source_size, weight, target."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Places in code-point order: ranges, then offsets of the ranges.
    ranged = staged(sums.orderBy(F.col("source").isNull(), "source").withColumn("__p", F.spark_partition_id()), "mix-sources")
    inside = Window.partitionBy("__p").orderBy(F.col("source").isNull(), "source")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__n")).select(
        "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = ranged.join(starts, "__p").withColumn("__at", F.row_number().over(inside) - 1 + F.col("__start"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    rows = staged(placed.select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights")
    limit = F.col("source_size") * cap
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, n = None, -1
    while True:  # one small aggregation each time until no further target is above its limit
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share) > limit
        got = rows.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if got[0] == n or not got[2]:
            break
        n, share = got[0], (total - (got[1] or 0)) / got[2]
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(share or 0.0))
    return rows.withColumn("target", target.cast("double"))


def _quotas(cells: DataFrame, block: int) -> DataFrame:
    """Cells (source, cell, shard, words, want) -> their quota of blocks."""
    shard = Window.partitionBy("shard")
    sums = (cells.withColumn("sum_want", F.sum("want").over(shard)).withColumn("m", F.count("*").over(shard))
            .withColumn("seats", F.floor(F.col("sum_want") / block + 0.5)))
    first = sums.withColumn("got", F.when(F.col("seats") > 0, F.floor(F.col("want") * F.col("seats") / F.col("sum_want") + 0.5))
                            .otherwise(F.lit(0)).cast("long"))
    left = first.withColumn("rest", F.col("seats") - F.sum("got").over(shard))
    # A cell's gain or loss is below its share of (|rest| + cells in the shard), plus one.
    most = F.floor(F.col("want") * (F.abs("rest") + F.col("m")) / F.col("sum_want")) + 1
    tries = left.where("rest != 0").select(
        "source", "cell", "shard", "rest", "got", "want",
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, most).otherwise(
            F.least(most, F.greatest(F.col("got") - 1, F.lit(0)))))).alias("k"))
    seat = F.when(F.col("rest") > 0, 2 * (F.col("got") + F.col("k")) + 1).otherwise(2 * (F.col("got") - F.col("k")) - 1)
    ranked = (tries.where("rest > 0 OR got > 0").withColumn("q", F.when(F.col("rest") > 0, -F.col("want") / seat).otherwise(F.col("want") / seat))
              .withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("q", "source", "cell", "k"))))
    moved = (ranked.where(F.col("place") <= F.abs("rest")).groupBy(F.col("source").alias("__s"), F.col("cell").alias("__c"))
             .agg(F.sum(F.signum("rest").cast("long")).alias("moved")))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("cell") == F.col("__c"))
    return left.join(moved, same, "left").select(
        "source", "cell", "words", (F.col("got") + F.coalesce("moved", F.lit(0))).alias("blocks"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, cell: int = CELL,
        seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source, size) -> the same with source_size, target,
    ``copies`` (whole copies that the mix takes), ``part`` (words taken from the
    start of one more copy) and ``taken`` = copies * size + part."""
    sizes = staged(sizes.select("doc_id", "text_key", "source", "size"), "mix-sizes")
    sources = staged(sources_with_targets(sizes, weights, cap), "mix-targets")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, -(-total // cell))
    n_cells = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / cell))
    dealt = (sizes.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
             .withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "text_key", "doc_id"), n_cells)))
    dealt = staged(dealt, "mix-cells")
    cells = dealt.groupBy("source", "cell").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = cells.select("source", "cell", "words",
                         F.pmod(F.xxhash64(F.lit(seed), "source") + F.col("cell"), F.lit(n_shards)).alias("shard"),
                         F.coalesce(F.col("target") * F.col("words") / F.expr("nullif(source_size, 0)"), F.lit(0.0)).alias("want"))
    quota = staged(_quotas(staged(cells, "mix-shards"), block), "mix-quotas").select(
        F.col("source").alias("__s"), F.col("cell").alias("__c"), "words",
        F.least(F.col("blocks") * block, F.col("words") * cap).alias("quota"))
    stream = Window.partitionBy("source", "cell").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), "doc_id", "text_key", "size")
    placed = dealt.withColumn("__to", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.join(quota, F.col("source").eqNullSafe(F.col("__s")) & (F.col("cell") == F.col("__c")))
    words = F.greatest("words", F.lit(1))
    rest = F.pmod("quota", words) - (F.col("__to") - F.col("size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))
    return (out.withColumn("copies", F.floor(F.col("quota") / words)).withColumn("part", part)
            .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
            .select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", "part", "taken"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size) of documents; text_key tells texts apart."""
    return docs.select("doc_id", F.xxhash64("text", "source").alias("text_key"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, columns as given: whole copies as rows
    of their own, and the words of a part joined by a space. ``n_chars``, where
    present, follows the text."""
    # Equal rows share a list of what each of them gives.
    lists = (mix(sized(docs), **options).groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("copies", "part")).alias("__take"), F.count("*").alias("__rows"), F.sum("taken").alias("__taken"))
             .where("__taken > 0"))
    keyed = docs.withColumn("__key", F.xxhash64("text", "source"))
    lists = lists.withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    both = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    place = F.row_number().over(Window.partitionBy("__d", "__k").orderBy("__d"))
    mine = both.withColumn("__i", F.when(F.col("__rows") > 1, place).otherwise(1)).where(F.col("__i") <= F.size("__take"))
    take = F.element_at("__take", F.col("__i"))
    whole = F.array_repeat(F.col("text"), take["copies"].cast("int"))
    part = F.when(take["part"] > 0, F.array(F.concat_ws(" ", F.slice(word_array(F.col("text")), 1, take["part"].cast("int")))))
    rows = mine.withColumn("__texts", F.concat(whole, F.coalesce(part, F.expr("array_repeat('', 0)")))).withColumn("text", F.explode("__texts"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source", "source_size", "target", "taken")
