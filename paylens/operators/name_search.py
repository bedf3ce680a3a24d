"""Token search over a stored inverted index.

``token_search`` reads the whole appearance index for each search. Here the index is
written once together with what finds names in it:

* ``postings``: for each gram of one to three characters, the names (as numbers) that
  hold it, in buckets by the gram's hash, and in tiers by payment;
* ``entries``: the index rows with their name's number, in buckets by that number and
  in the same tiers;
* ``grams``: how many names hold each gram.

A token is contained in a name only if its trigrams are (a token of one or two
characters is a gram itself). A search takes the rarest gram of each token, reads the
buckets of these, meets their postings, and verifies the names that are left exactly on
their entries. A tier holds larger payments than any lower one, so the k largest hits
are found tier by tier, and the search ends with the tier that completes them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paylens.functions.text import all_tokens_in, search_tokens
from paylens.operators.appearances import index_order
from paylens.session import staged

GRAM = 3
#: Postings (or entries) that a bucket holds about.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS, TIERS = 8, 16


def _tier(total: Column) -> Column:
    """Powers of ten; it never falls as the payment grows."""
    whole = F.greatest(total.cast("double"), F.lit(1.0))
    return F.least(F.floor(F.log10(whole)), F.lit(TIERS - 1)).cast("int")


def _grams(name: Column) -> Column:
    """The distinct grams of a name."""
    def of(size: int) -> Column:
        last = F.length(name) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(name, i, F.lit(size)))).otherwise(
            F.expr("CAST(array() AS array<string>)"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str) -> str:
    """Store an appearance index for search. ``path`` must be new."""
    spark = index.sparkSession
    stored = staged(index.withColumn("_lower", F.lower("display_name")).withColumn("tier", _tier(F.col("total_payment"))), "search-index")
    names = staged(stored.select("_lower").distinct().withColumn("name_id", F.monotonically_increasing_id()), "search-names")
    coded = staged(stored.join(names, "_lower"), "search-coded")
    has = coded.select("name_id", "tier").distinct()
    postings = staged(names.select("name_id", F.explode(_grams(F.col("_lower"))).alias("gram")).join(has, "name_id"), "search-postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    counts.orderBy("gram").write.parquet(f"{path}/grams")
    most, total = spark.read.parquet(f"{path}/grams").agg(F.max("n"), F.sum("n")).first()
    rows = coded.count()
    buckets = max(LEAST_BUCKETS, -(-max(total or 0, rows) // BUCKET_ROWS))
    salts = -(-(most or 1) // BUCKET_ROWS)  # parts of the longest posting list
    (postings.withColumn("bucket", _bucket(F.col("gram"), buckets))
     .repartition("bucket", F.pmod("name_id", F.lit(salts))).sortWithinPartitions("bucket", "tier", "gram", "name_id")
     .write.partitionBy("bucket", "tier").parquet(f"{path}/postings"))
    (coded.drop("_lower").withColumn("bucket", _bucket(F.col("name_id"), buckets))
     .repartition("bucket", F.pmod("name_id", F.lit(salts))).sortWithinPartitions("bucket", "tier", "name_id")
     .write.partitionBy("bucket", "tier").parquet(f"{path}/entries"))
    tiers = sorted(r[0] for r in has.select("tier").distinct().collect())  # at most TIERS
    meta = [(buckets, tiers, index.schema.json())]
    spark.createDataFrame(meta, "buckets int, tiers array<int>, schema string").coalesce(1).write.parquet(f"{path}/meta")
    return path


class NameIndex:
    """A stored index, opened for search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").first()
        self.buckets, self.tiers = meta.buckets, list(meta.tiers)
        self.schema = StructType.fromJson(json.loads(meta.schema))
        self.columns = self.schema.names

    def _read(self, name: str) -> DataFrame:
        fields = {"grams": StructType().add("gram", "string").add("n", "long"),
                  "postings": StructType().add("name_id", "long").add("gram", "string").add("bucket", "integer").add("tier", "integer"),
                  "entries": StructType(list(self.schema.fields)).add("name_id", "long").add("bucket", "integer").add("tier", "integer")}
        return self.spark.read.schema(fields[name]).parquet(f"{self.path}/{name}")

    def _chosen(self, text: str) -> list[str] | None:
        """The rarest gram of each token; None if a gram is in no name, or no token."""
        tokens = self.spark.sql("SELECT 1").select(search_tokens(text).alias("t")).first()[0]
        wanted = {t: {t[i:i + GRAM] for i in range(max(1, len(t) - GRAM + 1))} for t in tokens}
        every = sorted(set().union(*wanted.values())) if wanted else []
        known = {r.gram: r.n for r in self._read("grams").where(F.col("gram").isin(every)).collect()} if every else {}
        if not tokens or len(known) < len(every):
            return None
        return sorted({min(grams, key=lambda g: (known[g], g)) for grams in wanted.values()})

    def _hits(self, text: str, chosen: list[str], tiers: list[int]) -> DataFrame:
        """Index rows of the tiers whose names hold every token."""
        postings = self._read("postings").where(F.col("tier").isin(tiers))
        buckets = self.spark.sql("SELECT 1").select(*[_bucket(F.lit(g), self.buckets) for g in chosen]).first()
        mine = postings.where(F.col("bucket").isin(*sorted(set(buckets))) & F.col("gram").isin(chosen))
        names = mine.groupBy("name_id", "tier").agg(F.count("*").alias("_n")).where(F.col("_n") == len(chosen))
        met = names.select("name_id", "tier", _bucket(F.col("name_id"), self.buckets).alias("bucket"))
        entries = self._read("entries").where(F.col("tier").isin(tiers))
        found = entries.join(met, ["bucket", "tier", "name_id"], "left_semi")
        return found.where(all_tokens_in(F.col("display_name"), text)).select(self.columns)

    def search(self, text: str, k: int | None = None) -> DataFrame:
        """F10 + O7: index rows whose name holds every token, largest payment first;
        the ``k`` first of them, if told."""
        order = index_order()
        order = [F.desc("total_payment"), *order[:3], *order[4:]]
        chosen = self._chosen(text)
        if chosen is None:
            return self.spark.createDataFrame([], self.schema)
        if k is None:
            return self._hits(text, chosen, self.tiers).orderBy(*order)
        best: list = []
        for tier in reversed(self.tiers):  # k rows at most are held
            best += self._hits(text, chosen, [tier]).orderBy(*order).limit(k - len(best)).collect()
            if len(best) >= k:
                break
        return self.spark.createDataFrame(best, self.schema).orderBy(*order)
