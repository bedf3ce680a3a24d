"""Operator 5: quality rules by robust multivariate outliers. DataFrame functions only.

Base statistics are counted on the whole text inside its row. Documents that pass
the base rules get a vector of transformed statistics (``VECTOR``), and each group
of language and source gets a minimum-covariance-determinant estimate of it:
starting from coordinate medians, concentration steps keep the ``SHARE`` of the
rows that lie nearest by Mahalanobis distance and estimate mean and covariance
from those. Sums are exact (fixed-point decimals), so that reruns agree whatever
the partitions are. A document beyond the chi-square ``CUTOFF`` of its group is
rejected.

``LEAST_SPREAD`` is added to each variance: a statistic that is zero in nearly all
clean documents (symbols, repeated lines) would otherwise have no spread, and one
repeated line would reject a document. The number of words is no coordinate, as
long clean documents are wanted.

Defined results: a null or empty text has no words and fails the base rules. A
null language or source is a group of its own. A group of fewer than ``MIN_GROUP``
rows uses the estimate of its language, then that of the whole table; without
such a one the base rules decide alone. Equal distances fall on the same side;
repeated rows are judged alike. Extra columns pass through; ones named like the
results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from paylens.llm.common import staged, table, word_array

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
VECTOR = ["log_word_length", "root_symbol_share", "dup_line_share", "repeat_share"]
LEAST_SPREAD = [0.08, 0.05, 0.15, 0.15]
SHARE, STEPS, MIN_GROUP, TAIL = 0.75, 4, 100, 0.0001
#: Fixed-point units of a coordinate (sums are exact) and of the median's bins.
UNIT, BIN = 2**16, 2**6
D = len(VECTOR)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _chi_square(x: float, df: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, df) < p else (low, mid)
    return high


CUTOFF = _quantile(1 - TAIL, D)
#: Makes the covariance of the nearest SHARE of normal rows that of all of them.
CONSISTENCY = SHARE / _chi_square(_quantile(SHARE, D), D + 2)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics and ``__lines`` (lines that hold a word)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in STATS]
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep, word_array(F.col(text)).alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    # The functions below read nothing but their own arguments: were a column read
    # inside one, an optimizer rule that moves the expression would count it anew
    # for each element.
    w, n = F.col("__w"), F.size("__w")
    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    hashes = F.zip_with(pairs, F.slice(w, 3, n - 2), lambda q, z: F.xxhash64(q["x"], q["y"], z))
    found = split.withColumn("__g", F.when(n >= 4, F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    g = F.col("__g")
    after = F.zip_with(g, F.slice(g, 2, F.size(g)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    same = found.withColumn("__e", after)
    twin = F.zip_with("__e", F.concat(F.array(F.lit(False)), F.col("__e")), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    marked = F.zip_with(g, twin, lambda x, f: F.when(f, x["i"]))
    placed = same.withColumn("__p", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    p = F.col("__p")
    # Each repeated window covers its words up to the next repeated window.
    new = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    repeat = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0))
    return placed.select(
        *keep, F.size(w).cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"), F.size("__l").alias("__lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a row, in fixed-point units."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    parts = [F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
             F.col("n_dup_lines") / F.greatest("__lines", F.lit(1)), F.col("n_repeat_words") / words]
    return [F.round(p * UNIT).cast("long") for p in parts]


def _distance(x: list[Column], mean, factor) -> Column:
    """Squared Mahalanobis distance by forward substitution in the lower factor."""
    y: list[Column] = []
    for i in range(D):
        rest = x[i] - mean(i)
        for k in range(i):
            rest = rest - factor(i, k) * y[k]
        y.append(rest / factor(i, i))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factored(moments: DataFrame) -> DataFrame:
    """Group rows with n, s_i, s_i_j (sums over kept rows) -> mean and lower factor."""
    keys = ["level", "g_lang", "g_source", "n_group"]
    out = moments.select(*keys, *[(F.col(f"s{i}").cast("double") / F.col("n") / UNIT).alias(f"m{i}") for i in range(D)],
                         *[(F.col(f"s{i}_{j}").cast("double") / F.col("n") / UNIT**2).alias(f"q{i}_{j}") for i, j in PAIRS])
    for j in range(D):
        def cell(i: int, j: int = j) -> Column:
            c = (F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            c = F.greatest(c, F.lit(0.0)) + LEAST_SPREAD[i] ** 2 if i == j else c
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            return c

        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(cell(j), F.lit(LEAST_SPREAD[j] ** 2 / 4))))
        out = out.withColumns({f"l{i}_{j}": cell(i) / F.col(f"l{j}_{j}") for i in range(j + 1, D)} or {"__none": F.lit(0)})
    return out.select(*keys, *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i, j in PAIRS])


def _same_group(a: str, b: str) -> Column:
    return ((F.col(f"{a}.level") == F.col(f"{b}.level")) & F.col(f"{a}.g_lang").eqNullSafe(F.col(f"{b}.g_lang"))
            & F.col(f"{a}.g_source").eqNullSafe(F.col(f"{b}.g_source")))


def fit(stats: DataFrame) -> DataFrame:
    """Estimates for each (language, source), each language and the whole table
    (``level`` 0, 1, 2): a row per group with its mean and covariance factor."""
    group = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source"))))
    x = [f"x{i}" for i in range(D)]
    passed = stats.where(~base_failed()).select(
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        *[c.alias(n) for c, n in zip(vector(), x, strict=True)])
    # Rows with equal vectors count together.
    rows = passed.select(group.alias("g"), *x).groupBy("g.level", "g.g_lang", "g.g_source", *x).agg(F.count("*").alias("c"))
    rows = staged(rows, "quality-vectors")
    keys = ["level", "g_lang", "g_source"]

    bins = rows.select(*keys, "c", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(n) / BIN).alias("bin"))
                                                       for i, n in enumerate(x)])).alias("b"))
    counts = bins.groupBy(*keys, "b.dim", "b.bin").agg(F.sum("c").alias("c"))
    within = Window.partitionBy(*keys, "dim")
    middle = (counts.withColumn("below", F.sum("c").over(within.orderBy("bin"))).withColumn("n", F.sum("c").over(within))
              .where(F.col("below") * 2 >= F.col("n")).groupBy(*keys, "dim").agg(F.min("bin").alias("bin"), F.max("n").alias("n")))
    at = lambda i: F.max(F.when(F.col("dim") == i, (F.col("bin") + 0.5) * BIN / UNIT))
    estimate = middle.groupBy(*keys).agg(
        F.max("n").alias("n_group"), *[at(i).alias(f"m{i}") for i in range(D)],
        *[F.max(F.lit(LEAST_SPREAD[i] if i == j else 0.0)).alias(f"l{i}_{j}") for i, j in PAIRS])
    estimate = staged(estimate, "quality-estimate")

    for _ in range(STEPS):
        far = rows.alias("r").join(estimate.alias("e"), _same_group("r", "e")).select(
            *[f"r.{k}" for k in keys], "c", *x, "n_group", _distance(
                [F.col(n) / UNIT for n in x], lambda i: F.col(f"e.m{i}"), lambda i, j: F.col(f"e.l{i}_{j}")).alias("d2"))
        binned = far.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-9) * 16))
        tally = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("c"), F.max("n_group").alias("n_group"))
        order = Window.partitionBy(*keys).orderBy("bin")
        edge = (tally.withColumn("below", F.sum("c").over(order)).where(F.col("below") >= F.col("n_group") * SHARE)
                .groupBy(*keys).agg(F.min("bin").alias("edge")))
        edge = staged(edge, "quality-edge")
        near = binned.alias("r").join(edge.alias("e"), _same_group("r", "e")).where("bin <= edge").select(
            *[f"r.{k}" for k in keys], "c", "n_group", *x)
        wide = lambda c: F.sum(c.cast("decimal(20,0)"))
        moments = near.groupBy(*keys).agg(
            F.max("n_group").alias("n_group"), F.sum("c").alias("n"),
            *[wide(F.col(n) * F.col("c")).alias(f"s{i}") for i, n in enumerate(x)],
            *[F.sum((F.col(x[i]) * F.col(x[j])).cast("decimal(20,0)") * F.col("c").cast("decimal(10,0)")).alias(f"s{i}_{j}")
              for i, j in PAIRS])
        estimate = staged(_factored(moments), "quality-estimate")
    return estimate


def judge(stats: DataFrame, estimate: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance2`` (null where no group is large
    enough) and ``kept``."""
    keep = [F.col(f"`{c}`") for c in stats.columns if c not in ("base_failed", "distance2", "kept", "__lines")]
    names = ["n_group", *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i, j in PAIRS]]
    large = estimate.where(F.col("n_group") >= MIN_GROUP)
    rows = stats
    for level in range(2):
        e = large.where(F.col("level") == level).select(
            F.col("g_lang").alias(f"__a{level}"), F.col("g_source").alias(f"__b{level}"), F.struct(*names).alias(f"__e{level}"))
        on = F.col("lang").cast("string").eqNullSafe(F.col(f"__a{level}"))
        if level == 0:
            on = on & F.col("source").cast("string").eqNullSafe(F.col(f"__b{level}"))
        rows = rows.join(e, on, "left")
    whole = large.where(F.col("level") == 2).select(F.struct(*names).alias("e")).first()  # one row at most
    last = F.struct(*[F.lit(whole.e[c]).alias(c) for c in names]) if whole else F.lit(None).cast(large.select(F.struct(*names).alias("e")).schema["e"].dataType)
    chosen = rows.withColumn("__e", F.coalesce("__e0", "__e1", last))
    d2 = _distance([v / UNIT for v in vector()], lambda i: F.col(f"__e.m{i}"), lambda i, j: F.col(f"__e.l{i}_{j}"))
    return chosen.select(*keep, base_failed().alias("base_failed"), d2.alias("distance2")).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns as given. Estimates are fitted first;
    the second scan counts the statistics again rather than shuffle the texts."""
    estimate = fit(staged(with_statistics(docs.select("text", "lang", "source")).drop("text"), "quality-statistics"))
    given = docs.select("*", F.struct("*").alias("__row"))
    judged = judge(with_statistics(given), estimate)
    return judged.where("kept").select("__row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = staged(with_statistics(docs).drop("text"), "quality-statistics")
    return judge(stats, fit(stats)).select("doc_id", *STATS, "base_failed", "kept", "distance2")
