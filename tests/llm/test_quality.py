import random
import re

from pyspark.sql import functions as F

from paylens.llm import quality
from paylens.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(1)
    bits = ["a", "b", "cé", "\n", "\n\n", " ", "\t", "\r\n", "#", "|", "<x>", "\u00a0", "\x0b", "漢字"]
    return [None, "", " ", "\n", "a", "a b c a b c", "a a a a a", "x " * 30000, "one two\none two\n", "the cat sat. the cat sat. on"] + [
        " ".join(rng.choices(bits, k=rng.randint(1, 80))) for _ in range(200)] + ["".join(rng.choices(bits, k=40)) for _ in range(100)]


def test_statistics_equal_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(data)], SCHEMA)
    for r in quality.with_statistics(docs).collect():
        assert tuple(r[c] for c in quality.STATS) == brute(data[r.doc_id]), data[r.doc_id]


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, words(rng.randint(60, 400)), ["en", "de", None][i % 3], ["hot", "hot", "cold", None][i % 4], "x") for i in range(900)]
    rows += [(5000 + i, words(100), "la", "rare", "x") for i in range(5)]
    rows += [(6000 + i, " ".join(x + "###" for x in words(120).split()), ["en", "de"][i % 2], "hot", "x") for i in range(40)]
    return rows + [(7000, words(30000), "en", "hot", "x"), (7001, None, "en", "hot", "x"), (7002, "", None, None, "x"),
                   (7003, words(100) + "\n" + "same line here\n" * 2, "en", "hot", "x"), (0, rows[0][1], "en", "hot", "x")]


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    stats = staged(quality.with_statistics(docs), 't')
    judged = quality.judge(stats, quality.fit(staged(stats, 't')))
    rows = judged.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        junk = 6000 <= r.doc_id < 7000 or r.doc_id in (7001, 7002)
        assert r.kept is not junk, (r.doc_id, r.distance2)
    again = quality.judge(stats, quality.fit(staged(quality.with_statistics(docs.repartition(7)), 't'))).collect()
    assert sorted((r.doc_id, r.distance2 or -1) for r in rows) == sorted((r.doc_id, r.distance2 or -1) for r in again)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_estimate_is_robust_covariance(spark):
    """Concentration steps in numpy over the same groups agree."""
    import numpy as np
    docs = spark.createDataFrame([r for r in corpus() if r[3] is not None and r[2] is not None], SCHEMA)
    stats = quality.with_statistics(docs).where(~quality.base_failed())
    x = np.array([[c / quality.UNIT for c in r] for r in stats.where("lang = 'en' AND source = 'hot'").select(*quality.vector()).collect()])
    spread = np.array(quality.LEAST_SPREAD)
    units = np.round(x * quality.UNIT) // quality.BIN
    mean, cov = (np.sort(units, axis=0)[(len(x) + 1) // 2 - 1] + 0.5) * quality.BIN / quality.UNIT, np.diag(spread**2)
    for _ in range(quality.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.floor(np.log2(d2 + 1e-9) * 16)
        near = x[bins <= np.sort(bins)[int(np.ceil(len(x) * quality.SHARE)) - 1]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality.CONSISTENCY + np.diag(spread**2)
    got = quality.fit(staged(quality.with_statistics(docs), 't')).where("level = 0 AND g_lang = 'en' AND g_source = 'hot'").first()
    low = np.array([[got[f"l{i}_{j}"] if j <= i else 0 for j in range(quality.D)] for i in range(quality.D)])
    assert np.allclose([got[f"m{i}"] for i in range(quality.D)], mean, atol=1e-6) and np.allclose(low @ low.T, cov, atol=1e-6)


def test_empty_table_and_no_python(spark):
    empty = quality.with_statistics(spark.createDataFrame([], SCHEMA))
    assert quality.judge(empty, quality.fit(staged(empty, 't'))).count() == 0
    docs = spark.createDataFrame(corpus()[:50], SCHEMA)
    out = quality.quality_filter(docs)
    assert out.count() == 50
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
