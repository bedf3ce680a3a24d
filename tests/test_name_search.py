"""The stored name index against the search that reads the whole index."""

import random
import re

import pytest

from paylens.operators import appearances as A
from paylens.operators import name_search as S

KEYS = ", ".join(f"{k} string" for k in A.INDEX_KEYS)
SCHEMA = f"{KEYS}, total_payment decimal(38,6), instance_count bigint"


def index(spark, n=600, seed=4):
    rng = random.Random(seed)
    first = ["Ann", "Benjamin", "Éva", "O", "Li", "JOSÉ", "İpek", "Anna-Maria", "Bo", "Straße"]
    last = ["Domb", "O'Neil", "Li", "Smith", "domble", "X", "Ng", "Ünal", "van der Berg", "Ombud"]
    rows = []
    for i in range(n):
        f, m, l = rng.choice(first), rng.choice(["", "G", "G.", "Grant"]), rng.choice(last)
        total = rng.choice(["0", "-5", "0.5", "9.999999", "10", "100", "99.5", "1000", "12345.67", "1e9", "99999999999999999999.5", str(rng.randint(1, 10**6))])
        rows.append((" ".join(x for x in (f, m, l) if x), f, m, l, rng.choice(["PI 1", "Covered"]), str(2000 + i % 7), str(i), "NPI", "s", f"f{i}", total, 1))
    frame = spark.createDataFrame(rows, f"{KEYS}, total_payment string, instance_count bigint")
    return frame.withColumn("total_payment", frame.total_payment.cast("decimal(38,6)"))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    frame = index(spark).cache()
    path = S.write_index(frame, str(tmp_path_factory.mktemp("ix") / "index"))
    return frame, S.NameIndex(spark, path)


@pytest.mark.parametrize("text", ["DOMB ben", "o", "é", "g. a", "i̇p", "xyz", "  \t ", "omb omb", "benjamin g domb"])
def test_equals_the_full_search(both, text):
    frame, stored = both
    want = [tuple(r) for r in A.token_search(frame, text).collect()]
    assert [tuple(r) for r in stored.search(text).select(frame.columns).collect()] == want
    for k in (7,):
        assert [tuple(r) for r in stored.search(text, k).select(frame.columns).collect()] == want[:k]


def test_reads_few_buckets_and_stops_early(both, monkeypatch):
    _, stored = both
    plan = stored._hits("domb", stored._chosen("domb"), stored.tiers)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", plan)  # one bucket of the postings
    asked = []
    hits = S.NameIndex._hits
    monkeypatch.setattr(S.NameIndex, "_hits", lambda self, t, c, tiers: asked.append(tiers) or hits(self, t, c, tiers))
    assert stored.search("domb", 3).count() == 3 and asked == [[stored.tiers[-1]]]


def test_empty_index(spark, tmp_path):
    path = S.write_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    assert S.NameIndex(spark, path).search("ann", 3).count() == 0
