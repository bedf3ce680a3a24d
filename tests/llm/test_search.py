import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paylens.llm import search as S

DOCS = "doc_id long, text string, score long, rank string, m string"
BENCH = "item_id long, text string, query string"
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return [t.translate(FOLD) for t in re.findall(TERM, text or "")]


def brute(docs, items, k):
    """item row -> [(score, doc_id)], best first."""
    counted = [(d, Counter(terms(text))) for d, text, *_ in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out.append((item, [(-s, None if null else d) for s, null, d in sorted(scores)[:k]]))
    return out


def tables(n_docs, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "É", "été", "Straße", "7", "a_b", "x-y"]
    pick = lambda k: " ".join(vocabulary[min(int(rng.expovariate(0.07)), 66)] for _ in range(k))
    docs = [(d, pick(rng.choice([0, 1, 3, 3, 3, 8, 20, 60])), d, "", "") for d in range(n_docs)]
    docs += [(n_docs + i, "w1 w2 w3 the", 0, "", "") for i in range(40)]  # equal scores
    docs += [(None, "w1 w2 w3 the", 0, "", "")] * 3 + [(5, "w9 w9", 0, "", ""), (6, None, 0, "", ""), (7, "", 0, "", ""), (8, pick(50_000), 0, "", "")]
    items = [(i, pick(rng.randint(1, 12)), "clash") for i in range(30)]
    items += [(None, "w1 W1 w2", ""), (3, "w5", ""), (99, None, ""), (98, "?!", ""), (97, "unheard", ""), (96, "the the w40 " * 50, "")]
    return docs, items


def same(got, want):
    rows = {}
    for r in got:
        rows.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    told = {}
    for item, found in want:
        told.setdefault(item, []).extend((i + 1, d, s) for i, (s, d) in enumerate(found))
    assert {i: sorted(map(str, v)) for i, v in rows.items()} == {i: sorted(map(str, v)) for i, v in told.items() if v}


@pytest.mark.parametrize("query_bytes", [8 << 20, 300])
def test_against_brute_force(spark, monkeypatch, query_bytes):
    docs, items = tables(400, 2)
    monkeypatch.setattr(S.index, "__defaults__", (200,))  # strata in many parts
    got = S.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, BENCH), 10, query_bytes).collect()
    same(got, brute(docs, items, 10))


def test_query_and_fewer_documents_than_asked(spark, tmp_path):
    docs, items = tables(3, 4)
    docs = docs[:6]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    same(S.op13_lexical_search(spark, str(tmp_path)).collect(), brute(docs, items, 10))


def test_strata_below_the_threshold_are_not_visited(monkeypatch):
    vocabulary = {b"a": 0, b"b": 1}
    block = S.Block([(0, Counter({b"a": 2}))], vocabulary, np.array([10, 10]))
    long, short = (pa.table({"m": [m] * 3, "doc_id": ids, "terms": [[0]] * 3, "tfs": [[1]] * 3}, pa.schema(
        [("m", pa.int64()), ("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])) for m, ids in ((900, [1, 2, 3]), (30, [4, 5, 6])))
    rows = pa.concat_tables([S._stratum(long), S._stratum(short)]).combine_chunks().to_batches()
    visited = []
    scores = S.Stratum.scores
    monkeypatch.setattr(S.Stratum, "scores", lambda self, q, b: visited.append(self.ids.tolist()) or scores(self, q, b))
    out = pa.Table.from_batches(S._visit(iter(rows), block, np.ones(1, np.int64), 2, False))
    assert visited == [[4, 5, 6]] and out.column("doc_id").to_pylist() == [4, 5]


def test_empty_tables(spark):
    docs, items = tables(5, 1)
    assert S.search(spark.createDataFrame([], DOCS), spark.createDataFrame(items, BENCH)).count() == 0
    assert S.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], BENCH)).count() == 0
