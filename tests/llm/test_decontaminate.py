import hashlib
import random
import re

import pytest

from paylens.llm import decontaminate as D

DOCS = "doc_id long, text string, lang string, n_chars int, size string, gram string, item string"
BENCH = "item_id long, text string, words string, w string"
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def brute(docs, bench, n):
    grams = {}
    for item, text, *_ in bench:
        w = words(text)
        z = min(n, len(w))
        for p in range(len(w) - z + 1) if w else ():
            grams.setdefault(tuple(w[p:p + z]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for d, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for z in sizes:
            for p in range(len(w) - z + 1):
                if found := grams.get(tuple(w[p:p + z])):
                    hit |= set(range(p, p + z))
                    items |= found
        out.append((d, len(w), hit, sorted(items, key=str.encode)))
    return out


def tables(n_docs=150, seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "Ünit", "x1", "7", "ÀB", "zz"]
    say = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", ", ", "--", "\x7f"]) for _ in range(k))
    bench = [(i, say(rng.randint(4, 14)), "clash", "") for i in range(25)]
    bench += [(3, "The one of x1", "", ""), (None, "only here and there it is", "", ""), (40, None, "", ""), (41, "... !", "", ""), (42, "zz zz", "", "")]
    docs = []
    for d in range(n_docs):
        text = say(rng.randint(0, 60))
        if rng.random() < 0.5:
            text += rng.choice(bench)[1] or ""
        docs.append((d, "  " + text + say(2), "en", len(text), "clash", "", ""))
    docs += [(None, "only HERE and there, it is!", "", 1, "", "", "")] * 3 + [(None, None, "", 0, "", "", ""), (900, "", "", 0, "", "", "")]
    docs += [(7, "zz zz zz", "", 8, "", "", ""), (901, say(30_000) + bench[0][1], "", 1, "", "", "")]
    return docs, bench


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_against_brute_force(spark, broadcast_bytes):
    docs, bench = tables()
    got = D.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), 6, broadcast_bytes).collect()
    told = sorted((str(r["__d"]), r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), r.n_hit, tuple(r.items)) for r in got)
    want = sorted((str(d), n, tuple(sorted(hit)), len(hit), tuple(items)) for d, n, hit, items in brute(docs, bench, 6))
    assert told == want
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_query(spark, tmp_path):
    docs, bench = tables(60, 8)
    bench.append((50, " ".join(f"w{i}" for i in range(12)), "", ""))
    docs.append((950, "Before " + " ".join(f"W{i}" for i in range(11)) + " after", "", 0, "", "", ""))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = D.op12_decontamination(spark, str(tmp_path))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((str(d), n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))
                  for d, n, hit, items in brute(docs, bench, 10))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in out.collect()) == want


def test_removal(spark):
    docs, bench = tables(80, 3)
    frame, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
    hits = {(d, text): hit for (d, text, *_), (_, _, hit, _) in zip(docs, brute(docs, bench, 6), strict=True)}
    left = D.decontaminated(frame, items, "documents", 6)
    assert left.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str((d, t)) for d, t, *_ in docs if not hits[d, t])
    cut = {}
    for r in D.decontaminated(frame, items, "spans", 6).collect():
        cut.setdefault(r.doc_id, []).append(r)
    for d, text, *_ in docs:
        if not hits[d, text]:
            assert any(x.text == text for x in cut[d])
        else:
            kept = [w for i, w in enumerate(words(text)) if i not in hits[d, text]]
            assert any(x.text is not None and words(x.text) == kept and x.n_chars == len(x.text) for x in cut[d])
    with pytest.raises(ValueError):
        D.decontaminated(frame, items, "all")


def test_empty_tables(spark):
    docs, bench = tables(5)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert D.contamination(none, spark.createDataFrame(bench, BENCH)).count() == 0
    got = D.contamination(spark.createDataFrame(docs, DOCS), no_items).collect()
    assert len(got) == len(docs) and not any(r.n_hit for r in got)
