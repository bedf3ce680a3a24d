import hashlib
import random

import numpy as np
import pytest

from paylens.llm import runs, substrings, suffixes

SCHEMA = "doc_id long, text string, n_removed string, source string"
LAST = 2**63 - 1


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(300)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [words(rng.choice([12, 13, 14, 40, 90])) for _ in range(12)]
    texts = []
    for _ in range(220):
        parts = [words(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages) if rng.random() < 0.7 else rng.choice(texts or passages), words(rng.randint(0, 30))]
        texts.append(rng.choice(["\n", " ", "  "]).join(parts)[:4000])
    texts += [None, "", " ", "a", "x" * 99, "x" * 100, "x" * 101, "ab" * 300, "é" * 120, "z " * 30, "\n".join(["line of a few words here"] * 40)]
    texts += ["hot " + passages[3] + f" {i}" for i in range(150)] + ["copy of all " + words(60)] * 1 + [texts[5]] * 40
    ids = rng.sample(range(10**6), len(texts))
    rows = [(i, t, "clash", "s") for i, t in zip(ids, texts)]
    rows += [rows[3], rows[3], (rows[4][0], texts[7], None, None), (rows[4][0], passages[4] + " x " + passages[4], None, None),
             (None, texts[2], None, None), (None, texts[9], None, None), (rows[8][0] + 1, "long " + words(9000), None, None)]
    return rows


def brute_words(rows):
    first = {}
    cut = [(LAST if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    for d, w in cut:
        for p in range(len(w) - 12):
            k = tuple(w[p:p + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for (i, *_), (d, w) in zip(rows, cut):
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < d:
                gone[p:p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window=100):
    places = {}
    cut = [(LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for d, b in set(cut):
        for p in range(len(b) - window + 1):
            places.setdefault(b[p:p + window], []).append((d, b, p))
    least = {k: min(d for d, _, _ in v) for k, v in places.items()}
    own = {}
    for k, v in places.items():
        for d, b, p in v:
            own[k, d, b] = min(own.get((k, d, b), p), p)
    out = []
    for (i, *_), (d, b) in zip(rows, cut):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            k = b[p:p + window]
            if least[k] < d or own[k, d, b] < p:
                gone[p:p + window] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i is None, i or 0, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeats"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("hot", [64, 2])
def test_words_equal_brute_force(spark, table, monkeypatch, hot):
    monkeypatch.setattr(runs, "HOT", hot)
    monkeypatch.setattr(runs, "GATHERED", 300)
    got = substrings.op6_substring_dedup(spark, table).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(corpus())


@pytest.mark.parametrize("hot", [64, 2])
def test_bytes_equal_brute_force(spark, table, monkeypatch, hot):
    monkeypatch.setattr(runs, "HOT", hot)
    monkeypatch.setattr(runs, "GATHERED", 300)
    got = suffixes.op9_suffix_dedup(spark, table).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(corpus())


def test_results_beside_the_columns(spark):
    rows = corpus()[:40]
    docs = spark.createDataFrame(rows, SCHEMA)
    for op, size, kept in ((substrings, "n_words", "kept_text"), (suffixes, "n_bytes", "kept_bytes")):
        out = op.without_repeats(docs)
        assert out.columns == ["doc_id", "text", "source", size, "n_removed", kept, "removed"]
        for r in out.collect():
            assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert op.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_one_id_keep_their_own_spans(spark):
    """Texts without an id whose hashes agree in 24 bits, and many equal ones."""
    from xxhash import xxh64_intdigest
    passage = " ".join(f"common{i}" for i in range(20))
    clean = " ".join(f"{i}unlike" for i in range(60))
    low = lambda t: xxh64_intdigest(t.encode()) & 0xFFFFFF
    by = {low(t): t for t in (f"{passage} {i}" for i in range(20000))}
    pairs = [(by[low(t)], t) for t in (f"{i} {clean} {i}" for i in range(20000)) if low(t) in by][:3]
    assert pairs
    rows = [(1, passage)] + [(None, t) for t in pairs[0]] + [(None, f"{i} {passage}") for i in range(30)] + [(None, f"again {passage}")] * 80
    rows = [(*r, None, None) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = substrings.without_repeats(docs).select("*", substrings.F.sha2("kept_text", 256).alias("sha")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.sha) for r in words) == brute_words(rows)
    cut = suffixes.without_repeats(docs).select("*", suffixes.F.sha2("kept_bytes", 256).alias("sha")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.removed), r.sha) for r in cut) == brute_bytes(rows)
    spans = runs.repeats(docs.select("doc_id", "text"), substrings.word_hashes, 13, 5, False, substrings.around, substrings.extend)
    assert all(len(r["__spans"] or []) <= len(r.text.split()) for r in spans.collect())


def test_runs_cover_each_window_once_and_depend_on_content():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 4, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, _, start, windows, place = runs.anchored_runs(h, 13, 5)
    assert start[0] == 0 and (start[1:] == start[:-1] + windows[:-1]).all() and start[-1] + windows[-1] == 5000 - 12
    assert (place >= start + windows - 1).all() and (place + 5 <= start + 13).all()
    by_window = {}
    for s, w, p in zip(start, windows, place):
        for i in range(s, s + w):
            assert by_window.setdefault(h[i:i + 13].tobytes(), p - i) == p - i


def test_interval_tree_gives_every_repeat():
    rng = random.Random(1)
    for _ in range(200):
        strings = ["".join(rng.choices("ab", k=rng.randint(0, 6))).encode() for _ in range(rng.randint(1, 9))]
        got = {(n, tuple(sorted(m))) for n, m in suffixes.tree(strings, list(range(len(strings))))}
        want = set()
        for a in range(len(strings)):
            for b in range(a):
                n = suffixes.common_prefix(strings[a], strings[b])
                want.add((n, tuple(i for i, s in enumerate(strings) if s[:n] == strings[a][:n])))
        assert got == want
