import re

from pyspark.sql import functions as F

from paylens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, n_chars long"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: float(cap * sizes[s]) for s in names}
        share = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in free)
        more = {s for s in free if w[s] * share > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in full else w[s] * share for s in names}
        full |= more


def brute_seats(wants, seats):
    got = [0] * len(wants)
    for _ in range(seats):
        i = max(range(len(wants)), key=lambda i: (wants[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def rows():
    out = [(i, "word " * (i * 7 % 90), ["a", "b", "é", None, "tiny", "Z"][i % 11 % 6], "x", 1) for i in range(400)]
    out += [(1000, "long " * 40000, "a", "x", 1), (1001, None, "a", "x", 1), (1002, "", None, "x", 1), (None, "no id here", "b", "x", 1),
            (7, "same row", "b", "x", 1), (7, "same row", "b", "x", 1), (7, "other text of the id", "b", "x", 1), (1003, "one", "rare", "x", 1)]
    return out


def test_targets_and_takings(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix(mixing.sized(docs), cell=2000).collect()
    assert len(got) == len(rows())
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] + r.part
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(mixing.BLOCK * 3, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(mixing.sized(docs.repartition(5)), cell=2000).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_key, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_quotas_are_sainte_lague(spark):
    import random
    rng = random.Random(2)
    cells = [(f"s{i}", i, s, 10, rng.choice([rng.random() * 5, rng.random() * 400])) for s in range(12) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame([(f"{s}-{a}", b, w, want, s) for a, b, s, w, want in cells], "source string, cell long, words long, want double, shard long")
    out = {(r.source, r.cell): r.blocks for r in mixing._quotas(df, 8).collect()}
    for s in range(12):
        mine = [c for c in cells if c[2] == s]
        wants = [c[4] for c in mine]
        seats = brute_seats(wants, int(sum(wants) / 8 + 0.5))
        assert [out[f"{s}-{c[0]}", c[1]] for c in mine] == seats


def test_mixed_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plan = mixing.mix(mixing.sized(docs)).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.t for r in plan if r.t}


def test_empty_tables_and_no_python(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a", "x", 1), (2, "", None, "x", 1)], SCHEMA)
    out = mixing.mix(mixing.sized(none))
    assert [(r.taken, r.target) for r in out.collect()] == [(0, 0.0)] * 2
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
