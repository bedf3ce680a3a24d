import random

import numpy as np
import xxhash

from paylens.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, component_id string"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min((y for y in (least.get(r), x) if y is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefÉé", k=rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(150)]
    for _ in range(300):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "ONE", "two words", "a b c", "a b c d", "hot copy of a text"] + ["hot copy of a text"] * 200 + ["x " * 70000]
    rows = [(rng.randrange(10**6), t, "en", rng.choice(["s", None]), "clash") for t in texts]
    return rows + [rows[0], rows[0], (rows[1][0], "another text under an id that is taken", None, None, "c"), (None, texts[3], None, None, "c")]


def test_components_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "TILE", 16)
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [brute_print(r[1]) for r in rows]
    want = sorted((r[0] is None, r[0] or 0, f"{p:016x}", c) for r, p, c in
                  zip(rows, prints, brute_components([r[0] for r in rows], prints), strict=True))
    got = simhash.op7_simhash(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want


def test_links_of_random_prints(spark, monkeypatch):
    """Prints with flipped bits, in leaves and tiles far smaller than in use."""
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "TILE", 32)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)}  # a dense group
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    got = {r.u: r.root for r in simhash.components(simhash.links(df)).collect()}
    ids = brute_components(signed, prints)
    assert [got.get(s, s) for s in signed] == ids


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(r[1]) for r in rows]
    big = 2**63 - 1
    want = set(brute_components([big if r[0] is None else r[0] for r in rows], prints))
    got = [big if r.doc_id is None else r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_leaf_classes_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        x = np.unique(rng.integers(0, 2**16, n).astype(np.uint64) * np.uint64(0x0001000100010001) ^ rng.integers(0, 4, n).astype(np.uint64))
        signed = x.view(np.int64)
        want = brute_components([int(v) for v in signed], [int(v) for v in x])
        assert simhash.leaf_classes(x, 4, block=16).tolist() == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.without_near_duplicates(empty).count() == 0
