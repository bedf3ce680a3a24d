import random
import re

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from paylens.llm import mixing, pieces, quality
from paylens.llm.common import staged
from tests.llm.test_repeats import brute_words
from tests.llm.test_simhash import brute_components, brute_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randint(2, 9))) for _ in range(700)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = words(60)
    texts = [words(rng.randint(60, 200)) for _ in range(240)]
    texts += [words(60) + "\n" + passage + "\n" + words(60) for _ in range(12)] + [texts[0]] * 30 + [texts[1] + " tail"]
    texts += [" ".join(w + "%%%" for w in words(90).split()) for _ in range(10)] + ["short", "", None, words(9000)]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, texts[j], ["en", "de"][j % 2], ["src0", "src0", "src1", None][j % 4], len(texts[j] or "")) for i, j in enumerate(order)]
    return [*rows, rows[0], (None, words(70), None, "src1", 1)]


def test_every_stage_against_brute_force(spark):
    extra = {c: F.lit("own") for c in ("removed", "n_removed", "kept", "size", "component_id", "n_tokens", "fingerprint")}
    docs = staged(spark.createDataFrame(corpus(), SCHEMA).withColumns(extra), "docs")
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)

    good = staged(stages[0](spark, docs, ""), "t")
    assert good.columns == names
    stats = staged(quality.with_statistics(docs), "t")
    own = names[:5]
    assert rows(good.select(*own)) == rows(quality.judge(stats, quality.fit(stats)).where("kept").select(*own))
    assert {r.kept for r in good.collect()} == {"own"}
    assert not [r for r in good.collect() if "%%%" in r.text or len(r.text.split()) < 50]
    assert good.count() == len([r for r in corpus() if r[1] and "%%%" not in r[1] and len(r[1].split()) >= 50])

    one = staged(stages[1](spark, good, ""), "t")
    assert one.columns == names
    before = [tuple(r) for r in good.collect()]
    ids = [2**63 - 1 if r[0] is None else r[0] for r in before]
    groups = brute_components(ids, [brute_print(r[1]) for r in before])
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in one.collect()) == sorted(set(groups))

    cut = staged(stages[2](spark, one, ""), "t")
    assert cut.columns == names
    want = {(a, b): (n, gone) for a, b, n, gone, _ in brute_words([(r.doc_id, r.text) for r in one.collect()])}
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in cut.collect():
        n, gone = want[r.doc_id is None, r.doc_id or 0]
        assert len(r.text.split()) == n - gone and r.n_chars == len(r.text) and (gone or r.text == texts[r.doc_id])
    assert sum(gone for _, gone in want.values()) >= 11 * 55

    mix = staged(stages[3](spark, cut, ""), "t")
    assert mix.columns == names and {r.removed + r.size for r in mix.collect()} == {"ownown"}
    plan = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(cut)).collect() if r.taken}
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == plan

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    encoded = stages[4](spark, mix, "").select("doc_id", F.col("ids"), "round_trip").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded)) == sorted(
        (r.doc_id is None, r.doc_id or 0, library.encode(r.text, add_bos=True, add_eos=True)) for r in mix.collect())
    assert all(r.round_trip for r in encoded)


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.count() > 100
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
