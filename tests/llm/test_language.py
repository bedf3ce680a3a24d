import random
from zlib import crc32

import numpy as np
import pytest

from paylens.llm import language

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": "the ing and tion er on re st", "bb": "que les ai ré tion eux oi", "cc": "sch ung ein keit ö ß ch lich",
             "dd": "ción los que ar el ñ os", "ee": "ов ение на ст пр", "ff": "的 是 不 了 在", "gg": "zw cz ska ów nie rz"}


def corpus(names="aabbccdd", n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n * len(names) // 2):
        lang = names[i * 2 % len(names):][:2]
        text = " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text.title(), lang if i % 9 else None, "clash"))
    return rows


@pytest.mark.parametrize("names", ["aabb", "aabbccdd", "aabbccddeeffgg"])
def test_held_out_accuracy(spark, names):
    rows = corpus(names) + [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "123 !?", None, "x"), (903, "Über " * 60000, "cc", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(docs.where(~language.held_out(docs.doc_id)))
    assert model["names"] == sorted({names[i:i + 2] for i in range(0, len(names), 2)})
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert out[900].lang_pred == out[901].lang_pred == out[902].lang_pred == "und" and out[902].score == 0
    tested = [r for r in rows if r[0] < 900 and r[2] and crc32(str(r[0]).encode()) % 4 == 2]
    right = sum(out[i].lang_pred == lang for i, _, lang, _ in tested)
    assert len(tested) > 10 and right >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_prediction_does_not_see_id_source_or_lang(spark):
    rows = corpus()
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    text = rows[5][1]
    same = spark.createDataFrame([(1, text, "aa", "x"), (2, text, None, "y"), (None, text, "zz", None), (2, text, None, "y")], SCHEMA)
    out = language.predict(same, model).collect()
    assert len({(r.lang_pred, r.score, r.ambiguous) for r in out}) == 1 and len(out) == 4
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "ambiguous"}


def test_few_languages_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "some text", "aa", "x"), (2, "more", "aa", "x"), (3, "1", "bb", "x")], SCHEMA)
    model = language.learn(one)
    assert [r.lang_pred for r in language.predict(one, model).orderBy("doc_id").collect()] == ["aa", "aa", "und"]
    empty = spark.createDataFrame([], SCHEMA)
    assert language.predict(empty, language.learn(empty)).count() == 0
    assert [r.lang_pred for r in language.predict(one, language.learn(empty)).collect()] == ["und"] * 3


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert least >= (1 if n == 2 else 2 if n == 3 else 8)


def test_query(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op3_language_id(spark, str(tmp_path)).collect()
    for r in out:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)


def test_ambiguity_is_flagged():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(40, language.BUCKETS))).astype(np.float32) / 100
    x[:20, :50] += 0.1
    x[20:, 50:100] += 0.1
    y = np.repeat([0, 1], 20)
    code = language.codewords(2)
    w, bits = language.fit(x, y, code)
    model = {"code": code, "weights": w, "bits": bits}
    best, score, near = language.decode(x, model)
    assert (best == y).all() and not near.any()
    middle = (x[0] + x[25]) / 2
    lo, hi = x[0], x[25]
    for _ in range(40):
        middle = (lo + hi) / 2
        if language.decode(middle[None], model)[0][0] == 0:
            lo = middle
        else:
            hi = middle
    assert language.decode(middle[None], model)[2][0]


def test_a_language_of_long_texts_and_many_languages_are_learned(spark, monkeypatch):
    rows = corpus("aabb", 120)
    rows += [(5000 + i, "sch ung ein keit ö ß " * 1200, "cc", "x") for i in range(30)]
    model = language.learn(spark.createDataFrame(rows, SCHEMA), longest=None)
    assert model["names"] == ["aa", "bb", "cc"]
    out = language.predict(spark.createDataFrame(rows[-30:], SCHEMA), model).collect()
    assert all(r.lang_pred == "cc" for r in out)
    monkeypatch.setattr(language, "SAMPLE", 100)
    many = [(i, chr(0x4E00 + 7 * (i % 300)) * 40, f"l{i % 300:03d}", "x") for i in range(900)]
    model = language.learn(spark.createDataFrame(many, SCHEMA))
    assert len(model["names"]) == 300 and language.codewords(2000).shape[0] == 2000
