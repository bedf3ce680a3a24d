import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from paylens.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def hard_texts():
    rng = random.Random(5)
    alphabet = list("abcdehilnorst  \n\t.,<>/s") + ["▁", "é", "ß", "漢", "😀", "\x00", "\u0301", "\ufeff", "</s>", "<s>", "  "]
    texts = [None, "", " ", "  ", "\n", "\n\n x", " a", "a ", "▁", "▁▁x", "a" * 3000, "the " * 20000, " " * 70, "<0x0A>", "x\n▁y"]
    return texts + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]


def test_encode_equals_library_on_any_text(spark, library):
    texts = hard_texts()
    docs = spark.createDataFrame([(i, t, "old", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, extra double")
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "extra", "n_tokens", "ids", "decoded"}
    together = {r.doc_id: r for r in pieces.encode(docs, decoded=True, rows=100).collect()}
    for r in rows:
        assert (together[r.doc_id].ids, together[r.doc_id].decoded) == (r.ids, r.decoded)
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want)


def test_without_cuts_and_checks(library):
    enc = pieces.MergeEncoder(open(pieces.model_path(), "rb").read())
    enc.cut = None
    texts = [t for t in hard_texts() if t is None or len(t) < 3001]
    for t, x in zip(texts, enc.encode(texts, check=True), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t or "")


def test_both_agendas_agree():
    enc = pieces.MergeEncoder(open(pieces.model_path(), "rb").read())
    for t in hard_texts():
        if t and len(t) < 3001:
            assert enc.agenda(t) == enc.short_agenda(t)


def test_empty_table_and_query(spark, library, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(empty)).count() == 0
    texts = ["Hello\nworld", None, "Hello\nworld", "x" * 50000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pieces.op10_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_bounded_table_of_chunks(monkeypatch, library):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 3)
    enc = pieces.MergeEncoder(open(pieces.model_path(), "rb").read())
    for i in range(30):
        assert np.frombuffer(enc.encode([f"word{i} and{i % 4}"], True)[0], "<u4").tolist() == library.encode(f"word{i} and{i % 4}")
    assert len(enc.young) + len(enc.old) < 30


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb
    spec = pb.ModelProto()
    spec.ParseFromString(open(pieces.model_path(), "rb").read())
    spec.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.MergeEncoder(spec.SerializeToString())
