import hashlib
import random

from paylens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def hard_rows():
    rng = random.Random(3)
    bits = ["### ", "###", "</turn>", "\\", "\n", " ", "a", "Assistant:", "\n</turn>\n", "\\</turn>", "$1", "%0A", "é😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "### x", "%25", "\\n", "</turn>"]),
             "".join(rng.choices(bits, k=rng.randint(0, 9))), "clash") for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(None, None, None, None, "x"), (None, 2, "user", None, "x"), (7, 1, "user", "same", "x"), (7, 1, "user", "same", "x"),
             (-7, 0, "user", chat.HOSTILE, ""), (-7, 1, "assistant", chat.HOSTILE, ""), (99, 0, "assistant", "long " * 50000, "")]
    return rows


def brute(rows):
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), x.decode()) for _, r, x in sorted(v)] for c, v in convs.items()}


def test_round_trip_and_loss_mask(spark):
    rows = hard_rows()
    want = brute(rows)
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        spans = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        for s, x in zip(spans, [x for role, x in turns if role == "assistant"], strict=True):
            assert s == x or s.replace("\\### ", "### ").replace("\\</turn>", "</turn>") == x
        assert r.n_escaped >= 2 if r.conv_id == -7 else True
    plain = next(r for r in got if r.conv_id == 99)
    assert plain.n_escaped == 0 and plain.formatted == "### assistant\n" + "long " * 50000 + "\n</turn>\n"


def test_query_digests(spark, tmp_path):
    rows = [r for r in hard_rows() if r[0] != -7]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(rows) | {-7: [("user", chat.HOSTILE), ("assistant", chat.HOSTILE)]}
    got = chat.op8_chat_format(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table_and_no_python(spark):
    out = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
