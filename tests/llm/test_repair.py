import hashlib
import random
import zlib
from functools import lru_cache

from paylens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seq string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        if how == 1:
            text = ""
        if how == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if how == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if how == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:32].encode(),
                                       hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By recursion over rows and what was written last: (cost, audit, turns)."""
    fault = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    named = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, last, inserted):
        tries = []
        if i == len(rows):
            if last in ("", "a"):
                tries.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            cost, audit, turns = best(i + 1, last, 0)
            tries.append((cost + 3, "D" + audit, turns))
            if fault[i] in ("", "truncated"):
                more = int(fault[i] == "truncated")
                if role[:1] and role[0] in follow[last]:
                    cost, audit, turns = best(i + 1, role[0], 0)
                    tries.append((cost + more, "K" + audit, ((role, text), *turns)))
                for x in follow[last]:
                    if x in named:
                        cost, audit, turns = best(i + 1, x, 0)
                        tries.append((cost + 2 + more, "R" + audit, ((named[x], text), *turns)))
        if inserted < 3:
            for x in follow[last]:
                if x in named:
                    cost, audit, turns = best(i, x, inserted + 1)
                    tries.append((cost + 2, "I" + audit, ((named[x], ""), *turns)))
        return min(tries, key=lambda t: t[:2]) if tries else (10**9, "~", ())

    return best(0, "", 0)


def expected(rows):
    rows = in_order(rows)
    fault = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), list(kept)


def messy(n, seed, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", None, "What?", "ok !", "é!", "a", "long " * 3000 + ".", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "s"]
    return [(c, rng.choice([t, t, t, None, 0, t + 2]), rng.choice(roles), rng.choice(texts), "x", "y")
            for c in range(n) for t in range(rng.randint(1, most))]


def check(got, rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert sorted(map(str, (r.conv_id for r in got))) == sorted(map(str, convs))
    for r in got:
        want, _ = expected(damage(convs[r.conv_id]))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want


def test_query_against_brute_force(spark, tmp_path):
    rows = messy(150, 1) + [(None, t, "user", "Hi.", "", "") for t in (None, 1, 2, 3)] + [(1, 0, "user", "same", "", "")] * 3
    rows += [(1000 + c, t, ["system", "user", "assistant"][0 if t == 0 else 1 + (t + 1) % 2], f"{t}.", "", "") for c in range(60) for t in range(7)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    out = repair.op11_conversation_repair(spark, str(tmp_path))
    got = out.collect()
    check(got, rows)
    gone = [r for r in got if not r.audit]
    for r in gone:
        assert r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_pieces_of_a_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 3)
    monkeypatch.setattr(repair, "SHORT", 4)
    rows = [r for r in messy(1, 2, 2) if False] + [(5, *r[1:]) for r in messy(40, 3)] + messy(6, 4)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    check(repair.op11_conversation_repair(spark, str(tmp_path)).collect(), rows)


def test_rules_share_work_and_change_nothing(spark):
    rng = random.Random(7)
    text = ["".join(chr(repair.BEGIN + rng.choice([1, 2, 1, 2, 13, 5])) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    cut = spark.createDataFrame([(i, 0, p) for i, p in enumerate(text)], "conv_id long, block long, piece string")
    rules = repair.repair_rules(cut)
    assert len(rules) > 10 and rules[0][1] in (max(sorted({p[i:i + 2] for p in text for i in range(len(p) - 1)}),
                                                   key=lambda x: sum(p[i:i + 2] == x for p in text for i in range(len(p) - 1))),)
    with_rules, without = repair.Grammar(rules), repair.Grammar([])
    for p in text:
        a, b = with_rules.summary(p), without.summary(p)
        assert a[1:] == b[1:] and {k: (c, str(r)) for k, (c, r) in a.matrix.items()} == {k: (c, str(r)) for k, (c, r) in b.matrix.items()}


def test_repaired_turns_and_empty_table(spark):
    rows = [(c, t, "user" if r is None else r, x or "", "", "") for c, t, r, x, *_ in messy(30, 9)]
    got = {}
    for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for c in range(30):
        mine = [tuple(r[:4]) for r in rows if r[0] == c]
        assert [x[1:] for x in sorted(got.get(c, []))] == expected(mine)[1]
    assert repair.audited(spark.createDataFrame([], SCHEMA)).count() == 0
