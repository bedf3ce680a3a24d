import math
import re
from collections import Counter

import duckdb
import pandas as pd

from paylens.llm import licenses

SCHEMA = "file long, path string, text string, license string"


def files():
    prose = "the terms of this work are a form of use and distribution in the public"
    rows = [(i, f"a/b{i % 4}/doc{i}.txt", f"{prose} {i}\nnothing to see here {i}", "clash") for i in range(80)]
    rows += [(100, "a/LICENSE", "Released under the MIT License.", ""), (101, "a/b1/COPYING.txt", licenses.TEMPLATES[10][2], ""),
             (102, "a/b2/LICENSE", "no licence text at all", ""), (103, "x/y/z.py", "# Licensed under the Apache License, Version 2.0 (the 'License');\ncode", ""),
             (104, "a/b3/c/d/deep.txt", "inherits from far above", ""), (105, "top.txt", "no directory", ""), (106, None, "Released under the MIT License", ""),
             (107, None, None, ""), (108, "a/b1/empty", "", ""), (109, "a/b1/n", None, ""), (110, "q/LICENSE", licenses.TEMPLATES[13][2], ""),
             (111, "q/LICENSE", licenses.TEMPLATES[13][2], ""), (112, "q/long.txt", "word " * 60000, ""), (113, "q//odd", "x", ""),
             (114, "r/two.txt", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.", "")]
    return rows


def brute(rows):
    terms = lambda t: re.findall(r"(?:[0-9]+(?:\.[0-9]+)+|[a-z0-9]+)", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    known = {t for _, _, x in licenses.TEMPLATES for t in terms(x)}
    n, df = len(rows), Counter(t for r in rows for t in set(terms(r[2])) & known)
    idf = lambda t: math.log((1 + n) / (1 + df[t] * (t in known))) + 1

    def unit(x):
        c = {t: k * idf(t) for t, k in Counter(x).items()}
        size = math.sqrt(sum(v * v for v in c.values()))
        return {t: v / size for t, v in c.items()} if size else {}

    templates = [(name, kind, unit(terms(x))) for name, kind, x in licenses.TEMPLATES]
    own, is_file = {}, lambda p: p is not None and re.search(licenses.LICENCE_FILE, p.split("/")[-1])
    for f, path, text, _ in rows:
        passages = [(i + 1, "header", terms(x)) for i, x in enumerate((text or "").split("\n"))]
        passages += [(0, "file", terms(text))] if is_file(path) else []
        found = [(-round(s, 9), name, line) for line, kind, x in passages for name, k, t in templates
                 if k == kind and round(s := sum(v * t.get(w, 0) for w, v in unit(x).items()), 9) >= licenses.LEAST]
        own[f] = min(found, default=None)
    dirs = {}
    for f, path, *_ in rows:
        if is_file(path) and own[f]:
            d = path[:path.rfind("/") + 1]
            dirs[d] = min(dirs.get(d, own[f][:2]), own[f][:2])
    out = {}
    for f, path, *_ in rows:
        above = [path[:i + 1] for i, c in enumerate(path) if c == "/"] + [""] if path is not None else []
        d = max((x for x in above if x in dirs), key=len, default=None)
        if own[f]:
            out[f] = (own[f][1], -own[f][0], own[f][2], None)
        else:
            out[f] = (dirs[d][1], -dirs[d][0], None, d) if d is not None else (None, None, None, None)
    return out


def test_scan_equals_brute_force(spark):
    rows = files()
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        a, b, c, d = want[r.file]
        assert (r.license, r.line, r.licence_dir) == (a, c, d) and (r.score is None) == (b is None), (r, want[r.file])
        assert b is None or abs(r.score - b) < 1e-6
    by = {r.file: r for r in got}
    assert by[103].license == "Apache-2.0" and by[104].license == "MIT" and by[104].licence_dir == "a/"
    assert by[1].license == "GPL-3.0" and by[1].licence_dir == "a/b1/" and by[2].licence_dir == "a/" and by[105].license is None
    assert by[106].license == "MIT" and by[112].licence_dir == "q/" and by[114].license in ("MIT", "CC-BY-NC-4.0")


def test_empty_table_and_no_python(spark):
    out = licenses.scan(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_common_headers_and_small_tables_are_scored(spark):
    header = "Released under the MIT License."
    three = [(1, "a/x.txt", f"{header}\nsome code", ""), (2, "b/y.txt", "nothing at all", ""), (3, "c/LICENSE", "Licensed under CC BY 4.0", "")]
    hot = [(i, f"d{i}/doc.txt", f"{header if i % 3 == 0 else 'under the counter'}\nword {i}", "") for i in range(60)]
    for rows, want in ((three, {1: "MIT", 3: "CC-BY-4.0"}), (hot, {i: "MIT" for i in range(0, 60, 3)})):
        got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).where("license IS NOT NULL").collect()
        assert {r.file: r.license for r in got} == want and all(r.score > 0.999 and r.line == 1 for r in got)


def test_the_gate_loses_no_line_that_reaches_the_least_cosine(spark):
    """Every line is scored by brute force, at any document frequency."""
    words = sorted({w for _, kind, x in licenses.TEMPLATES if kind == "header" for w in re.findall(r"[A-Za-z]+", x)})
    rows = [(i, f"{i}.txt", " ".join(words[(i * 7 + j * (1 + i % 3)) % len(words)] for j in range(2 + i % 9)), "") for i in range(150)]
    rows += [(200 + i, f"h{i}.txt", " ".join(x.split()[i % 3:]), "") for i, (_, kind, x) in enumerate(licenses.TEMPLATES * 6) if kind == "header"]
    want = brute(rows)
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.license, r.line) == (want[r.file][0], want[r.file][2]) for r in got) and sum(r.license is not None for r in got) > 60


def test_unabridged_licence_files_and_tags(spark):
    """Whole texts, with other titles and holders, in a table of few files and in one of many."""
    whole = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= set(whole)
    rows = [(i, f"{name}/LICENSE", f"Some Project\n\nCopyright (c) 2021 A. Holder and contributors\n\n{text}", "") for i, (name, text) in enumerate(sorted(whole.items()))]
    rows += [(50 + i, f"{name}/src/code.py", "code", "") for i, name in enumerate(sorted(whole))]
    tags = {70: ("# SPDX-License-Identifier: MIT", "MIT"), 71: ("x\n// SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
            72: ("SPDX-License-Identifier: Foo-1.0", None), 73: ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0")}
    rows += [(i, f"tags/{i}.c", text, "") for i, (text, _) in tags.items()]
    rows += [(80, "prose/LICENSE", "the work of the people and the terms of use in this form are not to be read as any part of it " * 40, "")]
    for more in (0, 300):
        got = {r.file: r for r in licenses.scan(spark.createDataFrame(rows + [(1000 + i, f"p/{i}", f"some words {i}", "") for i in range(more)], SCHEMA)).collect()}
        for i, name in enumerate(sorted(whole)):
            assert (got[i].license, got[i].line) == (name, 0) and got[50 + i].license == name, (name, got[i])
        assert {i: got[i].license for i in tags} == {i: want for i, (_, want) in tags.items()} and got[80].license is None


def test_sql_states_the_querys_rule(spark, tmp_path):
    """Common headers, tags and whole texts, which are many in a small table."""
    whole = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    texts = ["Released under the MIT License\nand more" if i % 3 == 0 else f"the terms of this work\nare under use {i}" for i in range(90)]
    texts[7], texts[8], texts[10] = "# SPDX-License-Identifier: GPL-2.0-or-later", "x\n SPDX-License-Identifier: (MIT OR Apache-2.0+)\n", None
    texts += [f"A project\n\n{t}" for t in whole.values()] + ["", "word " * 5000]
    ids = [*range(90), *[100 * (i + 1) for i in range(len(whole))], 1101, 1102]
    docs = pd.DataFrame({"doc_id": ids, "source": [f"s{i // 300}" for i in ids], "text": texts})
    docs.to_parquet(tmp_path / "documents.parquet")
    got = licenses.op4_license_scan(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = con.sql(licenses.op4_sql()).df()
    rows = lambda x: sorted(tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r)
                            for r in x[["doc_id", "path", "license", "score", "line", "licence_dir"]].astype(object).itertuples(index=False))
    assert rows(got) == rows(want) and got.license.nunique() >= 6
