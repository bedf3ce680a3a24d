"""Operator 4: licence scans by sparse TF-IDF. DataFrame functions only.

Files are (path, text). Two kinds of passages are compared to templates of their
kind: each line that may be a licence header, and each whole licence file (by its
name). A passage's vector holds term counts times inverse document frequency, which
is counted over all files for the templates' terms; a term of no template weighs as
one that no file has, and only lengthens the passage's vector. A passage takes the
template with the greatest cosine, if that is ``LEAST`` or more. A line's cosine is at
most the length of the part of the template's vector whose terms the line holds; lines
that cannot reach ``LEAST`` so are not counted, which loses none, whatever the document
frequencies. (The SQL has no such bound: it counts every line.)

A licence file is compared to whole licence texts too (``licence_texts``; their terms
weigh as above), and takes one at a cosine of ``WHOLE`` or more: an opening sentence is
diluted over an unabridged file. A line with an SPDX tag is a passage of cosine 1 for
each licence known by name in it (-only, -or-later and + aside).

A file with a passage of its own keeps the best. Any other file inherits from the
nearest directory above it whose licence file was recognised: paths are joined with
the directories by equality, for each ancestor, and the longest wins.

Terms are the runs of a-z and 0-9 of the lower-cased (A-Z) text, with a full stop
between digits. Defined results: a null path is a file in no directory; a null or
empty text has no passage. Equal cosines go to the smaller licence name. Of several
licence files in a directory the best cosine counts, then the smaller name. Rows with
equal paths are files of their own. Extra columns are not read. An empty table gives
no rows. Cosines are rounded to nine places before they are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import staged, table

LEAST = 0.6
#: The least squared length of what a line shares with a template to reach LEAST, less rounding.
SHARED = LEAST * LEAST - 1e-6
#: The least cosine to a whole licence text; other licences' texts and common prose stay below.
WHOLE = 0.9
TEXTS = Path(__file__).with_name("licence_texts")
SPDX = "SPDX-License-Identifier:"
#: File names that hold a whole licence.
LICENCE_FILE = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"

#: Common licence headers (as they stand in one line) and opening texts of licence files.
TEMPLATES = [
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "file", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                           "REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "file", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                             "that the following conditions are met"),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "file", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("GPL-2.0", "header", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "file", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies "
                        "of this license document, but changing it is not allowed"),
    ("LGPL-3.0", "header", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "header", "Released under the MIT License"),
    ("MIT", "file", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "file", "This is free and unencumbered software released into the public domain"),
]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


TERM = r"(?:[0-9]+(?:\.[0-9]+)+|[a-z0-9]+)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *LOWER), F.lit(TERM), 0)


def _whole_texts(idf: dict[str, float], other: float) -> list[tuple]:
    """(license, kind, term, weight, least) of the whole licence texts, with unit length."""
    rows = []
    for path in sorted(TEXTS.glob("*.txt")):
        found = Counter(re.findall(TERM, path.read_text(encoding="utf-8").translate(str.maketrans(*LOWER))))
        weights = {t: n * idf.get(t, other) for t, n in found.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(path.stem, "file", t, w / length, WHOLE) for t, w in sorted(weights.items())]
    return rows


def _needed(headers: list[dict[str, float]], df: dict[str, int]) -> list[str]:
    """Terms of which a line that reaches ``SHARED`` with a header template holds one at
    least: of each template all but the most frequent, which do not reach it together."""
    needed = set()
    for weights in headers:
        left = 0.0
        for t in sorted(weights, key=lambda t: (-df.get(t, 0), t)):
            left += weights[t] ** 2
            if left >= SHARED:
                needed.add(t)
    return sorted(needed)


def _weights(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, dict[str, float], float, list[dict[str, float]], list[str]]:
    """Templates' (license, kind, term, weight, least) with unit length; idf of their terms;
    idf of any other; the header templates' weights; the terms that a header needs."""
    made = spark.createDataFrame(TEMPLATES, "license string, kind string, text string")
    of_template = made.select("license", "kind", F.explode(terms(F.col("text"))).alias("term"))
    known = sorted(r.term for r in of_template.select("term").distinct().collect())  # the templates' terms
    here = F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*[F.lit(t) for t in known]))
    # One scan: the number of files travels as a term of its own.
    held = files.select(F.explode(F.array_append(here, "")).alias("term")).groupBy("term").count().collect()
    df = {r.term: r["count"] for r in held}
    n = df.pop("", 0)
    of_log = spark.createDataFrame([(t, float(df.get(t, 0))) for t in known] + [("", 0.0)], "term string, df double")
    idf = {r.term: r.idf for r in of_log.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")).collect()}
    other = idf.pop("")
    table_of = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    counted = of_template.groupBy("license", "kind", "term").count().join(F.broadcast(table_of), "term")
    weight = F.col("count") * F.col("idf")
    length = F.sqrt(F.sum(weight * weight).over(Window.partitionBy("license", "kind")))
    rows = counted.select("license", "kind", "term", (weight / length).alias("weight"))
    kept = rows.collect()  # as many rows as the templates have terms
    headers: dict[str, dict[str, float]] = {}
    for r in kept:
        if r.kind == "header":
            headers.setdefault(r.license, {})[r.term] = r.weight
    headers = [headers[k] for k in sorted(headers)]
    every = [(*r, LEAST) for r in kept] + _whole_texts(idf, other)
    return spark.createDataFrame(every, "license string, kind string, term string, weight double, least double"), idf, other, headers, _needed(headers, df)


def _tagged(files: DataFrame) -> DataFrame:
    """(file, line, license, score) of the licences that SPDX tags name."""
    names = sorted({x[0] for x in TEMPLATES} | {p.stem for p in TEXTS.glob("*.txt")})
    lines = files.where(F.col("text").contains(SPDX)).select("file", F.posexplode(F.split("text", "\n")).alias("at", "one"))
    ids = F.regexp_extract_all(F.lower(F.substring_index("one", SPDX, -1)), F.lit(r"[a-z0-9.+-]+"), 0)
    tags = lines.where(F.col("one").contains(SPDX)).select("file", (F.col("at") + 1).alias("line"), F.explode(ids).alias("id"))
    known = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    named = tags.select("file", "line", F.try_element_at(known, F.regexp_replace("id", r"(-only|-or-later|\+)$", "")).alias("license"))
    return named.where(F.col("license").isNotNull()).select("file", "line", "license", F.lit(1.0).alias("score"))


def own_licences(files: DataFrame) -> DataFrame:
    """(file, path, text) -> file, license, score and line (1-based; 0 for a whole
    licence file) of each file's best passage."""
    spark = files.sparkSession
    templates, idf, other, headers, needed = _weights(spark, files)
    need = F.array(*[F.lit(t) for t in needed])
    reached = F.greatest(*[sum((F.when(F.array_contains("terms", t), w * w).otherwise(0.0) for t, w in sorted(x.items())), F.lit(0.0)) for x in headers])
    name = F.element_at(F.split("path", "/"), -1)
    whole = files.where(name.rlike(LICENCE_FILE)).select("file", F.lit(0).alias("line"), F.lit("file").alias("kind"), terms(F.col("text")).alias("terms"))
    # Only files that hold a needed term anywhere are cut into lines.
    some = files.where(F.arrays_overlap(terms(F.col("text")), need))
    lines = some.select("file", F.posexplode(F.split("text", "\n")).alias("at", "one"))
    marked = (lines.select("file", (F.col("at") + 1).alias("line"), F.lit("header").alias("kind"), terms(F.col("one")).alias("terms"))
              .where(F.arrays_overlap("terms", need)).where(reached >= SHARED))
    passages = whole.unionByName(marked)
    counts = (passages.select("file", "line", "kind", F.explode("terms").alias("term"))
              .groupBy("file", "line", "kind", "term").agg(F.count("*").alias("n")))
    counts = staged(counts, "licences-terms")  # read for lengths and for products
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    weighed = counts.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    lengths = weighed.groupBy("file", "line", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(F.broadcast(templates), ["kind", "term"]).groupBy("file", "line", "kind", "license", "least").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    score = F.round(F.col("dot") / F.col("length"), 9)
    scored = dots.join(lengths, ["file", "line", "kind"]).select("file", "line", "license", "least", score.alias("score")).where(F.col("score") >= F.col("least"))
    scored = scored.drop("least").unionByName(_tagged(files))
    best = F.min(F.struct((-F.col("score")).alias("s"), "license", "line"))
    return scored.groupBy("file").agg(best.alias("b")).select("file", "b.license", (-F.col("b.s")).alias("score"), "b.line")


def directory(path: Column) -> Column:
    """The part before the last slash; null for a null path."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def scan(files: DataFrame) -> DataFrame:
    """(file, path, text) -> file, path, license, score, line and licence_dir (the
    directory that an inherited licence is from; null for an own one)."""
    own = staged(own_licences(files), "licences-own")
    named = files.select("file", "path").join(own, "file", "left")
    named = staged(named, "licences-files")
    parts = F.split("path", "/")
    given = named.where(F.element_at(parts, -1).rlike(LICENCE_FILE) & F.col("license").isNotNull())
    best = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    dirs = staged(given.groupBy(directory(F.col("path")).alias("dir")).agg(best.alias("b")).select(
        "dir", F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score")), "licences-dirs")
    depth = F.size(parts)
    ancestors = F.transform(F.sequence(F.lit(1), depth), lambda k: F.when(k == 1, F.lit("")).otherwise(
        F.concat(F.concat_ws("/", F.slice(parts, 1, k - 1)), F.lit("/"))))
    bare = named.where(F.col("license").isNull() & F.col("path").isNotNull()).select("file", F.explode(ancestors).alias("dir"))
    near = bare.join(dirs, "dir").groupBy("file").agg(
        F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license", "dir_score")).alias("d"))
    return named.join(near, "file", "left").select(
        "file", "path", F.coalesce("license", F.col("d.dir_license")).alias("license"),
        F.coalesce("score", F.col("d.dir_score")).alias("score"), "line", F.col("d.dir").alias("licence_dir"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the table has no paths, so each gets one of its source and
    id; the first of every hundred is named as a licence file."""
    docs = table(spark, sf_dir, "documents")
    last = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100 % 10"), last)
    found = scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text"))
    return found.withColumnRenamed("file", "doc_id")


def op4_sql() -> str:
    quoted = lambda *t: "({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in t))
    values = ", ".join(quoted(*t) for t in TEMPLATES)
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    unabridged = ", ".join(quoted(*t) for t in texts.items())
    names = ", ".join(quoted(n.lower(), n) for n in sorted({t[0] for t in TEMPLATES} | set(texts)))
    pattern = TERM
    name = LICENCE_FILE.removeprefix("(?i)")
    of = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{LOWER[0]}', '{LOWER[1]}'), '{pattern}')"
    return f"""
WITH files AS (
  SELECT doc_id, text, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/'
         || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE 'doc' || doc_id || '.txt' END AS path FROM documents
), made(license, kind, text) AS (VALUES {values}), unabridged(license, text) AS (VALUES {unabridged}), spdx(id, license) AS (VALUES {names}),
tt AS (SELECT license, kind, unnest({of('text')}) AS term FROM made),
known AS (SELECT DISTINCT term FROM tt),
ft AS (SELECT DISTINCT doc_id, unnest({of('text')}) AS term FROM files),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT k.term, count(ft.term) AS df FROM known k LEFT JOIN ft ON ft.term = k.term GROUP BY k.term),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM df, n),
tt2 AS (SELECT license, kind, {LEAST} AS least, term FROM tt UNION ALL
        SELECT license, 'file', {WHOLE}, unnest({of('text')}) FROM unabridged),
tw AS (SELECT license, kind, least, tt2.term, count(*) * coalesce(any_value(idf), (SELECT ln(1.0 + n) + 1.0 FROM n)) AS w
       FROM tt2 LEFT JOIN idf ON tt2.term = idf.term GROUP BY 1, 2, 3, 4),
tn AS (SELECT license, kind, least, sqrt(sum(w * w)) AS length FROM tw GROUP BY 1, 2, 3),
tpl AS (SELECT license, kind, least, term, w / length AS weight FROM tw JOIN tn USING (license, kind, least)),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS one
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM files)),
lt AS (SELECT doc_id, line, unnest({of('one')}) AS term FROM lines),
tags AS (
  SELECT doc_id, line, unnest(regexp_extract_all(lower(string_split(one, '{SPDX}')[-1]), '[a-z0-9.+-]+')) AS id FROM lines WHERE contains(one, '{SPDX}')
), passage AS (
  SELECT doc_id, line, 'header' AS kind, term, count(*) AS n FROM lt GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT doc_id, 0, 'file', term, count(*) FROM (SELECT doc_id, unnest({of('text')}) AS term FROM files
    WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{name}', 'i')) GROUP BY 1, 2, 3, 4
), w AS (
  SELECT doc_id, line, kind, p.term, p.n * coalesce(idf, (SELECT ln(1.0 + n) + 1.0 FROM n)) AS w FROM passage p LEFT JOIN idf ON idf.term = p.term
), len AS (SELECT doc_id, line, kind, sqrt(sum(w * w)) AS length FROM w GROUP BY 1, 2, 3),
scored AS (
  SELECT w.doc_id, w.line, t.license, t.least, round(sum(w.w * t.weight) / any_value(len.length), 9) AS score
  FROM w JOIN tpl t ON t.term = w.term AND t.kind = w.kind JOIN len ON len.doc_id = w.doc_id AND len.line = w.line AND len.kind = w.kind
  GROUP BY 1, 2, 3, 4
), found AS (
  SELECT doc_id, license, score, line FROM scored WHERE score >= least
  UNION ALL
  SELECT doc_id, license, 1.0, line FROM tags JOIN spdx ON spdx.id = regexp_replace(tags.id, '(-only|-or-later|\\+)$', '')
), own AS (
  SELECT doc_id, license, score, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line) AS r
    FROM found) WHERE r = 1
), named AS (SELECT f.doc_id, f.path, o.license, o.score, o.line FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id),
dirs AS (
  SELECT dir, license, score FROM (SELECT regexp_extract(path, '^(.*/)?') AS dir, license, score,
      row_number() OVER (PARTITION BY regexp_extract(path, '^(.*/)?') ORDER BY score DESC, license) AS r
    FROM named WHERE license IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '{name}', 'i')) WHERE r = 1
), near AS (
  SELECT b.doc_id, d.dir, d.license, d.score, row_number() OVER (PARTITION BY b.doc_id ORDER BY length(d.dir) DESC) AS r
  FROM named b JOIN dirs d ON starts_with(b.path, d.dir) WHERE b.license IS NULL
)
SELECT f.doc_id, f.path, coalesce(f.license, x.license) AS license, coalesce(f.score, x.score) AS score,
       CAST(f.line AS INTEGER) AS line, x.dir AS licence_dir
FROM named f LEFT JOIN near x ON x.doc_id = f.doc_id AND x.r = 1"""
