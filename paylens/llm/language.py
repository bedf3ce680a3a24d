"""Operator 3: language identification by error-correcting output codes.

Each language has a codeword; a binary classifier for each bit (logistic
regression over hashed character 1- to 3-grams of the whole text) predicts whether
a text's language has that bit set. Decoding is loss-weighted: of each codeword,
the logistic losses of the bit margins are summed, weighted by how well the bit's
classifier does on that language; the smallest sum wins. ``score`` is its softmax
share, and ``ambiguous`` marks a text whose best two codewords are near each other.

The classifiers are fitted on a bounded sample, ``SAMPLE`` rows over all languages (the
same share for each, one row at least): tasks turn whole texts into feature vectors, and
those are what the driver gets (16 KB a row). ``learn`` leaves out texts of more than
``longest`` characters (``SAMPLE_CHARS`` unless told; None: none), and with them a language
that has no others; the registered query passes None, so that every language with a
labelled text that holds a letter is learned. Prediction reads every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
so is every text where no language can be learned. A single language is always
right, with score 1. A null doc_id is not held out. Rows are predicted by
themselves: repeated rows get equal results, extra columns pass through, and ones
named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import table

BUCKETS, SAMPLE, SAMPLE_CHARS = 4096, 4000, 20_000
STEPS, RATE, DECAY, SEED, NEAR = 150, 0.1, 1e-4, 11, 0.2
#: Languages beyond which codewords are drawn once.
MANY = 512
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> np.ndarray | None:
    """Root shares of the hashed n-grams of the lower-cased letters, with one mark
    for what is between words; None without letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 0)
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]]).astype(np.uint32)
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    a, b = code * np.uint32(0x9E3779B1), code * np.uint32(0x85EBCA77)
    two = a[:-1] ^ (b[1:] >> np.uint32(3))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (a[2:] >> np.uint32(5))
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    count = np.zeros(BUCKETS)
    for grams, salt in ((a[code != 0], 0x27D4EB2F), (two, 0x165667B1), (three, 0x2545F491)):
        mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(salt)
        count += np.bincount((mixed >> shift).astype(np.int64), minlength=BUCKETS)
    return np.sqrt(count / count.sum()).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: every split of up to six
    languages, else the seeded random code with the largest least distance."""
    if n <= 6:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]).T.reshape(n, -1)
    rng, best = np.random.default_rng(SEED), None
    if n > MANY:  # so many bits that random words are far apart
        code = rng.choice([-1, 1], size=(n, 15 * (n - 1).bit_length()))
        return code[:, np.abs(code.sum(axis=0)) < n]
    for _ in range(100):
        code = rng.choice([-1, 1], size=(n, 15 * (n - 1).bit_length()))
        distance = code.shape[1] - code @ code.T
        np.fill_diagonal(distance, 10**6)
        if np.all(np.abs(code.sum(axis=0)) < n) and (best is None or distance.min() > best[0]):
            best = (distance.min(), code)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features and constant, by bit) and the weight of each bit for each
    language, by the share of the language's rows that it gets right."""
    x = np.concatenate([x * 8, np.ones((len(x), 1), np.float32)], axis=1)
    want = code[y].astype(np.float32)
    w, m, v = (np.zeros((x.shape[1], code.shape[1]), np.float32) for _ in range(3))
    each = (1 / np.bincount(y, minlength=len(code))[y] / len(code)).astype(np.float32)[:, None]
    for t in range(1, STEPS + 1):
        g = x.T @ (-want * each / (1 + np.exp(want * (x @ w)))) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = (np.sign(x @ w) == want).astype(float)
    share = np.array([right[y == k].mean(axis=0) for k in range(len(code))]) + 1e-3
    return w, share / share.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, text) -> (lang, place, vector) of texts that have letters."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            found = [features(t.as_py()) for t in part.column(2)]
            some = pa.array([f is not None for f in found])
            yield pa.record_batch([part.column(0).filter(some), part.column(1).filter(some),
                                   pa.array([f.tobytes() for f in found if f is not None], pa.binary())], names=["lang", "place", "vector"])


def learn(docs: DataFrame, longest: int | None = SAMPLE_CHARS) -> dict:
    """(text, lang, doc_id) of the rows to learn from -> the model, a few MB at most."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if longest is not None:
        usable = usable.where(F.length("text") <= longest)
    counts = usable.groupBy("lang").count().collect()  # a row a language
    names = sorted(r.lang for r in counts)
    if not names:
        return {"names": []}
    share = max(1, SAMPLE // len(names))
    place = F.xxhash64(F.lit(SEED), "text", "doc_id")
    rate = F.create_map(*[F.lit(z) for r in counts for z in (r.lang, min(1.0, (2.0 * share + 30) / r["count"]))])
    few = usable.where(F.pmod(place, F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003)
    vectors = few.select("lang", place.alias("place"), "text").mapInArrow(_vectors, "lang string, place long, vector binary")
    row = F.row_number().over(Window.partitionBy("lang").orderBy("place", "vector"))
    rows = vectors.withColumn("__n", row).where(F.col("__n") <= share).drop("__n").collect()
    if missed := sorted(set(names).difference(r.lang for r in rows)):
        one = usable.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by("text", place).alias("text"))
        rows += one.select("lang", F.lit(0).cast("long").alias("place"), "text").mapInArrow(_vectors, "lang string, place long, vector binary").collect()
    number = {n: k for k, n in enumerate(names)}
    kept = [(number[r.lang], np.frombuffer(r.vector, np.float32)) for r in sorted(rows, key=lambda r: (r.lang, r.place, bytes(r.vector)))]
    names = [n for k, n in enumerate(names) if any(y == k for y, _ in kept)]
    seen = sorted({y for y, _ in kept})
    y = np.array([seen.index(a) for a, _ in kept])
    if len(names) < 2:
        return {"names": names}
    code = codewords(len(names))
    weights, share_right = fit(np.array([f for _, f in kept]), y, code)
    return {"names": names, "code": code, "weights": weights, "bits": share_right}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features -> number of the language, score, whether the best two are near."""
    margin = np.concatenate([x * 8, np.ones((len(x), 1), np.float32)], axis=1) @ model["weights"]
    code, bits = model["code"], model["bits"]
    loss = np.stack([(np.logaddexp(0, -margin * code[k]) * bits[k]).sum(axis=1) for k in range(len(code))], axis=1)
    best = loss.argmin(axis=1)
    ordered = np.sort(loss, axis=1)
    part = np.exp(-4 * (loss - ordered[:, :1]))
    return best, 1 / part.sum(axis=1), ordered[:, 1] - ordered[:, 0] < NEAR


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        names = model["names"]
        for batch in batches:
            rows: list[dict] = []
            for a in range(0, len(batch), 256):
                found = [features(t.as_py()) for t in batch.slice(a, 256)]
                some = [f for f in found if f is not None]
                if len(names) > 1 and some:
                    best, score, near = (iter(z.tolist()) for z in decode(np.array(some), model))
                for f in found:
                    if f is None or not names:
                        rows.append({"lang_pred": "und", "score": 0.0, "ambiguous": True})
                    elif len(names) == 1:
                        rows.append({"lang_pred": names[0], "score": 1.0, "ambiguous": False})
                    else:
                        rows.append({"lang_pred": names[next(best)], "score": next(score), "ambiguous": next(near)})
            yield pa.array(rows, kind)

    results = ["lang_pred", "score", "ambiguous"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    return docs.select(*keep, run(F.col(text)).alias("__p")).select(*keep, *[f"__p.{c}" for c in results])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), longest=None)
    told = predict(docs.select("doc_id", "text"), model).drop("text")
    return told.withColumn("held_out", held_out(F.col("doc_id")))
