"""Operator 10: SentencePiece encoding and decoding of merge-type vocabularies.

``encode`` runs the score-ordered agenda of the merge algorithm: all adjacent
pairs of symbols whose concatenation is a piece wait in a heap by score, then
position; the best is merged and its new neighbours join the heap. Symbols that
are no pieces fall back to their UTF-8 bytes.

No merge crosses a boundary whose two characters stand next to each other in no
piece. A text is therefore cut before each run of the space symbol and around
line feeds (after a look at the vocabulary proves that allowed), and the ids of a
chunk are kept in a bounded table. Each new chunk of an Arrow batch is checked
against the sentencepiece library; a difference raises.

Defined results: null and empty texts have no pieces (only the begin and end
ids) and decode to the empty text. Every row is encoded by itself, so repeated
rows, ties and empty tables need no rule; other columns pass through, and
columns named like the results are replaced. Texts of any length are encoded
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE_SYMBOL = "▁"
#: Chunks whose ids are kept by a worker (two generations of this many) and the
#: longest chunk that is kept, in characters.
KEPT_CHUNKS, KEPT_CHARS = 250_000, 48
#: Up to this many characters the agenda is a list, beyond it a heap.
SHORT, NEVER = 32, float("inf")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class MergeEncoder:
    """Agenda encoder over the pieces of one sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("needs a merge-type model with identity normalisation and no user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [(i, p) for i, p in enumerate(spec.pieces)]
        self.ids = {p.piece: i for i, p in kinds if p.type == 1}
        self.rank = {p.piece: -p.score for i, p in kinds if p.type == 1}
        self.code = {p: pack("<I", i) for p, i in self.ids.items()}
        self.bytes = [pack("<I", self.library.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.byte_fallback, self.unknown = spec.trainer_spec.byte_fallback, pack("<I", self.library.unk_id())
        apart = not any(SPACE_SYMBOL in p.lstrip(SPACE_SYMBOL) or ("\n" in p and len(p) > 1) for p in self.ids)
        self.cut = re.compile(f"{SPACE_SYMBOL}*[^{SPACE_SYMBOL}\n]+|{SPACE_SYMBOL}+|\n").findall if apart else None
        self.line_feed = self.library.encode("\n")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, chunk: str) -> bytes:
        symbols = self.agenda(chunk) if len(chunk) > SHORT else self.short_agenda(chunk)
        try:
            return b"".join(map(self.code.__getitem__, symbols))
        except KeyError:
            return b"".join([self.code.get(s) or self.fallback(s) for s in symbols])

    def fallback(self, symbol: str) -> bytes:
        """The code of a symbol that is no piece."""
        return b"".join(self.bytes[b] for b in symbol.encode()) if self.byte_fallback else self.unknown

    def short_agenda(self, chunk: str) -> list[str]:
        """The agenda of a word as a plain list, one score for each adjacent pair;
        the best pair, leftmost of equals, is found by a scan."""
        get, symbols = self.rank.get, list(chunk)
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def agenda(self, chunk: str) -> list[str]:
        """The agenda as a heap; symbols are linked so that a merge is cheap in a chunk of any length."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            left, j = symbols[i], after[i]
            if not left or j < 0 or left + symbols[j] != piece:
                continue  # one of the pair has been merged meanwhile
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heappush(agenda, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + piece) in rank:
                heappush(agenda, (rank[p], h, p))
        return [s for s in symbols if s]

    def check(self, chunks: list[str], ids: list[bytes]) -> None:
        """The library on the same chunks: the first space symbol of a chunk is the
        one that the library adds itself; any other chunk stands behind a line feed,
        whose pieces come off again."""
        own = [len(c) > 1 and c[0] == SPACE_SYMBOL for c in chunks]
        shown = [c[1:] if o else "\n" + c for c, o in zip(chunks, own, strict=True)]
        for c, o, mine, theirs in zip(chunks, own, ids, self.library.encode(shown, num_threads=1), strict=True):
            if mine != pack(f"<{len(theirs)}I", *theirs)[0 if o else 4 * len(self.line_feed):]:
                raise ValueError(f"agenda and library differ on {c[:80]!r}: {mine[:80].hex()}, {theirs[:20]}")

    def encode(self, texts: list[str | None], check: bool) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end."""
        whole = [SPACE_SYMBOL + t.replace(" ", SPACE_SYMBOL) if t else "" for t in texts]
        if self.cut is None:
            ids = [self.merge(w) if w else b"" for w in whole]
            if check:
                some = [i for i, w in enumerate(whole) if w]
                self.check([whole[i] for i in some], [ids[i] for i in some])
            return ids
        cut = [self.cut(w) for w in whole]
        # Chunks of this batch are all in the young table until the batch is done.
        if len(self.young) > KEPT_CHUNKS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set().union(*cut).difference(young)
        new = [c for c in missing if c not in old]
        merged = [self.merge(c) for c in new]
        if check and new:
            self.check(new, merged)
        young.update((c, old[c]) for c in missing if c in old)
        young.update(zip(new, merged, strict=True))
        out = [b"".join(map(young.__getitem__, c)) for c in cut]
        for c in [c for c in new if len(c) > KEPT_CHARS]:
            del young[c]
        return out


def shared_encoder(model: bytes) -> MergeEncoder:
    """A worker's encoder of a model. Workers are reused, so one task's chunks serve the
    next; the tables stay as bounded as they are (functions here travel by value, hence
    the library's module as the place that a process has once)."""
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("_paylens_encoders", {})
    key = sha256(model).digest()
    if key not in held:
        held.clear()
        held[key] = MergeEncoder(model)
    return held[key]


def _model(spark: SparkSession, path: str):
    """The model, sent to the workers once (its size is the vocabulary's, not the data's)."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return sent


def _texts(library, ids: list[bytes]) -> list[str]:
    """The library's ``decode`` of packed ids."""
    import numpy as np

    return library.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


def encode(docs: DataFrame, path: str | None = None, *, text: str = "text", bos: bool = True, eos: bool = True,
           check: bool = True, decoded: bool = False, rows: int = 512) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned
    32-bit integers) and, if asked for, ``decoded``, the library's ``decode`` of the
    ids in the same pass. Batches are worked ``rows`` texts at a time."""
    model = _model(docs.sparkSession, path or model_path())
    fields = {"n_tokens": ("bigint", pa.int64()), "ids": ("binary", pa.binary())} | (
        {"decoded": ("string", pa.string())} if decoded else {})

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {t}" for n, (t, _) in fields.items()) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = shared_encoder(model.value)
        first = pack("<I", enc.library.bos_id()) if bos else b""
        last = pack("<I", enc.library.eos_id()) if eos else b""
        for batch in batches:
            parts = []
            for a in range(0, len(batch), rows):
                ids = [first + x + last for x in enc.encode(batch.slice(a, rows).to_pylist(), check)]
                columns = [[len(x) // 4 for x in ids], ids] + ([_texts(enc.library, ids)] if decoded else [])
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(columns, fields.values(), strict=True)], list(fields)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, t) for n, (_, t) in fields.items()]))

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in fields]
    out = docs.select(*keep, run(F.col(text)).alias("__pieces"))
    return out.select(*keep, *[f"__pieces.{n}" for n in fields])


def decode(encoded: DataFrame, path: str | None = None, *, ids: str = "ids", rows: int = 256) -> DataFrame:
    """``encoded`` with ``decoded``: the library's ``decode`` of each row's ids."""
    model = _model(encoded.sparkSession, path or model_path())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            texts: list[str] = []
            for a in range(0, len(batch), rows):
                texts += _texts(library, [x or b"" for x in batch.slice(a, rows).to_pylist()])
            yield pa.array(texts, pa.string())

    return encoded.withColumn("decoded", run(F.col(ids)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
