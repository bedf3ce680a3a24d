"""Operator 11: conversation structure repair by grammar-compressed dynamic programming.

A row of a conversation has a role (its initial: s, u, a, or another) and at most one
fault; each of the sixteen combinations is a symbol. The cheapest edits that give role
initials ``(s?(ua)+)?`` come from an automaton of four states (nothing yet, after s,
after u, after a): a symbol is a 4 x 4 min-plus matrix of (cost, audit), and edits are
concatenated ropes of D, I, K and R. Insertions follow the row that they stand behind;
those before the first row are a matrix of their own.

1. Rows are ordered once over the whole table (by conversation, turn, role, text) and
   numbered, so that a conversation of any length is spread over tasks. A row is a
   duplicate if it is not the first of its conversation, role and text.
2. Rows become strings of symbols: a piece per conversation and block of ``PIECE`` rows.
3. Re-Pair: the most frequent pairs of neighbouring symbols over all distinct pieces
   become rules, round by round, until no pair occurs twice or ``RULES`` rules exist.
   Rules only shorten the work; results do not depend on them.
4. Bottom-up, a rule's summary is that of its two symbols: matrix, counts of faults,
   first and last role, illegal neighbours. Pieces are products of few summaries, and a
   task computes equal pieces once.
5. A conversation's pieces are folded in order from the start state.
6. Its rows stream by in order with the audit, which names the repaired turns.

The last step is sequential in a conversation by definition (one digest of one text, and
an audit of a letter a row); it holds the audit, never the rows.

Defined results: a null in any column counts as one space. Rows of a null conversation
id form one conversation. Equal rows are rows of their own. Rows of one turn are
ordered by role, the text's first 32 characters and its digest. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import staged, table

PIECE_BITS = 12
#: Rows of a piece.
PIECE = 2**PIECE_BITS
#: Symbols of a piece that a task remembers with its product.
SHORT = 64
#: Rules of the grammar at most, and rounds that look for them.
RULES, ROUNDS = 96, 8
#: Roles by initial, faults, and the cost of the edits.
INITIALS, FAULTS = "sua", ["", "blank", "duplicate", "truncated"]
REROLE, DELETE, INSERT, UNDELETED = 2, 3, 2, 1
ENDS = (0, 3)
BEGIN = 0x4E00  # symbols are the characters from here on
SAID = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"


class Rope:
    """A concatenation of two audits, joined to a string when it is needed."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text

    def __str__(self) -> str:
        if self.text is None:
            out, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.text is not None:
                    out.append(rope.text)
                else:
                    todo += [rope.right, rope.left]
            self.text, self.left, self.right = "".join(out), None, None
        return self.text

    def __lt__(self, other: Rope) -> bool:
        return str(self) < str(other)


NONE = Rope("")


def join(left: Rope, right: Rope) -> Rope:
    return right if left is NONE else left if right is NONE else Rope(None, left, right)


Entry = tuple[int, Rope]
#: (from, to) -> cheapest edits, the ASCII-least of equals; an absent pair is impossible.
Matrix = dict[tuple[int, int], Entry]


class Summary(NamedTuple):
    """What a run of rows adds up to."""

    matrix: Matrix
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: int
    last: int


def least(a: Entry | None, b: Entry) -> Entry:
    if a is None or b[0] < a[0]:
        return b
    return b if b[0] == a[0] and b[1] < a[1] else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, q), (x, left) in a.items():
        for (q2, r), (y, right) in b.items():
            if q == q2 and ((p, r) not in out or x + y <= out[p, r][0]):
                out[p, r] = least(out.get((p, r)), (x + y, join(left, right)))
    return out


def _insertions() -> Matrix:
    one = {(0, 2): (INSERT, Rope("I")), (1, 2): (INSERT, Rope("I")), (2, 3): (INSERT, Rope("I")), (3, 2): (INSERT, Rope("I"))}
    none = {(p, p): (0, NONE) for p in range(4)}
    out = dict(none)
    for _ in range(3):
        out = product(out, none | one)
    return out


INSERTED = _insertions()


def legal(a: int, b: int) -> bool:
    """Whether initials b may follow a: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def symbol(role: int, fault: int) -> Summary:
    """``role``: a place in INITIALS, or 3 for another."""
    edits: Matrix = {(p, p): (DELETE, Rope("D")) for p in range(4)}
    if fault in (0, 3):
        more = UNDELETED if fault == 3 else 0
        to_user, to_assistant = [(0, 2), (1, 2), (3, 2)], [(2, 3)]
        kept = {0: [(0, 1)], 1: to_user, 2: to_assistant, 3: []}[role]
        for step in to_user + to_assistant:
            edits[step] = least(edits.get(step), (REROLE + more, Rope("R")))
        for step in kept:
            edits[step] = least(edits.get(step), (more, Rope("K")))
    return Summary(product(edits, INSERTED), int(fault == 1), int(fault == 2), int(fault == 3), 0, role, role)


def after(a: Summary, b: Summary) -> Summary:
    return Summary(product(a.matrix, b.matrix), a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
                   a.illegal + b.illegal + (not legal(a.last, b.first)), a.first, b.last)


class Grammar:
    """Rules (symbol, pair) in the order in which they were found, and a summary each."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.known = {chr(BEGIN + 4 * fault + role): symbol(role, fault) for role in range(4) for fault in range(4)}
        for name, (left, right) in rules:  # bottom-up: a rule's parts are older than it
            self.known[name] = after(self.known[left], self.known[right])

    def summary(self, piece: str) -> Summary:
        for name, pair in self.rules:
            piece = piece.replace(pair, name)
        parts = [self.known[c] for c in piece]
        while len(parts) > 1:
            parts = [after(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as ``crc32("conv_id:turn") % 20`` damages them."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    told = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                       (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("__how"))
    text = F.when(F.col("__how") == 1, "").when(F.col("__how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__how") == 3, 2).otherwise(1)
    return (told.where("__how != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), copies)))
            .drop("col"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order over the whole table, with ``seq``,
    their place, and ``digest`` of the text. The ranges are told by short keys; the
    scan's row number comes last, so that equal rows are spread too."""
    told = rows.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")],
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("__row"))
    keyed = told.withColumn("digest", F.sha2("text", 256)).withColumn("__head", F.left("text", F.lit(32)))
    keys = ["conv_id", "turn", "role", "__head", "digest", "__row"]
    sort = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(sort.drop("__row", "__head").withColumn("seq", F.monotonically_increasing_id()), "mend-rows")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, symbol) of ordered rows."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("__first")).select("__first")
    told = rows.select("conv_id", "seq", F.left("role", F.lit(1)).alias("i"), F.col("text").rlike(SAID).alias("said"),
                       F.right(F.btrim("text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?").alias("whole"))
    fault = (F.when(~F.col("said"), 1).when(F.col("__first").isNull(), 2).when(~F.col("whole"), 3).otherwise(0))
    role = F.when(F.col("i") == "s", 0).when(F.col("i") == "u", 1).when(F.col("i") == "a", 2).otherwise(3)
    at = (F.lit(4) * fault + role).cast("int")
    names = F.array(*[F.lit(chr(BEGIN + i)) for i in range(16)])
    both = told.join(first, F.col("seq") == F.col("__first"), "left")
    return both.select("conv_id", "seq", F.get(names, at).alias("symbol"))


def pieces(symbols_: DataFrame) -> DataFrame:
    """(conv_id, block, piece): the symbols of a conversation in a block of rows."""
    got = symbols_.groupBy("conv_id", F.shiftright("seq", PIECE_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "symbol"))).alias("__s"))
    return got.select("conv_id", "block", F.array_join(F.col("__s.symbol"), "").alias("piece"))


def repair_rules(cut: DataFrame, most: int = RULES, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """Rules of a Re-Pair grammar over all pieces. A round takes, by falling frequency,
    pairs of which none can overlap another, and replaces them everywhere."""
    rules: list[tuple[str, str]] = []
    left = staged(cut.groupBy("piece").agg(F.count("*").alias("n")), "mend-pieces")
    for _ in range(rounds):
        at = F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("at")
        pairs = (left.where(F.length("piece") > 1).select("piece", "n", at)
                 .groupBy(F.substring(F.col("piece"), F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))
                 .where("n > 1").orderBy(F.desc("n"), "pair").limit(most - len(rules)).collect())  # at most RULES pairs
        heads: set[str] = set()
        tails: set[str] = set()
        fresh = []
        for row in pairs:
            a, b = row["pair"]
            if a != b and a not in tails and b not in heads or a == b and a not in heads | tails:
                heads.add(a)
                tails.add(b)
                fresh.append((chr(BEGIN + 16 + len(rules) + len(fresh)), row["pair"]))
        if not fresh:
            break
        rules += fresh
        if len(rules) >= most:
            break
        piece = F.col("piece")
        for name, pair in fresh:
            piece = F.replace(piece, F.lit(pair), F.lit(name))
        left = staged(left.select(piece.alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")), "mend-round")
    return rules


FOLDED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def fold(cut: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        short = lru_cache(2**13)(grammar.summary)
        begin = {k: v for k, v in INSERTED.items() if k[0] == 0}
        one = lru_cache(2**13)(lambda piece: closed(whole(None, grammar.summary(piece))))

        def shared(piece: str) -> Summary:  # long pieces are seldom equal, and their audits large
            return short(piece) if len(piece) <= SHORT else grammar.summary(piece)

        def whole(so_far: Summary | None, more: Summary) -> Summary:
            if so_far is None:
                return more._replace(matrix=product(begin, more.matrix))
            return after(so_far, more)

        def closed(s: Summary) -> tuple:
            cost, audit = min((s.matrix[0, q] for q in ENDS if (0, q) in s.matrix), key=lambda e: (e[0], str(e[1])))
            return s.blank, s.duplicate, s.truncated, s.illegal, cost, str(audit)

        conv: object = run  # no conversation yet
        held: str | None = None  # a conversation's only piece so far
        total: Summary | None = None
        out: list[tuple] = []

        def give() -> None:
            if conv is not run:
                alone = one if len(held) <= SHORT else one.__wrapped__
                out.append((conv, *(alone(held) if total is None else closed(total))))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)],
                                   names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for batch in batches:
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv is run or c != conv:
                    give()
                    conv, held, total = c, piece, None
                else:
                    total = whole(whole(None, shared(held)) if total is None else total, shared(piece))
            if out:
                yield batch_of(out)
                out = []
        give()
        if out:
            yield batch_of(out)

    near = cut.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return near.select("conv_id", "piece").mapInArrow(run, FOLDED)


def turns(rows: DataFrame, folded: DataFrame, digest: bool) -> DataFrame:
    """The repaired turns (conv_id, place, role, text), or one ``repaired_sha256`` of
    each conversation, from ordered rows and their conversations' audits."""
    schema = "conv_id long, repaired_sha256 string" if digest else "conv_id long, place long, role string, text string"
    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "place", "role", "text"]
    types = [pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = sha = None
        at = place = 0
        users_turn = True
        out: list[tuple] = []

        def put(role: str | None, text: str) -> None:
            nonlocal place, users_turn
            if role is None:
                role = "user" if users_turn else "assistant"
            users_turn = role[:1] != "u"
            if digest:
                sha.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            else:
                out.append((conv, place, role, text))
            place += 1

        def inserted() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                at += 1
                put(None, "")

        def closed() -> None:
            if audit is not None:
                if at != len(audit):
                    raise ValueError(f"the audit of conversation {conv} does not end with its rows")
                if digest:
                    out.append((conv, sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for c, mine, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if mine is not None:  # a conversation's audit comes before its rows
                    closed()
                    conv, audit, sha, at, place, users_turn = c, mine, hashlib.sha256(), 0, 0, True
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put(None, text)
                inserted()
            if out:
                yield batch_of()
        closed()
        if out:
            yield batch_of()

    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "seq", none.alias("audit"), "role", "text").unionByName(
        folded.select("conv_id", F.lit(-1).cast("long").alias("seq"), "audit", none.alias("role"), none.alias("text")))
    near = both.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return near.select("conv_id", "audit", "role", "text").mapInArrow(run, schema)


def _folded(rows: DataFrame) -> DataFrame:
    cut = staged(pieces(symbols(rows)), "mend-cut")
    return staged(fold(cut, repair_rules(cut)), "mend-audits")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns of each conversation: conv_id, place (from 0), role, text."""
    rows = ordered(conversations)
    return turns(rows, _folded(rows), digest=False)


def audited(conversations: DataFrame) -> DataFrame:
    """Per conversation with a row: gaps, counts of faults, illegal neighbours, cost,
    audit and the digest of the repaired turns."""
    rows = ordered(conversations)
    folded = _folded(rows)
    span = rows.groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    gaps = span.select(F.col("conv_id").alias("__c"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    said = turns(rows, folded, digest=True).withColumnRenamed("conv_id", "__t")
    return (folded.join(gaps, F.col("conv_id").eqNullSafe(F.col("__c"))).join(said, F.col("conv_id").eqNullSafe(F.col("__t")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired; one of which no row is
    left has zeros, an empty audit and the digest of an empty string."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = audited(damaged(rows)).withColumnRenamed("conv_id", "__c")
    all_ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
