"""Name matching: the names x payments join (J1) with its predicates (F2-F7) and
the query-dependent identity of a matched row (P11).

A payment row mentions up to six people (covered recipient + PI slots 1-5). We
explode the people, equi-join them with the query table on the normalised
(first, last) keys, check the middle-name rule as the join's residual condition,
and keep one output row per (query, mode, payment row). That last step needs no
shuffle: a match is kept only if no *earlier* slot of the same row matched the
same query, which every exploded copy can decide from the row itself.

Queries with a middle name run twice (``mode`` = ``narrow`` with the middle
name, ``wide`` without), as the disclosure tool does; this is a second row on
the query side, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.constants import SPECIALTY_PI, UNKNOWN
from paylens.functions.text import join_name, strip

# A side is broadcast by hint only if its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20

PAYLOAD = ["source_file", "year", "row_pos", "amount", "identifier", "specialty", "persons"]


def _norm(col: Column, case_sensitive: bool) -> Column:
    return col if case_sensitive else F.lower(col)


def _pf(p: Column, field: str, case_sensitive: bool) -> Column:
    """A person's name field, normalised (the lower-cased copy is precomputed)."""
    return p[field] if case_sensitive else p[field + "_l"]


def prepare_queries(queries: DataFrame, case_sensitive: bool = False,
                    dual: bool = True) -> DataFrame:
    """(query_id, first_name, middle_name, last_name) -> one row per (query, mode).

    Query text is stripped once here; a blank middle name means no middle name.
    With ``dual=False`` a query is searched exactly as given (one mode: ``narrow``
    when it has a middle name, else ``wide``).
    """
    qf = strip(F.col("first_name"))
    ql = strip(F.col("last_name"))
    qm = F.nullif(strip(F.col("middle_name")), F.lit(""))
    both = F.array(F.lit("narrow"), F.lit("wide")) if dual else F.array(F.lit("narrow"))
    modes = F.when(qm.isNotNull(), both).otherwise(F.array(F.lit("wide")))
    q = queries.select(
        "query_id",
        qf.alias("q_first"), qm.alias("q_middle_given"), ql.alias("q_last"),
        F.explode(modes).alias("mode"),
    )
    q_middle = F.when(F.col("mode") == "narrow", F.col("q_middle_given"))
    return q.select("query_id", "mode", "q_first", "q_last", q_middle.alias("q_middle"),
                    *_search_keys(F.col("q_first"), q_middle, F.col("q_last"), case_sensitive))


def _search_keys(first: Column, middle: Column, last: Column, case_sensitive: bool) -> list[Column]:
    """The SPEC columns of a search for stripped names; a null middle is not checked."""
    km = _norm(middle, case_sensitive)
    prefix = F.replace(km, F.lit("."), F.lit(""))
    return [_norm(first, case_sensitive).alias("q_kf"), _norm(last, case_sensitive).alias("q_kl"), km.alias("q_km"),
            prefix.alias("q_mid_prefix"), (F.length(strip(prefix)) == 1).alias("q_mid_initial")]


def _middle_ok(middle_norm: Column) -> Column:
    """F6 core: initial -> prefix match on the dot-free initial, else equality."""
    return F.when(F.col("q_mid_initial"), middle_norm.startswith(F.col("q_mid_prefix"))) \
            .otherwise(middle_norm == F.col("q_km"))


def mask_match(p: Column, case_sensitive: bool) -> Column:
    """the row filter. An absent middle column is not checked."""
    return (
        p["has_name"]
        & (_pf(p, "first", case_sensitive) == F.col("q_kf"))
        & (_pf(p, "last", case_sensitive) == F.col("q_kl"))
        & (F.col("q_km").isNull() | ~p["has_middle"]
           | _middle_ok(_pf(p, "middle", case_sensitive)))
    )


def identity_match(p: Column, case_sensitive: bool) -> Column:
    """the identity check. Names must be non-empty; an absent middle is ''."""
    return (
        (p["first"] != "") & (p["last"] != "")
        & (_pf(p, "first", case_sensitive) == F.col("q_kf"))
        & (_pf(p, "last", case_sensitive) == F.col("q_kl"))
        & (F.col("q_km").isNull() | _middle_ok(_pf(p, "middle", case_sensitive)))
    )


def _slot(i: int) -> Column:
    return F.get(F.col("persons"), i)


N_SLOTS = 6  # covered recipient + PI slots 1-5, fixed by the file format


def identity_slot(case_sensitive: bool) -> Column:
    """Which person names a matched row for its query (P11 order of preference):
    0 = covered person (matching, or as fallback when named), 1-5 = first
    matching PI slot, -1 = nobody (identity 'Unknown'). Integer comparisons
    only; strings are built once from the chosen slot."""
    cov = _slot(0)
    out = F.when(identity_match(cov, case_sensitive), F.lit(0))
    for i in range(1, N_SLOTS):
        out = out.when(identity_match(_slot(i), case_sensitive), F.lit(i))
    named = (cov["first"] != "") & (cov["last"] != "")
    return out.when(named, F.lit(0)).otherwise(F.lit(-1))


def identity_from_slot(slot_col: Column) -> Column:
    """struct(name, specialty) for an identity slot from :func:`identity_slot`."""
    name = F.when(slot_col == -1, F.lit(UNKNOWN))
    for i in range(N_SLOTS):
        p = _slot(i)
        name = name.when(slot_col == i, join_name(p["first"], p["middle"], p["last"]))
    spec = (F.when(slot_col == 0, F.col("specialty"))
            .when(slot_col > 0, F.lit(SPECIALTY_PI)).otherwise(F.lit(UNKNOWN)))
    return F.struct(name.alias("name"), spec.alias("specialty"))


def identity(case_sensitive: bool) -> Column:
    """struct(name, specialty) of a matched row for its query.

    Covered person if it matches -> first matching PI (specialty 'Principal
    Investigator') -> covered person anyway -> ('Unknown', 'Unknown').
    """
    return identity_from_slot(identity_slot(case_sensitive))


def earlier_slot_matches(case_sensitive: bool) -> Column:
    """True when a slot before ``p.slot`` of the same row also matches the query
    (unrolled over the fixed six slots)."""
    slot = F.col("p.slot")
    cond = F.lit(False)
    for i in range(N_SLOTS - 1):
        cond = cond | ((slot > i) & mask_match(_slot(i), case_sensitive))
    return cond


def table_bytes(names: DataFrame) -> int:
    """Measured size of a names table: the bytes of its text and 64 a row."""
    text = [F.octet_length(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c, t in names.dtypes if t == "string"]
    size = F.lit(64)
    for t in text:
        size = size + t
    return names.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def broadcast_if_bounded(side: DataFrame, known_bytes: int | None) -> DataFrame:
    """Broadcast a side whose size is known to be small; else Spark decides from its
    own statistics, and joins by shuffle where those say so (AQE splits a name that
    holds a large share of the rows)."""
    return F.broadcast(side) if known_bytes is not None and known_bytes <= BROADCAST_BYTES else side


SPEC = ["q_kf", "q_kl", "q_km", "q_mid_prefix", "q_mid_initial"]


def search_specs(prepared_queries: DataFrame, single_query: bool = False) -> DataFrame:
    """Distinct normalised searches. Names that normalise alike -- e.g. every
    wide search for the same first and last name -- are matched only once.

    ``spec_hash`` (64-bit) leads the grouping keys downstream so sorts compare
    one long first; the spec columns stay in every key, so a collision is
    harmless."""
    specs = prepared_queries.select(*SPEC)
    if not single_query:  # one query's narrow and wide searches always differ
        specs = specs.distinct()
    return specs.withColumn("spec_hash", F.xxhash64(*SPEC))


def spec_size(query_bytes: int | None) -> int | None:
    """Bytes of the prepared searches at most: two modes, each name in two forms, and keys."""
    return None if query_bytes is None else 6 * query_bytes


def spec_join_keys(left: DataFrame, right: DataFrame) -> list[Column]:
    return [left[c].eqNullSafe(right[c]) for c in SPEC]


def match_specs(payments: DataFrame, specs: DataFrame, *, case_sensitive: bool = False,
                spec_bytes: int | None = None) -> DataFrame:
    """J1 + J3 per search spec: one row per (spec, payment row) that mentions
    the person, with the row's identity for that spec.

    ``payments`` is canonical with valid amounts; ``specs`` has the SPEC
    columns (see :func:`search_specs`). Specs too large to broadcast meet people as
    names and row numbers alone; the payload is attached to the matched rows.
    """
    if spec_bytes is not None and spec_bytes > BROADCAST_BYTES:
        return _match_narrow(payments, specs, case_sensitive)
    # Filter the people inside the array, before the explode: a filter on the
    # exploded struct over explode(array(struct(...))) sends the optimizer into
    # a very long rewrite loop.
    people = F.filter(F.col("persons"),
                      lambda p: p["has_name"] & (p["first"] != "") & (p["last"] != ""))
    exploded = (payments.select(*PAYLOAD, F.explode(people).alias("p"))
                .withColumn("kf", _pf(F.col("p"), "first", case_sensitive))
                .withColumn("kl", _pf(F.col("p"), "last", case_sensitive)))
    q = broadcast_if_bounded(specs, spec_bytes)
    cond = [
        exploded["kf"] == q["q_kf"],
        exploded["kl"] == q["q_kl"],
        F.col("q_km").isNull() | ~F.col("p.has_middle")
        | _middle_ok(_pf(F.col("p"), "middle", case_sensitive)),
    ]
    joined = exploded.join(q, cond, "inner")
    # Q1: a row counts once per search even when several of its slots match.
    earlier_hit = earlier_slot_matches(case_sensitive)
    ident = identity_from_slot(F.col("_id_slot"))
    return (joined.where(~earlier_hit)
            .withColumn("_id_slot", identity_slot(case_sensitive))
            .select("spec_hash", *SPEC, "source_file", "year", "row_pos", "amount",
                    "identifier", ident["name"].alias("name"),
                    ident["specialty"].alias("specialty")))


def _match_narrow(payments: DataFrame, specs: DataFrame, case_sensitive: bool) -> DataFrame:
    """The match for many specs. The shuffle by name carries (source_file, row_pos),
    the names and whether the slot has a middle column; a row that a spec meets in
    several slots is kept once, and only matched rows get their people back."""
    named = F.filter(F.col("persons"), lambda p: p["has_name"] & (p["first"] != "") & (p["last"] != ""))
    slim = F.transform(named, lambda p: F.struct(
        _pf(p, "first", case_sensitive).alias("kf"), _pf(p, "last", case_sensitive).alias("kl"),
        _pf(p, "middle", case_sensitive).alias("km"), p["has_middle"].alias("has_middle")))
    # Archives may repeat a member's name, so a row is known by its content as well.
    content = F.xxhash64("persons", "amount", "identifier")
    people = payments.select(F.col("source_file").alias("_f"), F.col("row_pos").alias("_r"), content.alias("_h"),
                             F.explode(slim).alias("p")).select("_f", "_r", "_h", "p.*")
    met = people.join(specs, [
        F.col("kf") == F.col("q_kf"), F.col("kl") == F.col("q_kl"),
        F.col("q_km").isNull() | ~F.col("has_middle") | _middle_ok(F.col("km"))], "inner")
    hits = met.select("_f", "_r", "_h", "spec_hash", *SPEC).distinct()
    rows = payments.select(*PAYLOAD, content.alias("_own"))
    whole = rows.join(hits, [F.col("source_file").eqNullSafe(F.col("_f")), F.col("row_pos").eqNullSafe(F.col("_r")), F.col("_own") == F.col("_h")], "inner")
    ident = identity_from_slot(F.col("_id_slot"))
    return whole.withColumn("_id_slot", identity_slot(case_sensitive)).select(
        "spec_hash", *SPEC, "source_file", "year", "row_pos", "amount", "identifier",
        ident["name"].alias("name"), ident["specialty"].alias("specialty"))


def attach_queries(per_spec: DataFrame, prepared_queries: DataFrame,
                   query_bytes: int | None = None) -> DataFrame:
    """Fan spec-keyed results out to every (query_id, mode) asking that search."""
    mapping = broadcast_if_bounded(prepared_queries.select("query_id", "mode", *SPEC),
                                   query_bytes)
    joined = per_spec.join(mapping, spec_join_keys(per_spec, mapping), "inner")
    keep = [c for c in per_spec.columns if c not in SPEC and c != "spec_hash"]
    return joined.select("query_id", "mode", *[per_spec[c] for c in keep])


def match_rows(payments: DataFrame, prepared_queries: DataFrame, *,
               case_sensitive: bool = False, query_bytes: int | None = None,
               single: bool = False) -> DataFrame:
    """J1 + J3: one row per (query, mode, payment row) that mentions the person.

    Output: query_id, mode, source_file, year, row_pos, amount, identifier, and
    the identity (name, specialty) of the row for that query.
    """
    bound = spec_size(query_bytes)
    specs = search_specs(prepared_queries, single_query=single)
    matched = match_specs(payments, specs, case_sensitive=case_sensitive, spec_bytes=bound)
    return attach_queries(matched, prepared_queries, bound)


def middle_rule(cell: Column, query_middle: str, case_sensitive: bool = False) -> Column:
    """F6 for a literal query middle name over a cleaned middle-name cell."""
    q = query_middle.strip()
    q = q if case_sensitive else q.lower()
    prefix = q.replace(".", "")
    cell_n = _norm(cell, case_sensitive)
    if len(prefix.strip()) == 1:
        return cell_n.startswith(F.lit(prefix))
    return cell_n == F.lit(q)


def person_predicate(p: Column, first: str, middle: str | None, last: str,
                     case_sensitive: bool = False) -> Column:
    """F2 + F4 + F6 for one person struct against a literal name (row filter rule)."""
    f = first.strip() if case_sensitive else first.strip().lower()
    l = last.strip() if case_sensitive else last.strip().lower()
    pred = (p["has_name"] & (_pf(p, "first", case_sensitive) == F.lit(f))
            & (_pf(p, "last", case_sensitive) == F.lit(l)))
    if middle and middle.strip():
        pred = pred & (~p["has_middle"]
                       | middle_rule(_pf(p, "middle", case_sensitive), middle, case_sensitive))
    return pred


def row_filter(payments: DataFrame, first: str, middle: str | None, last: str, *,
               roles: str = "any", case_sensitive: bool = False) -> DataFrame:
    """payment rows mentioning one literal name -- as covered recipient
    (``roles="covered"``), as any PI slot (``"pi"``) or either (``"any"``).

    A single lookup needs no join: the predicate runs inside the scan stage.
    """
    # The slots one by one: generated code tests the cells, and builds no array of people.
    covered, *slots = [person_predicate(_slot(i), first, middle, last, case_sensitive) for i in range(N_SLOTS)]
    pi = slots[0]
    for p in slots[1:]:
        pi = pi | p
    pred = {"covered": covered, "pi": pi, "any": covered | pi}[roles]
    return payments.where(pred)


def _names_person(p: Column, first: str, middle: str | None, last: str, case_sensitive: bool) -> Column:
    """F7 for one person struct against a literal name; an absent middle is ''."""
    f, l = (x.strip() if case_sensitive else x.strip().lower() for x in (first, last))
    pred = (_pf(p, "first", case_sensitive) == F.lit(f)) & (_pf(p, "last", case_sensitive) == F.lit(l))
    if middle:
        pred = pred & middle_rule(_pf(p, "middle", case_sensitive), middle, case_sensitive)
    return pred


def match_literal(payments: DataFrame, first: str, middle: str | None, last: str, *,
                  case_sensitive: bool = False) -> DataFrame:
    """J1 + J3 for one literal name: (mode, source_file, year, row_pos, amount,
    identifier, name, specialty), as :func:`match_rows` gives for a table of it.

    No person is exploded and nothing is joined: the wide search is a filter in the
    scan's stage, and only rows that pass it are looked at again for the narrow one.
    A name without first or last part matches nothing."""
    first, last = (x or "" for x in (first, last))
    middle = middle if middle and middle.strip() else None
    rows = any_slot_filter(payments.select(*PAYLOAD), first, None, last, case_sensitive=case_sensitive)
    if not (first.strip() and last.strip()):
        rows = rows.where(F.lit(False))
    persons = F.col("persons")

    def search(mode: str, given: str | None) -> Column:
        own = F.transform(persons, lambda p: _names_person(p, first, given, last, case_sensitive))
        slot = (F.array_position(own, F.lit(True)) - 1).cast("int")  # the first matching person, else -1
        named = (_slot(0)["first"] != "") & (_slot(0)["last"] != "")
        slot = F.when((slot == -1) & named, F.lit(0)).otherwise(slot)
        asked = F.struct(F.lit(mode).alias("mode"), slot.alias("slot"))
        if given is None:
            return asked
        return F.when(F.exists(persons, lambda p: person_predicate(p, first, given, last, case_sensitive)), asked)

    searches = [search("wide", None)] + ([search("narrow", middle)] if middle else [])
    hits = rows.select(*PAYLOAD, F.explode(F.array_compact(F.array(*searches))).alias("q"))
    ident = identity_from_slot(F.col("q.slot"))
    return hits.select("q.mode", "source_file", "year", "row_pos", "amount", "identifier",
                       ident["name"].alias("name"), ident["specialty"].alias("specialty"))


def any_slot_filter(payments: DataFrame, first: str, middle: str | None, last: str, *,
                    case_sensitive: bool = False) -> DataFrame:
    """U4: the same row filter written as an OR of the six slot predicates."""
    preds = [person_predicate(F.get(F.col("persons"), i), first, middle, last, case_sensitive)
             for i in range(6)]
    cond = preds[0]
    for p in preds[1:]:
        cond = cond | p
    return payments.where(cond)
