"""Secret scans by an inverted index of trigrams, in DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import id_and_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of a pattern whose group has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order (fixed values).
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ with 16 characters or more
)
#: Kinds added to the base: the published shapes of widespread credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)

_MOST = 64
#: Matches of a text that are placed one after the other; longer lists go in chunks of so many.
CHUNK = 256


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _minimal(ways: set[frozenset[str]]) -> set[frozenset[str]]:
    return {w for w in ways if not any(o < w for o in ways)}


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """Sets of trigrams of which every match's text, in lower case, holds at least one set whole; None: any text may match.

    Literals, alternatives, small classes and optional parts are followed as sets of exact
    strings; where these end, each string's trigrams become one way, and ways of parts in a row
    are joined pair by pair.
    """
    query, exact = _walk(sre_parse.parse(pattern))
    return _and(query, _of(exact))


def _of(exact: set[str]) -> set[frozenset[str]] | None:
    return _minimal({_grams(s) for s in exact}) if exact and all(len(s) > 2 for s in exact) else None


def _and(a: set[frozenset[str]] | None, b: set[frozenset[str]] | None) -> set[frozenset[str]] | None:
    if a is None or b is None:
        return b if a is None else a
    both = _minimal({x | y for x in a for y in b})
    return both if len(both) <= _MOST else min(a, b, key=len)


def _walk(items) -> tuple[set[frozenset[str]] | None, set[str]]:
    """(ways that hold so far, exact strings with which the text read last ends)."""
    query, exact = None, {""}
    for op, arg in items:
        new: set[str] | None = None
        flush = False
        if op is sre.LITERAL:
            new = {chr(arg).lower()}
        elif op is sre.IN and len(arg) <= 6 and all(o is sre.LITERAL for o, _ in arg):
            new = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            inner, new = _walk(arg[3])
            query = _and(query, inner)
            flush = inner is not None
        elif op is sre.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(q is None for q, _ in sides):
                new = set().union(*(e for _, e in sides))
            else:
                whole = [_and(q, _of(e)) for q, e in sides]
                query = _and(query, None if any(w is None for w in whole) else _minimal(set().union(*whole)))
        elif op is sre.MAX_REPEAT:
            inner, strings = _walk(arg[2])
            plain = inner is None and strings != {""}
            if arg[:2] == (0, 1) and plain:
                new = strings | {""}
            elif arg[0] and plain:
                new, flush = strings, True
        elif op is sre.AT:
            continue
        joined = {a + b for a in exact for b in new} if new is not None else set()
        if new is None or len(joined) > _MOST:
            query, exact = _and(query, _of(exact)), {""}
            if new is not None:
                exact = new
        else:
            exact = joined
        if flush:
            query, exact = _and(query, _of(exact)), {""}
    return query, exact


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, digest): the documents whose text in lower case holds each trigram asked for."""
    listed = F.array(*[F.lit(g) for g in grams])
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(listed, lambda g: low.contains(g)))[0]
    return keyed.select("doc_id", "digest", F.explode(held).alias("gram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, digest, kinds): the kinds whose trigram query a document meets, for rules that have one."""
    ways = [(r.kind, n, g, len(w)) for r in rules for n, w in enumerate(sorted(map(sorted, trigram_query(r.pattern) or []))) for g in w]
    spark = keyed.sparkSession
    terms = spark.createDataFrame([(k, n, g, need) for k, n, g, need in ways], "kind string, way int, gram string, need int")
    found = postings(keyed, sorted({g for _, _, g, _ in ways}))
    met = (
        found.join(F.broadcast(terms), "gram")  # the rules' own trigrams, a few hundred rows
        .groupBy("doc_id", "digest", "kind", "way")
        .agg(F.countDistinct("gram").alias("held"), F.first("need").alias("need"))
        .filter("held = need")
    )
    return met.groupBy("doc_id", "digest").agg(F.collect_set("kind").alias("kinds"))


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _chunked(items: Column) -> Column:
    """An array as arrays of CHUNK items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _running(items: Column, none: Column, total, step) -> Column:
    """step() over items in order, for out of its state (at, out), an array; at begins at 0.

    Appending to an array copies it, so items go in chunks: total(at, chunk) carries the state
    over a chunk, and the chunks are then run each from where it begins.
    """

    def run(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        firsts = F.aggregate(chunks, zero, lambda a, c: F.struct(total(a["at"], c).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, firsts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    return F.when(F.size(items) > 0, _bound(_chunked(items), run)).otherwise(none)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, end, kind) of a rule's matches, in code points.

    Matches and the gaps between them alternate, so their lengths add up to positions.
    """
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")

    def sized(held: Column) -> Column:
        value = (lambda h: F.regexp_extract(h, rule.pattern, rule.group)) if rule.group else (lambda h: h)
        return F.zip_with(
            F.slice(held["gaps"], 1, F.size(held["hits"])),
            held["hits"],
            lambda g, h: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(h).cast("long").alias("hit"), (F.char_length(value(h)) >= rule.least).alias("keep")),
        )

    def total(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, at, lambda a, x: a + x["gap"] + x["hit"])

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["keep"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    held = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(rule.pattern), _bound(_bound(held, sized), lambda x: _running(x, none, total, step))).otherwise(none)


def _all(text: Column, rules: tuple[Rule, ...], kinds: Column) -> list[Column]:
    out = []
    for n, rule in enumerate(rules):
        found = spans(text, rule, n)
        if trigram_query(rule.pattern) is not None:
            none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
            found = F.when(F.array_contains(kinds, rule.kind), found).otherwise(none)
        out.append(found.alias(f"s{n}"))
    return out


def listed(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _verified(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """docs with digest and, as s0, s1 and so on, the verified spans of each rule.

    docs needs doc_id and text (not null). Keys meet null-safely, so rows without an id keep theirs.
    """
    keyed = docs.withColumn("digest", F.xxhash64("text"))
    found = candidates(keyed.select("doc_id", "digest", "text"), rules).withColumnsRenamed({"doc_id": "c_id", "digest": "c_digest"})
    joined = keyed.join(found, (keyed.digest == found.c_digest) & keyed.doc_id.eqNullSafe(found.c_id), "left")
    return joined.select(*docs.columns, *_all(F.col("text"), rules, F.coalesce("kinds", F.array().cast("array<string>"))))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256, spans of every row.

    A null or empty text has no spans. Rows with a null doc_id and repeated rows stay, each with
    its own spans; an empty table gives no rows; other columns are not read. Texts are scanned whole. Rules with mandatory
    trigrams are verified on the documents that the index names, the others on all.
    """
    rules = (*base, *added)
    found = _verified(id_and_text(docs), rules)
    names = [f"s{n}" for n in range(len(rules))]
    both = found.select("doc_id", *[F.size(n).cast("long").alias(f"n_{r.kind}") for n, r in zip(names, base, strict=False)], F.array_sort(F.concat(*names[: len(base)])).alias("b"), F.array_sort(F.concat(*names)).alias("a"))
    return both.select("doc_id", *[f"n_{r.kind}" for r in base], F.sha2(listed(F.col("b")), 256).alias("base_sha256"), listed(F.col("a")).alias("spans"))


def redact(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """docs, all columns, with every secret in text replaced by its kind in brackets; n_chars follows the text.

    Overlapping spans become one, named by the first. A null text stays null; empty texts, null
    doc_ids and repeated rows stay, each with its own spans; an empty table stays empty.
    """
    rules = (*base, *added)
    inner = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _verified(inner, rules).select("text", "row", F.array_sort(F.concat(*[f"s{n}" for n in range(len(rules))])).alias("a"))
    new = found.select("row", F.when(F.col("row.text").isNotNull(), without(F.col("text"), F.col("a"))).alias("clean"))
    out = {"text": F.col("clean")} | ({"n_chars": F.char_length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return new.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without(text: Column, found: Column) -> Column:
    """text with sorted spans replaced by their kinds in brackets, overlapping ones by the first."""
    none = F.array().cast("array<struct<from:bigint,to:bigint,kind:string>>")

    def total(at: Column, chunk: Column) -> Column:
        return F.greatest(at, F.array_max(F.transform(chunk, lambda s: s["end"])))

    def step(a: Column, s: Column) -> Column:
        piece = F.struct(a["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    def part(t: Column, start: Column, stop: Column) -> Column:
        return t.substr((start + 1).cast("int"), (stop - start).cast("int"))

    def joined(chunk: Column) -> Column:
        # places are counted from the chunk's own text, not from the beginning of a long one
        low = chunk[0]["from"]
        own = part(text, low, F.element_at(chunk, -1)["to"])
        return _bound(own, lambda t: F.array_join(F.transform(chunk, lambda p: F.concat(part(t, p["from"] - low, p["to"] - low), F.lit("["), p["kind"], F.lit("]"))), ""))

    def whole(pieces: Column) -> Column:
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(_chunked(pieces), joined), ""), part(text, end, F.char_length(text).cast("long")))

    return F.when(F.size(found) > 0, _bound(_running(found, none, total, step), whole)).otherwise(text)
