"""Secret scanning over a trigram inverted index, with DataFrame operations only.

Each rule is a regex that Java and Python read alike. From its parsed form a
Boolean query over trigrams of the lower-cased text is derived: a string asks for
all its trigrams, parts in a row for what each asks for, alternatives for what
any of them does. The index holds, for each text, a posting for every trigram
that some rule asks for. Rules intersect and unite postings to find their
candidates, and the regex runs on those. Rules without a mandatory trigram run
on every text.

Spans count code points, end exclusive. Base rules: ``assign``, ``access`` and
``hex``; their matches are leftmost and do not overlap within a kind, and those
that fail the rule's length condition are dropped after matching. The further
rules ``github``, ``jwt`` and ``pem`` add spans of their own kinds; base spans
never change through them.

A null text counts as empty and gives no spans. Rows that agree in doc_id and
text get equal results. Long texts, ties (kinds starting at one place go in the
order of the rules) and repeated rows need no special case; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, ascii_lower, read, split_by, stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    min_group: int = 0  # the group whose length counts
    min_length: int = 0


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
#: Strings that a part of a regex may be before it counts as anything.
STRINGS = 64


def _joined(strings: set[str], more: set[str]) -> set[str] | None:
    return {a + b for a in strings for b in more} if len(strings) * len(more) <= STRINGS else None


def _all_of(parts: list) -> tuple | None:
    """The conjunction of queries, None where nothing is asked for."""
    flat = sorted({q for p in parts if p is not None for q in (p[1] if p[0] == "and" else (p,))}, key=repr)
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any_of(parts: list) -> tuple | None:
    """The disjunction of queries: None if any of them asks for nothing; one that asks for more than another goes."""
    if None in parts:
        return None
    asks = lambda p: set(p[1]) if p[0] == "and" else {p}
    least = sorted({p for p in parts if not any(asks(q) < asks(p) for q in parts)}, key=repr)
    return least[0] if len(least) == 1 else ("or", tuple(least))


def _grams(strings: set[str]) -> tuple | None:
    """What holds where one of the strings occurs."""
    return _any_of([_all_of([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


def _parsed(nodes) -> tuple[set[str] | None, tuple | None]:
    """Of a regex's parsed parts in a row: the strings they can be, or None for too many; the query that every match meets.

    Characters are lower-cased (A-Z), as the index is. Strings of neighbouring parts grow together until a part can be
    anything; then their trigrams are asked for, and new strings begin.
    """
    open_, asked, exact = {""}, [], True

    def close() -> None:
        nonlocal open_, exact
        asked.append(_grams(open_))
        open_, exact = {""}, False

    for op, value in nodes:
        strings, query = _one(str(op), value)
        grown = _joined(open_, strings) if strings is not None else None
        if grown is not None:
            open_ = grown
            continue
        close()
        if strings is not None:
            open_ = strings
        else:
            asked.append(query)
    if exact:
        return open_, _grams(open_)
    return None, _all_of([*asked, _grams(open_)])


def _one(op: str, value) -> tuple[set[str] | None, tuple | None]:
    """The same of a single part."""
    lower = lambda code: chr(LOWER[code]) if code < 256 else chr(code)
    if op == "LITERAL":
        return {lower(value)}, None
    if op == "IN":
        chars: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(lower(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < STRINGS:
                chars |= {lower(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op == "SUBPATTERN":
        return _parsed(value[-1])
    if op == "BRANCH":
        parts = [_parsed(p) for p in value[1]]
        sets = [s for s, _ in parts]
        if all(s is not None for s in sets) and len(set().union(*sets)) <= STRINGS:
            return set().union(*sets), None
        return None, _any_of([q for _, q in parts])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        strings, query = _parsed(inner)
        if strings is not None and int(high) == 1:
            return (strings | {""}) if low == 0 else strings, None
        if strings is not None and low and int(low) == int(high):
            out: set[str] | None = {""}
            for _ in range(low):
                out = _joined(out, strings) if out is not None else None
            if out is not None:
                return out, None
        return None, query if low else None
    if op == "AT":
        return {""}, None
    return None, None


def trigram_query(regex: str) -> tuple | None:
    """The Boolean query over trigrams of the lower-cased text that every match of the regex meets: ("gram", trigram),
    ("and" | "or", queries), or None where no trigram is mandatory. Derived from the parsed regex."""
    return _parsed(re._parser.parse(regex))[1]


def trigrams(query: tuple | None) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*(trigrams(p) for p in query[1]))


def _holds(query: tuple, grams: Column) -> Column:
    """The query over the trigrams that a text has."""
    if query[0] == "gram":
        return F.array_contains(grams, query[1])
    out = None
    for part in query[1]:
        c = _holds(part, grams)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the trigrams that the rules ask for, stored."""
    grams = sorted(set().union(*(trigrams(trigram_query(r.regex)) for r in rules)))
    low = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), ascii_lower(F.col("text")).alias("low")).where("low is not null")
    found = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)).cast("array<string>"), lambda g: g.isNotNull())
    return stored(low.select("doc_id", "text_hash", F.explode(found).alias("trigram")))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, kinds): what the index can't rule out, for rules that have a query.

    A text is in the lists of all trigrams of a conjunction, or of any of a disjunction, if its postings brought
    together meet the query; they lie together, so nearly all of them meet before they shuffle.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    lists = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("grams"))
    kinds = F.filter(F.array(*(F.when(_holds(q, F.col("grams")), F.lit(k)) for k, q in queries.items())).cast("array<string>"), lambda k: k.isNotNull())
    return lists.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, end, kind>> of a rule's matches: pieces between matches and the matches themselves, by length."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    counted = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.min_group)) if rule.min_group else found
    each = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"), F.transform(counted, F.length).alias("n"))
    no = F.array().cast("array<struct<start:int,end:int,kind:string,rank:int>>")
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"))
        return F.struct(end.alias("at"), F.when(x["n"] >= rule.min_length, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    done = F.aggregate(each, F.struct(F.lit(0).alias("at"), no.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, done).otherwise(no)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id and ``found``, array<struct<start, rank, end, kind>> by start, then rule.

    Only texts that are candidates of some rule meet the list of these; the others stay where they are and are
    scanned by the rules without mandatory trigrams.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_or_empty().alias("text"))
    found = stored(candidates(build_index(docs, rules), rules))
    some, rest = split_by(rows, "text_hash", found, "text_hash")
    none = F.array().cast("array<struct<start:int,end:int,kind:string,rank:int>>")
    asks = {r.kind for r in rules if trigram_query(r.regex) is not None}

    def scanned(texts: DataFrame, kinds: Column | None) -> DataFrame:
        parts = [none]
        for rule in rules:
            spans = _spans(rule, F.col("text"))
            if rule.kind in asks:
                if kinds is None:
                    continue
                spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(none)
            elif rule.min_length and not rule.min_group and rule.regex.endswith("]+"):  # no shorter run can pass, and the regex then needs no list of all the short ones
                spans = F.when(F.col("text").rlike(f"(?:{rule.regex[:-1]}){{{rule.min_length}}}"), spans).otherwise(none)
            parts.append(spans)
        by_start = F.array_sort(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return texts.select("doc_id", by_start.alias("found"))

    met = some.join(found.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"}), (F.col("text_hash") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    return scanned(met, F.coalesce("kinds", F.array().cast("array<string>"))).unionByName(scanned(rest, None))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents"))
    n = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < BASE)
    return out.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )
