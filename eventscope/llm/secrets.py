"""Secret scans over a trigram inverted index.

Each rule is a regular expression.  From its syntax tree a Boolean query over trigrams is derived
that every text with a match must satisfy: a disjunction of conjunctions.  The index holds one
posting ``(trigram, doc_id)`` for every trigram that some query names.  Intersecting the postings
yields the candidates of each rule, and only candidates are searched with the expression itself.
A rule without mandatory trigrams (a bare character class, say) searches every text.

Letter case is folded in index and queries alike, so a query may admit more texts than the rule,
never fewer.  All work is DataFrame expressions.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import free_name, join_small_or_large, let, materialize, running, whole_text

#: At most this many alternatives are kept while a query is derived; beyond it the query is weakened.
MAX_STRINGS = 64
#: Candidate keys are broadcast up to this many rows (about 20 MB), else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Code points of the pieces that a text is cut to before parts of it are taken.
PIECE = 4_096


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates of ``kind``; a match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The rules of the contract, in its order.  A run of a character class is greedy, so
# asking for the least length inside the pattern finds the same runs as dropping short ones after.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds with a fixed head, which the index makes nearly free.  A private key runs to its END
#: line, or over the lines of base64 that follow where there is none.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x0A\x0D]+[A-Za-z0-9+/=]{16,}){1,60})?"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES

Query = list[frozenset[str]]  # OR of ANDs; [frozenset()] holds for every text
EVERY: Query = [frozenset()]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _and(a: Query, b: Query) -> Query:
    out = list(dict.fromkeys(x | y for x, y in product(a, b)))
    return out if len(out) <= MAX_STRINGS else a


def _or(parts: list[Query]) -> Query:
    found = {x for part in parts for x in part}
    out = [x for x in found if not any(y < x for y in found)]  # what implies another alternative adds nothing
    return EVERY if frozenset() in out or len(out) > MAX_STRINGS else out


def _of_strings(strings: set[str]) -> Query:
    return _or([[_trigrams(s)] for s in strings])


def _small_set(items: list) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """The exact set of folded strings that the nodes match (None: unknown), and a query they imply."""
    run: set[str] | None = {""}  # of the strings since the last node whose strings are unknown
    query, exact = EVERY, True
    for op, arg in nodes:
        strings: set[str] | None = None
        implied = EVERY
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _small_set(arg)
        elif op is sre.SUBPATTERN:
            strings, implied = _analyse(arg[3])
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            implied = _or([q if s is None else _of_strings(s) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner, below = _analyse(body)
            if inner is not None and high == 1:
                strings = inner | {""} if low == 0 else inner
            elif low >= 1:
                implied = below if inner is None else _of_strings(inner)
        elif op is sre.AT:
            strings = {""}
        joined = {a + b for a in run for b in strings} if strings is not None and len(run) * len(strings) <= MAX_STRINGS else None
        if joined is None:
            query = _and(_and(query, _of_strings(run)), implied if strings is None else _of_strings(strings))
            run, exact = {""}, False
        else:
            run = joined
    query = _and(query, _of_strings(run))
    return (run if exact else None), query


def trigram_query(pattern: str) -> Query | None:
    """Conjunctions of folded trigrams, one of which every match contains; None if there is no such query."""
    strings, query = _analyse(sre_parser.parse(pattern))
    if strings is not None:
        query = _of_strings(strings)
    return None if frozenset() in query else query


def index_postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index of the named trigrams: one row ``(trigram, doc_id)`` per occurring pair of each row."""
    folded = docs.select("doc_id", F.lower(whole_text()).alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect postings: ``(doc_id, kinds)`` for documents that satisfy the query of one kind or more."""
    vocabulary = sorted({t for q in queries.values() for part in q for t in part})
    column = {t: f"t{k}" for k, t in enumerate(vocabulary)}
    held = postings.groupBy("doc_id").agg(*[F.bool_or(F.col("trigram") == t).alias(c) for t, c in column.items()])

    def holds(query: Query) -> Column:
        return reduce(Column.__or__, [reduce(Column.__and__, [F.col(column[t]) for t in sorted(part)]) for part in query])

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return held.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end)`` in code points, end exclusive, of the rule's matches from left to right.

    Ends are running sums of the matches' lengths and of the gaps before them, so the work grows with the
    text and the number of matches.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,end:int>>")
    lengths = lambda parts: F.transform(parts, F.length)

    def place(found: Column) -> Column:
        gaps = lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)))
        ends = running(F.zip_with(lengths(found), gaps, lambda n, gap: n + gap), lambda a, b: a + b, F.lit(0))
        steps = F.arrays_zip(lengths(found).alias("n"), ends.alias("end"), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"))
        return F.transform(F.filter(steps, lambda m: m["value"] >= rule.least), lambda m: F.struct((m["end"] - m["n"]).alias("start"), m["end"].alias("end")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _tagged(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id, text``, any others) with ``secrets`` added.

    ``secrets`` is an array of ``(start, ord, kind, end)``: code points, end exclusive, sorted by start
    and then by the rules' order.  Null and empty texts have none.  Repeated rows are each scanned;
    rows with the same or a null ``doc_id`` share their postings, which only widens the candidates.
    An existing column ``secrets`` is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    docs = docs.drop("secrets")
    marks = free_name(docs, "secret_kinds")
    vocabulary = sorted({t for q in queries.values() for part in q for t in part})
    if queries:
        found = materialize(candidates(index_postings(docs, vocabulary), queries), "secret-candidates")
        found = found.select("doc_id", F.col("kinds").alias(marks))
        docs = join_small_or_large(docs, found, "doc_id", "left", BROADCAST_ROWS)
    else:
        docs = docs.withColumn(marks, F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(whole_text(), rule)
        if rule.kind in queries:
            spans = F.when(F.array_contains(marks, rule.kind), spans).otherwise(none)
        parts.append(F.transform(spans, _tagged(k, rule.kind)))
    return docs.withColumn("secrets", F.sort_array(F.concat(*parts))).drop(marks)


def _joined(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``scan``; texts without secrets, null ones too, have counts of 0 and empty spans."""
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def redact(scanned: DataFrame) -> DataFrame:
    """Replace every secret in ``text`` by ``[kind]``; overlapping spans become one placeholder.

    Takes the result of ``scan`` and drops ``secrets``; texts without secrets stay as they are.
    """
    text = whole_text()
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(parts: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, out of the pieces that hold it."""
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.substring(held, start - first * PIECE + 1, end - start)

    def join(parts: Column) -> Column:
        ends = running(F.transform("secrets", lambda s: s["end"]), F.greatest, F.lit(0))

        def around(after: Column) -> Column:
            placed = F.transform("secrets", lambda s, k: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(after, k - 1), F.lit(0)).alias("at")))
            fresh = F.filter(placed, lambda s: s["start"] >= s["at"])
            kept = F.array_join(F.transform(fresh, lambda s: F.concat(cut(parts, s["at"], s["start"]), F.lit("["), s["kind"], F.lit("]"))), "")
            return F.concat(kept, cut(parts, F.element_at(after, -1), F.length(text)))

        return let(ends, around)

    return scanned.withColumn("text", F.when(F.size("secrets") > 0, let(pieces, join)).otherwise(F.col("text"))).drop("secrets")
