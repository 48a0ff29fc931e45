"""Names: cleaning, normalisation, blocked similarity, resolution to entities, rule classification and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from eventscope.operators.components import connected_components
from eventscope.sources.storage import materialize

# What is replaced in lower-case names, in order, and the words that are dropped.
REPLACED = (
    (r"\band\b", "&"),
    (r"messrs\.?", ""),
    (r"\bm/s\b", ""),
    (r"\bmess\b", ""),
    (r"\bmr\.?\b", ""),
    (r"\bcommercial\b", "commerc"),
    (r"\bdiscount\b", "disc"),
    (r"\bcorporation\b", "corp"),
)
DROPPED = r"\b(the|co|coy|company|cmpy|limited|ltd|brothers|bros|brs|sons|son|inc|incorporated|& co|&co)\b"


def title_case(text: Column) -> Column:
    """Every letter after a non-letter upper case, all others lower case."""
    letters = F.split(F.lower(text), "")
    made = F.transform(letters, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c))
    return F.array_join(made, "")


def clean_name(name: Column) -> Column:
    """Trimmed, spaces collapsed, ``and`` as ``&``, title case; null becomes empty."""
    spaced = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return title_case(F.regexp_replace(spaced, " [aA]nd ", " & "))


def normalize_name(name: Column) -> Column:
    """Lower case without punctuation (but ``&``), spelling variants unified, legal suffixes dropped."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}_\s&]", " ")
    for pattern, put in REPLACED:
        s = F.regexp_replace(s, f"(?U){pattern}", put)
    s = F.regexp_replace(s, f"(?U){DROPPED}", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def block_key(normal: Column) -> Column:
    """First five characters of the first token; null for empty names, which pair with nothing."""
    first = F.get(F.split(normal, " "), 0)
    return F.when(first != "", F.substring(first, 1, 5))


def _indel(a: str, b: str) -> float:
    """Similarity from 0 to 100: twice the longest common subsequence over both lengths, by bit-parallel steps."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_score(a: str, b: str) -> float:
    """Best similarity among the shared words, and the shared words followed by each side's own; 100 if one side has no own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (left and right):
        return 100.0
    both = (f"{shared} {left}".strip(), f"{shared} {right}".strip())
    scores = [_indel(*both)]
    if shared:
        scores += [_indel(shared, both[0]), _indel(shared, both[1])]
    return max(scores)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: Else a filter by the score computes it twice.
token_set_ratio = token_set_ratio.asNondeterministic()


def _letters(tokens: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters inside the tokens."""
    runs = F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (size - 1), F.lit(0))), lambda i: F.when(i <= F.length(t) - (size - 1), F.substr(t, i, F.lit(size)))))
    return F.array_distinct(F.array_compact(F.flatten(runs)))


def _rarest(features: DataFrame, size: Column) -> DataFrame:
    """``(block, normal, feature)`` of so many of each name's features that are rarest in its block."""
    often = features.groupBy("block", "feature").agg(F.count("*").alias("__n"))
    ranked = features.join(often, ["block", "feature"]).withColumn("__r", F.row_number().over(Window.partitionBy("block", "normal").orderBy("__n", "feature")))
    return ranked.filter(F.col("__r") <= size).select("block", "normal", "feature")


def candidate_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of distinct normalised names of one block that alone can reach the threshold, a < b.

    With t = threshold / 100, a pair can reach it in two ways.  Shared words make up t / (2 - t) of one side:
    then one of that side's rarest words, as many as outweigh the rest, is a word of the other side.  Or the
    whole strings are at most d = (1 - t)(|a| + |b|) insertions and deletions apart, of which each spoils two of
    the pairs of letters inside words: then the rarest 2d + 1 of both sides have one in common.  Where a name
    has no more pairs of letters than that, letters take their place (each change spoils one).  What meets is
    held against closer bounds before it is scored: as shared words come first in both strings, the changes are
    between the words that only one side has, and at least as many as their counts of letters differ by.
    """
    t = threshold / 100
    share, reach = t / (2 - t), 2 * (1 - t) / t
    keyed = names.select("normal").filter("normal <> ''").distinct().withColumn("block", block_key(F.col("normal")))
    keyed = keyed.withColumn("words", F.array_distinct(F.split("normal", " ")))
    keyed = keyed.withColumns({"size": F.length(F.array_join("words", " ")), "pairs": _letters(F.col("words"), 2), "letters": _letters(F.col("words"), 1)})
    keyed = keyed.withColumn("most", F.floor(F.col("size") * reach + 1e-9).cast("int"))
    keyed = materialize(keyed.withColumn("short", F.size("pairs") <= 2 * F.col("most")), "entity-keyed")
    spread = lambda c: keyed.select("block", "normal", "size", "most", "short", F.explode(c).alias("feature"))

    words = spread("words").withColumn("w", F.length("feature") + 1)
    often = words.groupBy("block", "feature").agg(F.count("*").alias("__n"))
    before = F.sum("w").over(Window.partitionBy("block", "normal").orderBy("__n", "feature").rowsBetween(Window.unboundedPreceding, -1))
    telling = words.join(often, ["block", "feature"]).withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") <= (1 - share) * F.col("size") + 1e-9)
    sides = [(telling, words)]
    grams = _rarest(spread("pairs").filter("not short"), 2 * F.col("most") + 1)
    sides.append((grams, grams))
    letters = _rarest(spread("letters"), F.col("most") + 1)
    few = keyed.filter("short").select(F.col("block").alias("__b"), F.col("normal").alias("__s"))
    sides.append((letters.join(few, (F.col("block") == F.col("__b")) & (F.col("normal") == F.col("__s")), "left_semi"), letters))
    met = []
    for one, other in sides:
        left, right = one.select("block", "feature", F.col("normal").alias("x")), other.select("block", "feature", F.col("normal").alias("y"))
        met.append(left.join(right, ["block", "feature"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    pairs = reduce(DataFrame.unionByName, met).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(keyed.select(F.col("normal").alias(side), F.col("words").alias(f"words_{side}"), F.col("size").alias(f"size_{side}")), side)
    shared = F.length(F.array_join(F.array_intersect("words_a", "words_b"), " "))
    apart = F.floor((1 - t) * (F.col("size_a") + F.col("size_b")) + 1e-9)
    own = lambda x, y: F.array_except(f"words_{x}", f"words_{y}")
    pairs = pairs.withColumns({"own_a": F.array_join(own("a", "b"), ""), "own_b": F.array_join(own("b", "a"), ""), "spaces": F.abs(F.size(own("a", "b")) - F.size(own("b", "a")))})
    count = lambda side, c: F.length(side) - F.length(F.replace(F.col(side), c, F.lit("")))
    letters = F.array_distinct(F.split(F.concat("own_a", "own_b"), ""))
    changes = F.aggregate(letters, F.col("spaces"), lambda sum_, c: sum_ + F.when(c == "", 0).otherwise(F.abs(count("own_a", c) - count("own_b", c))))
    return pairs.filter((shared >= share * F.least("size_a", "size_b") - 1e-9) | (changes <= apart)).select("a", "b")


def similarity_pairs(names: DataFrame, threshold: float = 88.0) -> DataFrame:
    """Pairs of distinct normalised names of one block at or above the threshold: ``(a, b, score)`` with a < b.

    Only pairs that can reach it are scored (``candidate_pairs``), so a block need not meet itself.
    """
    pairs = candidate_pairs(names, threshold).repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return pairs.withColumn("score", token_set_ratio("a", "b")).filter(F.col("score") >= threshold)


def resolve_entities(names: DataFrame, name: str, threshold: float = 88.0, review_below: float = 92.0) -> DataFrame:
    """``(name, canonical, cluster, method, score, review)`` for distinct names.

    Names that normalise alike are one; similar ones are joined through components.  The canonical
    name is the longest of its cluster, the first in order among equals; the cluster is named by its
    smallest normalised name.  ``score`` holds a name against its canonical name (100 for that one itself), and
    a lower one than ``review_below`` asks for review.  Names that normalise to nothing stand alone.
    """
    every = materialize(names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("normal", normalize_name(F.col("name"))), "entity-names")
    pairs = materialize(similarity_pairs(every, threshold), "entity-pairs")
    joined = connected_components(pairs, "a", "b").withColumnsRenamed({"node": "normal", "component": "cluster"})
    placed = every.join(joined.withColumn("__similar", F.lit(True)), "normal", "left")
    own = F.when(F.col("normal") == "", F.concat(F.lit("="), F.col("name"))).otherwise(F.col("normal"))
    placed = placed.withColumn("cluster", F.coalesce("cluster", own))
    head = F.min_by(F.struct("name", "normal"), F.struct(-F.length("name"), F.col("name")))
    heads = placed.groupBy("cluster").agg(head.alias("h"), F.count("*").alias("__n")).select("cluster", F.col("h.name").alias("canonical"), F.col("h.normal").alias("__h"), "__n")
    method = F.when(F.col("__similar"), "similar").when(F.col("__n") > 1, "same normal form").otherwise("single")
    made = placed.join(heads, "cluster").withColumn("__other", F.col("name") != F.col("canonical"))
    made = made.withColumn("__s", token_set_ratio("normal", "__h"))
    score = F.when(F.col("__other"), F.when(F.col("normal") == F.col("__h"), 100.0).otherwise(F.col("__s"))).otherwise(100.0)
    return made.select("name", "canonical", "cluster", method.alias("method"), score.alias("score"), (F.col("__other") & (score < review_below)).alias("review"))


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-case names that votes for a label with a weight."""

    pattern: str
    label: str
    weight: float = 1.0
    term: str = ""


def classify_first(name: Column, rules: Sequence[Rule], default: str = "other", empty: str = "unknown") -> Column:
    """Label of the first rule that fits."""
    lower = F.lower(name)
    chain = F.when(F.coalesce(name, F.lit("")) == "", empty)
    for r in rules:
        chain = chain.when(lower.rlike(r.pattern), r.label)
    return chain.otherwise(default)


def classify_ordered(name: Column, rules: Sequence[Rule], default: str = "unknown", sure: float = 0.2) -> Column:
    """``(label, confidence)`` of the first rule that fits, whose weight is the confidence; ``default`` without one, and with 0 for no name."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    pair = lambda label, weight: F.struct(F.lit(label).alias("label"), F.lit(float(weight)).alias("confidence"))
    chain = F.when(F.trim(lower) == "", pair(default, 0.0))
    for r in rules:
        chain = chain.when(lower.rlike(r.pattern), pair(r.label, r.weight))
    return chain.otherwise(pair(default, sure))


def classify_weighted(df: DataFrame, name: str, rules: Sequence[Rule], curated: Sequence[Rule] = (), honorifics: Sequence[str] = (), person: str = "individual_or_partnership") -> DataFrame:
    """Add ``label, confidence, reason, evidence, review``.

    Curated patterns decide first (confidence 0.95), then honorifics (0.7).  Else the heaviest of all
    fitting rules gives the label, each further one adds 0.05 up to 0.95, and different labels without
    a weight of 0.7 ask for review.  Without a rule, two to four words without digits are a person
    (0.55, review), and anything else is unknown.
    """
    lower = F.lower(F.coalesce(F.col(name), F.lit("")))
    hit = lambda rs: F.array_compact(F.array(*[F.when(lower.rlike(r.pattern), F.struct((-F.lit(r.weight)).alias("w"), F.lit(k).alias("k"), F.lit(r.label).alias("label"), F.lit(r.term or r.pattern).alias("term"))) for k, r in enumerate(rs)]))
    none = F.array().cast("array<struct<w:double,k:int,label:string,term:string>>")
    staged = df.withColumn("__hits", F.array_sort(hit(rules)) if rules else none).withColumn("__cur", hit(curated) if curated else none)
    staged = staged.withColumn("__person", reduce(Column.__or__, [lower.rlike(p) for p in honorifics], F.lit(False)))
    hits, cur = F.col("__hits"), F.col("__cur")
    words = F.size(F.filter(F.split(F.coalesce(F.col(name), F.lit("")), r"\s+"), lambda w: w != ""))
    bare = words.between(2, 4) & ~F.coalesce(F.col(name), F.lit("")).rlike(r"\d")
    labels = F.array_distinct(F.transform(hits, lambda h: h["label"]))
    top = F.get(hits, 0)

    def choose(curated_, person_, rule_, bare_, none_):
        return F.when(F.size(cur) > 0, curated_).when(F.col("__person"), person_).when(F.size(hits) > 0, rule_).when(bare, bare_).otherwise(none_)

    text = lambda s: F.lit(s)
    return staged.withColumns({
        "label": choose(F.get(cur, 0)["label"], text(person), top["label"], text(person), text("unknown")),
        "confidence": choose(F.lit(0.95), F.lit(0.7), F.round(F.least(-top["w"] + 0.05 * (F.size(hits) - 1), F.lit(0.95)), 2), F.lit(0.55), F.lit(0.0)),
        "reason": choose(text("curated"), text("honorific"), F.concat(F.lit("rules: "), F.array_join(F.array_sort(labels), ", ")), text("bare name"), text("no rule")),
        "evidence": choose(F.slice(F.transform(cur, lambda h: h["term"]), 1, 1), F.array(F.lit("honorific")), F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["term"]))), F.array().cast("array<string>"), F.array().cast("array<string>")),
        "review": choose(F.lit(False), F.lit(False), (F.size(labels) > 1) & (-top["w"] < 0.7), F.lit(True), F.lit(True)),
    }).drop("__hits", "__cur", "__person")


def classification_summary(df: DataFrame, name: str, label: str, event: str) -> DataFrame:
    return df.groupBy(name, label).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(event)), ",").alias("events"))


def validation_sample(df: DataFrame, name: str, event: str, amount: str, confidence: str, sizes: tuple[int, int, int] = (20, 20, 20), seed: int = 7, label: str | None = None, unknown: str = "unknown") -> DataFrame:
    """Names to check by hand: the largest, some per event and some of low confidence, each in a seeded hash order.

    ``(name, stratum, total)``, a name once per stratum.  Low confidence is below 0.5 in some row, or the
    ``unknown`` label where a ``label`` is named.
    """
    doubt = F.col(confidence) < 0.5
    doubt = doubt if label is None else F.coalesce(doubt, F.lit(False)) | (F.col(label) == unknown)
    totals = df.groupBy(name).agg(F.sum(amount).alias("total"), F.coalesce(F.bool_or(doubt), F.lit(False)).alias("__low"))
    order = F.md5(F.concat(F.col(name), F.lit(f":{seed}")))
    top = totals.orderBy(F.col("total").desc(), name).limit(sizes[0]).select(name, F.lit("top_by_volume").alias("stratum"), "total")
    per = df.select(name, event).distinct().withColumn("__r", F.row_number().over(Window.partitionBy(event).orderBy(order, name))).filter(F.col("__r") <= sizes[1])
    per = per.join(totals, name).select(name, F.concat(F.lit("random_"), F.col(event)).alias("stratum"), "total")
    low = totals.filter("__low").orderBy(order, name).limit(sizes[2]).select(name, F.lit("low_confidence").alias("stratum"), "total")
    return top.unionByName(per).unionByName(low)


def agreement(df: DataFrame, stratum: str, verdict: str) -> DataFrame:
    return df.groupBy(stratum, verdict).agg(F.count("*").alias("n"))
