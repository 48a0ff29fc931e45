"""Quality rules: a threshold table compiled into one projection.

The measures are lengths, symbol, stop-word and line ratios of one text.  Each row of the rule
table bounds one measure; ``compile_rules`` turns the table into one Boolean column per rule.
Everything is a single projection without user functions or shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import free_name, let, whole_text, words


@dataclass(frozen=True)
class Threshold:
    """A text passes if its measure lies in [low, high]; None leaves a side open."""

    rule: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Threshold("mean_word_length", "mean_word_length", 2.0, 14.0),
    Threshold("symbol_ratio", "symbol_ratio", high=0.25),
    Threshold("stop_word_ratio", "stop_word_ratio", low=0.01),
    Threshold("duplicate_line_ratio", "dup_line_ratio", high=0.5),
)

# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he are this or an at from "
    "le la les de des du et en un une que qui dans pour pas sur est au "
    "der die das und zu den von mit ist nicht ein eine dem auf für im "
    "el los las y que del se por con una su para es al lo como"
).split()

SYMBOLS = r"[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes, sorted with their places so that equal ones are neighbours.
    """

    def places(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(keyed, lambda s: F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))

    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, 0).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(places(h))))
    )


def measure(docs: DataFrame) -> DataFrame:
    """Add the struct column ``measures``: counts (long) and ratios (double) of the whole text.

    Null and empty texts count as texts without words; ratios over nothing are 0.  Rows and other columns stay.
    """
    text = whole_text()
    stop = rf"(?<!{WORD_CHAR})(?iu:{'|'.join(sorted(dict.fromkeys(STOP_WORDS)))})(?!{WORD_CHAR})"

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    docs = docs.drop("measures")
    raw = free_name(docs, "raw_measures")
    counted = F.struct(let(words(text), of_words).alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("s"), F.regexp_count(text, F.lit(stop)).cast("long").alias("p"))
    made = docs.withColumn(raw, counted)
    w, ln, symbols, stops = (F.col(f"{raw}.{part}") for part in "wlsp")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return made.withColumn(
        "measures",
        F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
            ln["n_lines"].alias("n_lines"), ln["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), stops.alias("n_stop_words"),
            ratio(w["word_chars"], w["n_words"]).alias("mean_word_length"), ratio(symbols, w["n_words"]).alias("symbol_ratio"),
            ratio(stops, w["n_words"]).alias("stop_word_ratio"), ratio(ln["n_dup_lines"], ln["n_lines"]).alias("dup_line_ratio"),
        ),
    ).drop(raw)


def compile_rules(rules: tuple[Threshold, ...] = RULES, measures: str = "measures") -> dict[str, Column]:
    """One Boolean column per rule: true where the text fails it."""
    out = {}
    for r in rules:
        value, fails = F.col(f"{measures}.{r.measure}"), F.lit(False)
        if r.low is not None:
            fails = fails | (value < r.low)
        if r.high is not None:
            fails = fails | (value > r.high)
        out[r.rule] = fails
    return out


def judge(docs: DataFrame, rules: tuple[Threshold, ...] = RULES) -> DataFrame:
    """Add ``measures``, ``base_failed``, ``failed_rules`` (array of names) and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words inside repeated 3-word windows.
    ``kept`` is false if the base or any rule fails.  Columns of these names are replaced.
    """
    made = measure(docs.drop("base_failed", "failed_rules", "kept"))
    m = F.col("measures")
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(rule)) for rule, fails in compile_rules(rules).items()]))
    return (
        made.withColumn("base_failed", (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]))
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``judge``; a null text counts as one without words and fails the base."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"measures.{n}").alias(n) for n in names], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
