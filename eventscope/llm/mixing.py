"""Mixing sources to target weights.

Tokens are summed per source, targets are shared out by weight under a limit of repetitions, and
each document is taken floor(rate) times plus once more with a probability equal to the fraction,
decided by a hash of its id, so that reruns and lost executors change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import WORD, join_small_or_large, materialize, packed, unpacked, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: The table of sources is broadcast up to this many rows, else joined by shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """``(source, source_size, weight)``: weights repeat over the sources by code point, null last."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    return totals.withColumn("weight", F.get(weights, (rank - 1) % len(WEIGHTS)))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target``: ``share`` of all sizes shared by weight, at most ``most`` times a source's size.

    What limited sources cannot take is shared again by weight until no target is above its limit.
    Each pass is one aggregation over the table of sources; passes end when no source is newly limited.
    """
    limit = most * F.col("source_size").cast("double")
    level, held = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        sums = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, limit).otherwise(0.0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not sums["all"] or not sums["open"] or sums["n"] == held:
            break
        held, level = sums["n"], (share * sums["all"] - sums["full"]) / sums["open"]
    shared = F.lit(0.0) if level is None else F.least(limit, F.col("weight") * F.lit(level))
    return sources.withColumn("target", shared)


def _uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan(docs: DataFrame) -> DataFrame:
    """``(source, source_size, target, rate)`` for the documents' sources; written, hence fixed for the run."""
    sized = docs.select("source", size_of(whole_text()).alias("size"))
    sources = targets(materialize(source_sizes(sized), "mix-sources"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    return materialize(sources.select("source", "source_size", "target", rate.alias("rate")), "mix-plan")


def copies(docs: DataFrame, seed: int = 8) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id, text, source``, any others) with ``size, source_size, target, rate, copies``.

    Null text has size 0; null is a source of its own.  Rows of one ``doc_id`` get the same number of
    copies.  Columns of the added names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    rated = join_small_or_large(docs, plan(docs), "source", "left", BROADCAST_SOURCES)
    whole = F.floor("rate")
    extra = (_uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return rated.withColumn("size", size_of(whole_text())).withColumn("copies", whole + extra)


def mix(docs: DataFrame, seed: int = 8) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    taken = copies(packed(docs, "doc_id", "text", "source"), seed).filter("copies > 0")
    return unpacked(taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")))


def digest(docs: DataFrame, seed: int = 8) -> DataFrame:
    """The contract's columns; a null text has size 0 and takes nothing, a null source is one of its own."""
    made = copies(docs, seed)
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
