"""Phrase matching in dated documents, first markers and coverage over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.operators.events import window_join

#: A clause is a pattern, or several that must all be found.
Clause = str | tuple[str, ...]


def matches(text: str, clause: Clause) -> Column:
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return reduce(Column.__and__, [lower.rlike(p) for p in ((clause,) if isinstance(clause, str) else clause)])


def match_clauses(df: DataFrame, clauses: dict[str, Clause], text: str = "text") -> DataFrame:
    """Rows that some clause matches, with the ``labels`` that fired in the order given."""
    fired = F.array_compact(F.array(*[F.when(matches(text, c), F.lit(n)) for n, c in clauses.items()]))
    return df.withColumn("labels", fired).filter(F.size("labels") > 0)


def describe_match(df: DataFrame, pattern: str, text: str = "text", before: int = 90, after: int = 170) -> DataFrame:
    """Add the ``position`` (from 1, 0 without a match) of the first match and a ``snippet`` around it with white space collapsed."""
    at = F.regexp_instr(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern))
    placed = df.withColumn("position", at)
    start = F.greatest(F.lit(1), F.col("position") - before)
    cut = F.substring(F.col(text), start, F.col("position") + after - start)
    return placed.withColumn("snippet", F.when(F.col("position") > 0, F.trim(F.regexp_replace(cut, r"\s+", " "))))


def first_marker(df: DataFrame, events: DataFrame, date: str, fields: Sequence[str], tie: str) -> DataFrame:
    """Per event: matches, the first one's date and fields, and the busiest week (ending on Sunday; the earliest on ties)."""
    held = window_join(df, events, date)
    week = F.next_day(F.date_sub(date, 1), "Sun")
    weekly = held.groupBy("event_key", week.alias("week")).agg(F.count("*").alias("c"))
    peak = weekly.groupBy("event_key").agg(F.min_by("week", F.struct(-F.col("c"), F.col("week"))).alias("peak_week"))
    first = held.groupBy("event_key").agg(F.count("*").alias("n"), F.min_by(F.struct(date, *fields), F.struct(date, tie)).alias("m"))
    return first.join(peak, "event_key").select("event_key", "n", F.col(f"m.{date}").alias("first_date"), *[F.col(f"m.{f}").alias(f) for f in fields], "peak_week")


def earliest_k(df: DataFrame, events: DataFrame, date: str, tie: str, k: int = 3) -> DataFrame:
    held = window_join(df, events, date)
    return held.withColumn("place", F.row_number().over(Window.partitionBy("event_key").orderBy(date, tie))).filter(F.col("place") <= k)


def coverage_monthly(df: DataFrame, events: DataFrame, date: str, hit: Column) -> DataFrame:
    held = window_join(df, events, date)
    return held.groupBy("event_key", F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("articles"), F.count_if(hit).alias("matching"))


def coverage_families(df: DataFrame, events: DataFrame, date: str, families: dict[str, Clause], text: str = "text", least: int = 3) -> DataFrame:
    """Per event and family of phrases: hits, surge month (largest share of a month's articles, of months with ``least``; else most hits), peak month, first mention."""
    held = window_join(df, events, date)
    flags = F.array(*[F.struct(F.lit(n).alias("family"), matches(text, c).alias("hit")) for n, c in families.items()])
    month = F.date_format(date, "yyyy-MM")
    # the month is a projection of the date only, so the texts are read once
    monthly = held.select("event_key", month.alias("month"), date, F.inline(flags)).groupBy("event_key", "family", "month").agg(
        F.count("*").alias("base"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col(date))).alias("first")
    )
    share = F.when(F.col("base") >= least, F.col("hits") / F.col("base"))
    made = monthly.groupBy("event_key", "family").agg(
        F.sum("hits").alias("hits"), F.min_by("month", F.when(share.isNotNull(), F.struct(-share, F.col("month")))).alias("by_share"),
        F.min_by("month", F.struct(-F.col("hits"), F.col("month"))).alias("peak_month"), F.min("first").alias("first_mention"),
    )
    return made.select("event_key", "family", "hits", F.coalesce("by_share", "peak_month").alias("surge_month"), "peak_month", "first_mention")


def coverage_probe(df: DataFrame, events: DataFrame, date: str, gate: Column) -> DataFrame:
    return window_join(df, events, date).groupBy("event_key").agg(F.count("*").alias("raw"), F.count_if(gate).alias("after_gate"))
