"""Clocks and chains: which signal came when, and how far ahead of the event."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_timeline(tx: DataFrame, events: DataFrame, date: str, subset: Column, least: int = 2) -> DataFrame:
    """Per event: span of its transactions, first week (Sunday) with ``least`` of the subset, and the subset's busiest week."""
    from eventscope.operators.events import window_join

    held = window_join(tx, events, date)
    span = held.groupBy("event_key").agg(F.min(date).alias("ledger_start"), F.max(date).alias("ledger_end"), F.count("*").alias("n"))
    week = F.next_day(F.date_sub(date, 1), "Sun")
    weekly = held.filter(subset).groupBy("event_key", week.alias("week")).agg(F.count("*").alias("c"))
    weeks = weekly.groupBy("event_key").agg(F.min(F.when(F.col("c") >= least, F.col("week"))).alias("first_week"), F.min_by("week", F.struct(-F.col("c"), F.col("week"))).alias("peak_week"))
    return span.join(weeks, "event_key", "left")


def marker_timeline(*markers: tuple[DataFrame, str, str]) -> DataFrame:
    """Union of dated markers ``(table, date column, kind)`` as ``(event_key, date, kind)``, undated ones left out."""
    parts = [df.select("event_key", F.col(date).alias("date"), F.lit(kind).alias("kind")).filter("date is not null") for df, date, kind in markers]
    return reduce(DataFrame.unionByName, parts)


def clock_table(events: DataFrame, signals: DataFrame, columns: Sequence[str], public: str) -> DataFrame:
    """Each signal date of an event with its lead in days before the public date."""
    joined = events.select("event_key", "origin", public).join(signals.select("event_key", *columns), "event_key", "left")
    return joined.withColumns({f"{c}_lead": F.datediff(public, c) for c in columns})


def availability(events: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """One row per event, one flag per source that has it."""
    out = events.select("event_key")
    for name, df in sources.items():
        have = df.select("event_key").distinct().withColumn(name, F.lit(True))
        out = out.join(have, "event_key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def information_chain(df: DataFrame, signals: Sequence[str], public: str, articles: str) -> DataFrame:
    """Earliest of the signals, its lead to the public date, and a confidence tier by the sources there are."""
    early = F.least(*signals) if len(signals) > 1 else F.col(signals[0])
    known = reduce(Column.__add__, [F.col(s).isNotNull().cast("int") for s in signals])
    tier = F.when((F.coalesce(articles, F.lit(0)) > 0) & (known == len(signals)), "high").when((F.coalesce(articles, F.lit(0)) > 0) | (known > 0), "medium").otherwise("low")
    return df.withColumn("earliest_signal", early).withColumn("lead_days", F.datediff(public, "earliest_signal")).withColumn("confidence", tier)


def recurrence(df: DataFrame, party: str, event: str, eras: dict[str, str]) -> DataFrame:
    """Events and eras of each party, and whether it spans more than one era; ``eras`` maps event to era."""
    era = reduce(lambda c, kv: c.when(F.col(event) == kv[0], kv[1]), list(eras.items())[1:], F.when(F.col(event) == next(iter(eras)), eras[next(iter(eras))]))
    made = df.select(party, event).distinct().withColumn("era", era).groupBy(party)
    return made.agg(F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_set(event)), ",").alias("events"), F.count_distinct("era").alias("n_eras")).withColumn("spans_eras", F.col("n_eras") > 1)


def flow_sequence(steps: DataFrame, chain: DataFrame) -> DataFrame:
    """Ordered steps from signal to rupture with gaps in days and the total span.

    ``steps`` is ``(event_key, actor, date)``, ``chain`` ``(event_key, signal_date, rupture_date)``.
    Events with a signal keep only the steps between signal and rupture; the rupture closes the sequence.
    """
    joined = steps.filter("date is not null").join(chain, "event_key")
    inside = F.col("signal_date").isNull() | F.col("date").between(F.col("signal_date"), F.col("rupture_date"))
    middle = joined.filter(inside).select("event_key", "actor", "date", F.lit(1).alias("part"))
    start = chain.filter("signal_date is not null").select("event_key", F.lit("signal").alias("actor"), F.col("signal_date").alias("date"), F.lit(0).alias("part"))
    end = chain.filter("rupture_date is not null").select("event_key", F.lit("rupture").alias("actor"), F.col("rupture_date").alias("date"), F.lit(2).alias("part"))
    every = start.unionByName(middle).unionByName(end)
    w, whole = Window.partitionBy("event_key").orderBy("part", "date", "actor"), Window.partitionBy("event_key")
    return every.select(
        "event_key", F.row_number().over(w).alias("step"), "actor", "date", F.datediff("date", F.lag("date").over(w)).alias("gap"),
        F.when(F.count("*").over(whole) > 1, F.datediff(F.last("date").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.first("date").over(w))).alias("span_days"),
    )


def clock_offsets(df: DataFrame, columns: Sequence[str], day0: str, tight: int = 6) -> DataFrame:
    """Days of each clock from day 0, and whether all that are known lie within ``tight`` days."""
    made = df.withColumns({f"{c}_offset": F.datediff(c, day0) for c in columns})
    offsets = [F.col(f"{c}_offset") for c in columns]
    spread = F.greatest(*offsets) - F.least(*offsets) if len(offsets) > 1 else F.lit(0)
    return made.withColumn("spread", spread).withColumn("tight", F.coalesce(spread <= tight, F.lit(False)))


def paired(df: DataFrame, key: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """Two subjects side by side: ``(measure, first, second, difference)`` for numeric columns of their rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.filter(F.col(key).isin(first, second)).select(key, F.inline(entries))
    of = lambda k: F.max(F.when(F.col(key) == k, F.col("v")))
    return long.groupBy("measure").agg(of(first).alias("first"), of(second).alias("second")).withColumn("difference", F.col("second") - F.col("first"))
