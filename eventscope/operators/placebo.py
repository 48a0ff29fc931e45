"""Placebo windows: eligible centres, statistics around them, and where the events stand among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.functions import blocks
from eventscope.operators import events as ev
from eventscope.operators.aggregates import quantiles


def placebo_centers(span: DataFrame, events: DataFrame, days: int = 365, margin: int = 0, n: int | None = None, seed: int = 42, peak: str = "acute_peak") -> DataFrame:
    """Days of ``span`` (one row ``lo, hi``) that keep ``days`` from every event and ``margin`` from the edges.

    All of them, or the ``n`` that come first by a seeded hash, which any rerun repeats.
    """
    every = span.select(F.explode(F.sequence(F.date_add("lo", margin), F.date_sub("hi", margin))).alias("center"))
    free = ev.exclude_windows(every, events, "center", F.date_sub(peak, days), F.date_add(peak, days))
    return free if n is None else free.orderBy(F.xxhash64(F.unix_date("center"), F.lit(seed)), "center").limit(n)


def placebo_windows(df: DataFrame, centers: DataFrame, days: int, aggregates: dict[str, Column], date: str = "date") -> DataFrame:
    """Several aggregates of the rows within ``days`` of each centre."""
    return ev.count_within(centers, df, days, "center", date, aggregates)


def placebo_compare(values: DataFrame, placebo: DataFrame, value: str) -> DataFrame:
    """Each event's value with its percentile among the placebo values, and their mean, 95th percentile and maximum.

    A percentile is the share (%) of placebo values at or below the event's; null without either.
    """
    sound = placebo.filter(F.col(value).isNotNull()).select(F.col(value).alias("__p"))
    high = quantiles(sound.withColumn("__g", F.lit(0)), ["__g"], "__p", [0.95]).withColumnRenamed("q95", "placebo_p95")
    stats = sound.agg(F.lit(0).alias("__g"), F.avg("__p").alias("placebo_mean"), F.max("__p").alias("placebo_max"), F.count("*").alias("n_placebo")).join(high, "__g", "left").drop("__g")
    sides = sound.select(F.col("__p").alias("__v"), F.lit(1).alias("__c")).unionByName(values.select(F.col(value).cast("double").alias("__v"), F.lit(0).alias("__c")).filter("__v is not null"))
    held = sides.withColumn("__v", F.col("__v") + F.lit(0.0)).groupBy("__v").agg(F.sum("__c").alias("__c"))
    placed = blocks.dealt(held, ["__v"], "placebo-values")  # both sides in one order, with counts carried from range to range
    ranks = blocks.running(placed, [], ["__v"], {"__le": F.col("__c")}).select("__v", "__le")
    joined = values.join(ranks, (F.col(value).cast("double") + F.lit(0.0)) == F.col("__v"), "left").crossJoin(F.broadcast(stats))  # one row
    joined = joined.select(*values.columns, "placebo_mean", "placebo_p95", "placebo_max", "n_placebo", "__le")
    rank = F.when(F.col(value).isNotNull(), 100.0 * F.try_divide(F.coalesce("__le", F.lit(0)).cast("double"), F.nullif(F.col("n_placebo"), F.lit(0))))
    return joined.withColumn("percentile", rank).drop("__le")


def false_positive_rate(placebo: DataFrame, value: str, cut: float) -> DataFrame:
    return placebo.agg(F.count(value).alias("n"), F.avg((F.col(value) >= cut).cast("double")).alias("share_at_cut"))
