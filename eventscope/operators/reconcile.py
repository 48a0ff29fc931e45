"""Reconciliation of two sources, fill rates, tolerant record parsing and price panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_json_lenient(text: Column, schema: str) -> Column:
    """A struct from JSON that may be fenced or wrapped in prose: code fences go, then the widest ``{...}`` is read.

    What does not parse gives nulls and the text itself in ``_bad``, which is null for a good record; null text gives null.
    """
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(block != "", block).otherwise(text), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def flatten_records(df: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of an array of structs, and one with nulls where it is empty or null."""
    made = df.select(*keep, F.posexplode_outer(array).alias("pos", "item"))
    return made.select(*keep, "pos", "item.*")


def dedupe_most_complete(df: DataFrame, key: Sequence[str], columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The row of each key with the most non-null columns, the first by ``tie`` among equals."""
    filled = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns])
    order = Window.partitionBy(*key).orderBy(filled.desc(), *tie)
    return df.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def override_with(df: DataFrame, reference: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``value`` from the reference where it has one, the own value as ``<value>_own``, and whether they differ."""
    ref = reference.select(*key, F.col(value).alias("__ref"))
    joined = df.withColumnRenamed(value, f"{value}_own").join(ref, list(key), "left")
    own = F.col(f"{value}_own")
    return joined.withColumn(value, F.coalesce("__ref", own)).withColumn("mismatch", F.coalesce(own != F.col("__ref"), F.lit(False))).drop("__ref")


def compare(df: DataFrame, key: Sequence[str], pairs: dict[str, tuple[str, str]], passing: float = 1.0, warning: float = 5.0) -> DataFrame:
    """Long comparison of ``(model, anchor)`` columns per variable: difference in % of the anchor, status and exact match at two decimals.

    No value on one side gives the status ``missing``.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(m).alias("model"), F.col(a).alias("anchor")) for n, (m, a) in pairs.items()])
    long = df.select(*key, F.inline(entries))
    diff = 100 * F.try_divide(F.abs(F.col("model") - F.col("anchor")), F.nullif(F.abs(F.col("anchor")), F.lit(0.0)))
    status = F.when(F.col("pct_diff").isNull(), "missing").when(F.col("pct_diff") <= passing, "pass").when(F.col("pct_diff") <= warning, "warning").otherwise("fail")
    return long.withColumn("pct_diff", diff).withColumn("status", status).withColumn("exact", F.coalesce(F.round("model", 2) == F.round("anchor", 2), F.lit(False)))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, filled, rate)`` in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("filled"), (100.0 * F.try_divide(F.col(c).cast("double"), F.nullif(F.col("__n"), F.lit(0)))).alias("rate")) for c in columns])
    return counts.select(F.inline(entries))


def usability(compared: DataFrame) -> DataFrame:
    """Per variable: rows, share passing, median difference, and ``usable`` from 80 %, ``weak`` from 50 %, else ``unusable``."""
    made = compared.groupBy("variable").agg(F.count("*").alias("n"), (100 * F.avg((F.col("status") == "pass").cast("double"))).alias("pass_rate"), F.percentile("pct_diff", F.lit(0.5)).alias("median_diff"))
    return made.withColumn("verdict", F.when(F.col("pass_rate") >= 80, "usable").when(F.col("pass_rate") >= 50, "weak").otherwise("unusable"))


def range_check(df: DataFrame, intervals: DataFrame, date: str, value: str, lo: str, hi: str, name: str) -> DataFrame:
    """Smallest and largest value inside each interval and whether they agree."""
    from eventscope.operators.events import small

    inside = df.join(small(intervals), F.col(date).between(F.col(lo), F.col(hi)))
    made = inside.groupBy(name).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return made.withColumn("agrees", F.col("low") == F.col("high"))


def review_queue(dates: DataFrame, intervals: DataFrame, date: str, lo: str, hi: str, name: str, targets: Sequence[str]) -> DataFrame:
    """Dates but Sundays with their covering interval and empty columns to fill in."""
    from eventscope.operators.events import interval_lookup

    days = dates.filter(F.weekday(date) != 6)
    return interval_lookup(days, intervals, date, lo, hi, name).withColumns({t: F.lit(None).cast("double") for t in targets})


def annual_context(panel: DataFrame, events: DataFrame, keys: Sequence[str], year: str, levels: Sequence[str]) -> DataFrame:
    """Levels and growth of the year of each event's peak, with whether the panel covers it."""
    from eventscope.functions.timeseries import yoy

    grown = yoy(panel, keys, year, levels)
    from eventscope.operators.events import small

    spots = panel.select(*keys).distinct().crossJoin(small(events.select("event_key", F.year("acute_peak").alias(year))))
    joined = spots.join(grown.withColumn("__in", F.lit(True)), [*keys, year], "left")
    return joined.withColumn("status", F.when(F.col("__in"), "covered").otherwise("outside")).drop("__in")


def security_panel(quotes: DataFrame, least_price: float = 0.0) -> DataFrame:
    """Median price per security and month end, first name and sector, previous price and return; returns outside of [-0.8, 2] are null."""
    held = quotes.filter(F.col("price") > least_price)
    month = F.last_day(F.make_date("year", "month", F.lit(1)))
    made = held.groupBy("security_id", month.alias("date")).agg(F.percentile("price", F.lit(0.5)).alias("price"), F.min("name").alias("name"), F.min("sector").alias("sector"))
    w = Window.partitionBy("security_id").orderBy("date")
    made = made.withColumn("prev_price", F.lag("price").over(w))
    ret = F.try_divide("price", F.nullif(F.col("prev_price"), F.lit(0.0))) - 1
    return made.withColumn("return", F.when(ret.between(-0.8, 2.0), ret))


def sector_panel(panel: DataFrame) -> DataFrame:
    """Per sector and month: quoted securities, median and mean return, share declining, and an index from mean returns."""
    from eventscope.functions.timeseries import cum_index

    made = panel.groupBy("sector", "date").agg(
        F.count_distinct("security_id").alias("quoted"), F.percentile("return", F.lit(0.5)).alias("median_return"), F.avg("return").alias("mean_return"),
        F.avg((F.col("return") < 0).cast("double")).alias("share_declining"),
    )
    return made.withColumn("index", cum_index("mean_return", ["sector"], "date"))


def event_study(sectors: DataFrame, events: DataFrame, months: int = 12) -> DataFrame:
    """Per sector and event on a full axis of months around the peak: index rebased to the month before, drawdown from the window's high, and cumulative return after.

    Months without quotes carry the last index on.
    """
    axis = events.select("event_key", "acute_peak", F.explode(F.sequence(F.lit(-months), F.lit(months))).alias("rel"))
    axis = axis.withColumn("date", F.last_day(F.add_months("acute_peak", F.col("rel")))).drop("acute_peak")
    from eventscope.operators.events import small

    spine = sectors.select("sector").distinct().crossJoin(small(axis))  # a fixed number of months per event
    joined = spine.join(sectors.select("sector", "date", "index", "quoted", "mean_return"), ["sector", "date"], "left")
    w = Window.partitionBy("sector", "event_key").orderBy("rel")
    filled = joined.withColumn("index", F.last("index", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.max(F.when(F.col("rel") == -1, F.col("index"))).over(Window.partitionBy("sector", "event_key"))
    top = F.max("index").over(w.rowsBetween(Window.unboundedPreceding, 0))
    growth = F.sum(F.when(F.col("rel") >= 0, F.log1p(F.coalesce("mean_return", F.lit(0.0)))).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select(
        "sector", "event_key", "rel", "date", F.coalesce("quoted", F.lit(0)).alias("quoted"), "index", (100 * F.try_divide(F.col("index"), F.nullif(base, F.lit(0.0)))).alias("rebased"),
        (F.try_divide(F.col("index"), F.nullif(top, F.lit(0.0))) - 1).alias("drawdown"), F.expm1(growth).alias("cumulative"),
    )


def event_study_summary(study: DataFrame, sectors: DataFrame) -> DataFrame:
    """Per sector and event of an ``event_study``: the event month, returns around it, the deepest drawdown and the range of the window.

    ``quote_index`` is the number of quoted securities against the window's first month (100); ``base_index`` in
    ``low`` and ``high`` is the index against that month.  Returns of three months are cumulated over months with a
    mean return: from two before to the event, and from the event to two after; null without any.
    """
    start = F.min_by(F.struct("quoted", "index"), F.col("rel"))
    held = study.join(sectors.select("sector", "date", "mean_return", "share_declining"), ["sector", "date"], "left")
    first = held.groupBy("sector", "event_key").agg(start.alias("start"))
    grown = held.join(first, ["sector", "event_key"])
    at = lambda c: F.max(F.when(F.col("rel") == 0, F.col(c)))
    total = lambda lo, hi: F.expm1(F.sum(F.when(F.col("rel").between(lo, hi), F.log1p("mean_return"))))
    based = 100 * F.try_divide(F.col("index"), F.nullif(F.col("start.index"), F.lit(0.0)))
    return grown.groupBy("sector", "event_key").agg(
        at("quoted").alias("quoted"), (100 * F.try_divide(at("quoted").cast("double"), F.nullif(F.first("start.quoted"), F.lit(0)))).alias("quote_index"), at("mean_return").alias("mean_return"), at("share_declining").alias("share_declining"),
        total(0, 2).alias("return_after"), total(-2, 0).alias("return_before"), F.min("drawdown").alias("max_drawdown"), F.min(based).alias("low"), F.max(based).alias("high"),
    )


def rows_at(df: DataFrame, dates: DataFrame, date: str) -> DataFrame:
    """Rows of the listed dates."""
    from eventscope.operators.events import small

    return df.join(small(dates.select(date).distinct()), date, "left_semi")


def join_panels(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two panels on their keys."""
    return left.join(right, list(keys), "full")
