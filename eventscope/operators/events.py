"""Rows against event windows: phases, ranges, as-of and nearest matches.

``events`` is a dimension (``event_key, pre_start, acute_start, acute_peak, acute_end, post_end``).  While it is
small it is broadcast; a larger one meets the rows through equal buckets of days, so that no plan compares
every row with every window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.functions import blocks

#: Event tables up to this many rows are broadcast.
BROADCAST_EVENTS = 10_000


def is_small(events: DataFrame) -> bool:
    return events.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS


def small(events: DataFrame) -> DataFrame:
    """The event table marked for broadcast, once it is known to be small."""
    return F.broadcast(events) if is_small(events) else events


def range_join(df: DataFrame, windows: DataFrame, date: str, lo: Column, hi: Column, how: str = "inner") -> DataFrame:
    """``df`` with every window that holds its date: ``inner``, ``left_semi`` or ``left_anti``; bounds are inclusive, a null bound holds nothing.

    Windows beyond ``BROADCAST_EVENTS`` are dealt to the buckets of days that they reach into, as wide as windows
    are long on average, so a window is about two rows.  A row is in one bucket and meets each window once, by
    an equal key that adaptive execution can split.
    """
    if is_small(windows):
        return df.join(F.broadcast(windows), F.col(date).between(lo, hi), how)
    held = windows.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi")
    width = max(1, round(held.agg(F.avg(F.datediff("__hi", "__lo"))).first()[0] or 1))
    bucket = lambda d: F.floor(F.unix_date(F.col(d)) / F.lit(width)).cast("long")
    held = held.withColumn("__bucket", F.explode(F.sequence(bucket("__lo"), bucket("__hi"))))
    met = (F.col("__at") == F.col("__bucket")) & F.col(date).between(F.col("__lo"), F.col("__hi"))
    if how == "inner":
        return df.withColumn("__at", bucket(date)).join(held, met).drop("__at", "__bucket", "__lo", "__hi")
    days = df.select(F.col(date)).distinct()
    covered = days.withColumn("__at", bucket(date)).join(held.select("__bucket", "__lo", "__hi"), met, "left_semi").select(F.col(date).alias("__day"))
    return df.join(covered, F.col(date) == F.col("__day"), how)


def window_join(df: DataFrame, events: DataFrame, date: str = "date", lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Every row with every event whose window (from ``pre_start`` to ``post_end`` unless given) holds its date."""
    return range_join(df, events, date, F.col("pre_start") if lo is None else lo, F.col("post_end") if hi is None else hi)


def phase(date: Column) -> Column:
    return (
        F.when((date >= F.col("pre_start")) & (date < F.col("acute_start")), "pre")
        .when(date.between(F.col("acute_start"), F.col("acute_end")), "acute")
        .when((date > F.col("acute_end")) & (date <= F.col("post_end")), "post")
    )


def tag_phase(df: DataFrame, events: DataFrame, date: str = "date") -> DataFrame:
    """Rows of each event window with ``phase``: adjacent parts before, in and after the acute part."""
    return window_join(df, events, date).withColumn("phase", phase(F.col(date)))


def exclude_windows(df: DataFrame, windows: DataFrame, date: str, lo: Column, hi: Column) -> DataFrame:
    """Rows whose date is in none of the windows."""
    return range_join(df, windows, date, lo, hi, "left_anti")


def exclude_post(df: DataFrame, events: DataFrame, weeks: int = 12, date: str = "date") -> DataFrame:
    """Rows outside of every span from the acute start to some weeks after the peak."""
    return exclude_windows(df, events, date, F.col("acute_start"), F.date_add("acute_peak", 7 * weeks))


def pre_window(df: DataFrame, events: DataFrame, weeks: int, date: str = "date") -> DataFrame:
    """Rows of the weeks before each event's peak, the day of the peak left out."""
    return window_join(df, events, date, F.date_sub("acute_peak", 7 * weeks), F.date_sub("acute_peak", 1))


def quiet(df: DataFrame, events: DataFrame, days: int = 365, date: str = "date") -> DataFrame:
    """Rows further than ``days`` from every peak."""
    return exclude_windows(df, events, date, F.date_sub("acute_peak", days), F.date_add("acute_peak", days))


def label_within(df: DataFrame, events: DataFrame, weeks: int, date: str = "date", out: str = "label") -> DataFrame:
    """Add whether a peak falls in the weeks after the row, the row's own day left out."""
    dates = df.select(F.col(date).alias("__d")).distinct()
    hit = range_join(dates, events.select("acute_peak"), "__d", F.date_sub("acute_peak", 7 * weeks), F.date_sub("acute_peak", 1), "left_semi")
    marked = hit.withColumn(out, F.lit(True))
    return df.join(marked, df[date] == marked["__d"], "left").drop("__d").withColumn(out, F.coalesce(out, F.lit(False)))


def asof_join(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str] = (), value: str = "value", direction: str = "nearest") -> DataFrame:
    """``left`` with the ``value`` of ``right`` at the last date before or on, the first on or after, or the nearest date.

    At equal distance the later date counts.  Repeated dates of ``right`` give one of their values, the
    greatest.  Each distinct key and date of ``left`` is sought once.  Both sides are dealt together to ranges of
    key and date that hold about as many rows each and are merged inside them; what lies beyond a range comes
    from the first and last points of the others, a row a key and range.  So a heavy key, or no key at all, is
    many tasks.  A row without a date has no value.
    """
    back, ahead = direction in ("backward", "nearest"), direction in ("forward", "nearest")
    none, place = F.lit(None), [*keys, blocks.RANGE]
    points = right.filter(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.struct(F.col(on).alias("d"), F.max(value).alias("v")).alias("__r"))
    sought = left.filter(F.col(on).isNotNull()).select(*keys, on).distinct().withColumns({"__r": none.cast(points.schema["__r"].dataType), "__asked": F.lit(True)})
    both = blocks.dealt(sought.unionByName(points.withColumn("__asked", F.lit(False))), [*keys, on], "asof-sides")
    ends = both.groupBy(*place).agg(F.min("__r").alias("__first"), F.max("__r").alias("__last"))
    of = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.named(ends.select(*place, F.last("__last", ignorenulls=True).over(of(F.col(blocks.RANGE))).alias("__cb"), F.last("__first", ignorenulls=True).over(of(F.col(blocks.RANGE).desc())).alias("__ca")), place, "__k_")
    inside = lambda order: F.last("__r", ignorenulls=True).over(Window.partitionBy(*place).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if back:
        both = both.withColumn("__b", inside(F.col(on)))
    if ahead:
        both = both.withColumn("__a", inside(F.col(on).desc()))
    both = both.filter("__asked").join(carried, blocks.same_keys(place, "__k_"), "left")
    before, after = F.coalesce("__b", "__cb") if back else none, F.coalesce("__a", "__ca") if ahead else none
    if direction == "nearest":
        gap_b, gap_a = F.datediff(on, before["d"]), F.datediff(after["d"], on)
        taken = F.when(after.isNull() | (gap_b < gap_a), before).otherwise(after)
    else:
        taken = before if back else after
    found = blocks.named(both.select(*keys, on, taken["v"].alias("__t")), [*keys, on], "__s_")
    return left.join(found, blocks.same_keys([*keys, on], "__s_"), "left").select(*[F.col(f"`{c}`") for c in left.columns if c != value], F.col("__t").alias(value))


def interval_lookup(df: DataFrame, intervals: DataFrame, date: str, lo: str, hi: str, name: str) -> DataFrame:
    """``df`` with the name of the covering interval that starts first, null without one."""
    days = df.select(date).distinct()
    hit = range_join(days, intervals, date, F.col(lo), F.col(hi)).groupBy(date).agg(F.min_by(name, F.struct(F.col(lo), F.col(name))).alias(name))
    return df.join(hit, date, "left")


def last_in_interval(df: DataFrame, intervals: DataFrame, date: str, lo: str, hi: str, name: str, value: str) -> DataFrame:
    """Per interval the date and value of its last row."""
    inside = range_join(df, intervals, date, F.col(lo), F.col(hi))
    return inside.groupBy(name).agg(F.max(date).alias("anchor_date"), F.max_by(value, date).alias("anchor_value"))


def nearest_event(df: DataFrame, events: DataFrame, date: str = "date", peak: str = "acute_peak") -> DataFrame:
    """``df`` with ``nearest_event`` and ``gap_days`` (row minus peak); the first key on ties.

    The nearest peak of each distinct date comes from an as-of join, so no date meets every event.
    """
    days = df.select(F.col(date).alias("__d")).distinct()
    peaks = events.filter(F.col(peak).isNotNull()).groupBy(F.col(peak).alias("__d")).agg(F.min("event_key").alias("event_key"))
    sides = [asof_join(days, peaks.select("__d", F.struct("__d", "event_key").alias("m")), "__d", (), "m", way) for way in ("backward", "forward")]
    met = sides[0].withColumnRenamed("m", "b").join(sides[1].withColumnRenamed("m", "a"), "__d")
    gap = lambda m: F.datediff("__d", m["__d"])
    closest = F.least(*[F.struct(F.abs(gap(m)).alias("far"), m["event_key"].alias("event_key"), gap(m).alias("gap")) for m in (F.col("b"), F.col("a"))])
    only = F.when(F.col("a").isNull(), F.struct(F.abs(gap(F.col("b"))).alias("far"), F.col("b.event_key").alias("event_key"), gap(F.col("b")).alias("gap"))).when(F.col("b").isNull(), F.struct(F.abs(gap(F.col("a"))).alias("far"), F.col("a.event_key").alias("event_key"), gap(F.col("a")).alias("gap"))).otherwise(closest)
    near = met.select("__d", only.alias("m"))
    return df.join(near, df[date] == near["__d"], "left").select(*df.columns, F.col("m.event_key").alias("nearest_event"), F.col("m.gap").alias("gap_days"))


def count_within(centers: DataFrame, points: DataFrame, days: int, center: str = "center", date: str = "date", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates (a count unless given) of the points within ``days`` of each centre; centres without points stay.

    Centres and points meet in buckets of ``days``, so no side needs to be small.
    """
    width = max(1, days)
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(width)).cast("int")
    around = centers.select(center).distinct().withColumn("__b", F.explode(F.array(*[bucket(F.col(center)) + k for k in (-1, 0, 1)])))
    near = points.withColumn("__b", bucket(F.col(date)))
    hits = around.join(near, "__b").filter(F.abs(F.datediff(date, center)) <= days)
    made = hits.groupBy(center).agg(*[c.alias(n) for n, c in (aggregates or {"n": F.count("*")}).items()])
    out = centers.join(made, center, "left")
    return out.fillna(0, ["n"]) if aggregates is None else out


def event_time(df: DataFrame, events: DataFrame, unit: str, date: str = "date") -> DataFrame:
    """Rows of each window with ``rel``: whole weeks (half to even), calendar months or days from the peak."""
    rel = {
        "week": F.bround(F.datediff(date, "acute_peak") / 7.0).cast("int"),
        "month": (F.year(date) - F.year("acute_peak")) * 12 + F.month(date) - F.month("acute_peak"),
        "day": F.datediff(date, "acute_peak"),
    }[unit]
    return window_join(df, events, date).withColumn("rel", rel)


def rebase(df: DataFrame, keys: Sequence[str], value: str, base: Column, mode: str = "index") -> DataFrame:
    """``value`` as an index of 100 at the baseline, or as the deviation from it; the baseline is the mean where ``base`` is true."""
    level = F.avg(F.when(base, F.col(value))).over(Window.partitionBy(*keys))
    made = F.try_divide(F.col(value), level) * 100 if mode == "index" else F.col(value) - level
    return df.withColumn(f"{value}_{mode}", made)


def variant_grid(events: DataFrame, variants: DataFrame) -> DataFrame:
    """Every event under every variant (``variant, baseline_days, widen_days``): the days before the acute start, and the acute window widened (or narrowed) at both ends.

    Both are dimensions; their product is broadcast later only if it is small.
    """
    grid = events.crossJoin(small(variants))
    made = grid.withColumns({
        "base_start": F.date_sub("acute_start", F.col("baseline_days")), "base_end": F.date_sub("acute_start", 1),
        "wide_start": F.date_sub("acute_start", F.col("widen_days")), "wide_end": F.date_add("acute_end", F.col("widen_days")),
    })
    return made


def event_metrics(panel: DataFrame, events: DataFrame, keys: Sequence[str], level: str, stock: str, rate: str, size: str, date: str = "date") -> DataFrame:
    """Per key and event: means before, extremes within, ratios, and days to the peak, the first rise and recovery.

    ``level`` is the series that rises (lending), ``stock`` the one that falls (reserve), ``rate`` a price and
    ``size`` the total that the level is a share of.  The rise is the first acute date with a rate above the
    last one before; recovery and normalisation are the first dates from the peak on at which the stock
    reaches, or the level falls to, its mean before.  Rows of a key and event are shuffled once: what later
    steps compare with is a window over the same partition.  Empty phases give nulls.
    """
    ids = [*keys, "event_key"]
    tagged = tag_phase(panel, events, date)
    pre, acute = F.col("phase") == "pre", F.col("phase") == "acute"
    w = Window.partitionBy(*ids)
    known = {
        "pre_level": F.avg(F.when(pre, F.col(level))), "pre_stock": F.avg(F.when(pre, F.col(stock))), "pre_rate": F.avg(F.when(pre, F.col(rate))),
        "last_rate": F.max_by(rate, F.when(pre, F.col(date))), "peak_date": F.min_by(date, F.when(acute & F.col(level).isNotNull(), F.struct(-F.col(level), F.col(date)))),
    }
    marked = tagged.select(*ids, date, level, stock, rate, size, "acute_start", acute.alias("acute"), *[c.over(w).alias(n) for n, c in known.items()])
    first = lambda when: F.min(F.when(when, F.col(date)))
    after = F.col(date) >= F.col("peak_date")
    made = marked.groupBy(*ids).agg(
        *[F.first(n).alias(n) for n in known], F.first("acute_start").alias("acute_start"), F.max(F.when(F.col("acute"), F.col(level))).alias("acute_level"),
        F.min(F.when(F.col("acute"), F.col(stock))).alias("acute_stock"), F.max(F.when(F.col("acute"), F.col(rate))).alias("acute_rate"), F.max(F.when(F.col("acute"), F.col(size))).alias("acute_size"),
        first(F.col("acute") & (F.col(rate) > F.col("last_rate"))).alias("rise_date"), first(after & (F.col(stock) >= F.col("pre_stock"))).alias("recovery_date"), first(after & (F.col(level) <= F.col("pre_level"))).alias("normal_date"),
    )
    return made.select(
        *ids, "pre_level", "pre_stock", "pre_rate", "acute_level", "acute_stock", "acute_rate", F.try_divide("acute_level", "pre_level").alias("scale_ratio"), F.try_divide("acute_level", "acute_size").alias("size_share"),
        (100 * F.try_divide(F.col("pre_stock") - F.col("acute_stock"), F.col("pre_stock"))).alias("stock_loss_pct"), (F.col("acute_rate") - F.col("pre_rate")).alias("rate_change"),
        F.datediff("peak_date", "acute_start").alias("days_to_peak"), F.datediff("rise_date", "acute_start").alias("days_to_rise"),
        F.datediff("recovery_date", "peak_date").alias("days_to_recovery"), F.datediff("normal_date", "peak_date").alias("days_to_normal"),
    )


def sensitivity(panel: DataFrame, events: DataFrame, variants: DataFrame, keys: Sequence[str], level: str, rate: str, date: str = "date") -> DataFrame:
    """Eight event metrics under every variant of the windows, in one range join and one shuffle; days count from the unchanged acute start."""
    ids = [*keys, "event_key", "variant"]
    grid = variant_grid(events, variants)
    joined = window_join(panel, grid, date, F.least("base_start", "wide_start"), F.greatest("base_end", "wide_end"))
    pre, acute = F.col(date).between(F.col("base_start"), F.col("base_end")), F.col(date).between(F.col("wide_start"), F.col("wide_end"))
    last = F.max_by(rate, F.when(pre, F.col(date))).over(Window.partitionBy(*ids))
    marked = joined.select(*ids, date, level, rate, "acute_start", pre.alias("pre"), acute.alias("acute"), last.alias("last_rate"))
    inside = lambda c, flag: F.when(F.col(flag), F.col(c))
    made = marked.groupBy(*ids).agg(
        F.avg(inside(level, "pre")).alias("pre_level"), F.avg(inside(rate, "pre")).alias("pre_rate"), F.max(inside(level, "acute")).alias("acute_level"), F.max(inside(rate, "acute")).alias("acute_rate"),
        F.min_by(date, F.when(F.col("acute") & F.col(level).isNotNull(), F.struct(-F.col(level), F.col(date)))).alias("peak_date"),
        F.min(F.when(F.col("acute") & (F.col(rate) > F.col("last_rate")), F.col(date))).alias("rise_date"), F.first("acute_start").alias("acute_start"),
    )
    return made.select(
        *ids, "pre_level", "pre_rate", "acute_level", "acute_rate", F.try_divide("acute_level", "pre_level").alias("scale_ratio"), (F.col("acute_rate") - F.col("pre_rate")).alias("rate_change"),
        F.datediff("peak_date", "acute_start").alias("days_to_peak"), F.datediff("rise_date", "acute_start").alias("days_to_rise"),
    )
