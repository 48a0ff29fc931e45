"""Concentration, shares, lead and lag, scorecards and other grouped measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.functions import blocks


def concentration(df: DataFrame, group: Sequence[str], party: str, amount: str, tops: Sequence[int] = (1, 5, 10), positive_only: bool = True) -> DataFrame:
    """Per group: parties, total, top shares (%), Herfindahl index (times 10,000) and Gini coefficient of party totals.

    Party totals are summed first; ranks are over parties of a group.  With ``positive_only`` parties
    without a positive total are left out, else they count with the rest.  A total of zero gives nulls.
    """
    totals = df.groupBy(*group, party).agg(F.sum(amount).alias("x"))
    totals = totals.filter("x > 0") if positive_only else totals.filter("x is not null")
    down = Window.partitionBy(*group).orderBy(F.col("x").desc(), party)
    up = Window.partitionBy(*group).orderBy("x", F.col(party).desc())
    ranked = totals.withColumns({"__down": F.row_number().over(down), "__up": F.row_number().over(up)})
    made = ranked.groupBy(*group).agg(
        F.count("*").alias("n_parties"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("__sq"), F.sum(F.col("__up") * F.col("x")).alias("__rx"),
        *[F.sum(F.when(F.col("__down") <= k, F.col("x"))).alias(f"__top{k}") for k in tops],
    )
    n, total = F.col("n_parties"), F.nullif(F.col("total"), F.lit(0.0))
    return made.select(
        *group, "n_parties", "total", *[(100 * F.try_divide(F.col(f"__top{k}"), total)).alias(f"top{k}_share") for k in tops],
        (10000 * F.try_divide(F.col("__sq"), total * total)).alias("hhi"), F.try_divide(2 * F.col("__rx") - (n + 1) * F.col("total"), n * total).alias("gini"),
    )


def category_share(df: DataFrame, group: Sequence[str], category: str, amount: str, values: Sequence[str]) -> DataFrame:
    """Share (%) of each listed category in the group's total; absent categories have 0."""
    sums = [F.coalesce(F.sum(F.when(F.col(category) == v, F.col(amount))), F.lit(0.0)).alias(f"__{k}") for k, v in enumerate(values)]
    made = df.groupBy(*group).agg(F.sum(amount).alias("__t"), *sums)
    named = [(100 * F.try_divide(F.col(f"__{k}"), F.nullif(F.col("__t"), F.lit(0.0)))).alias("share_" + v.lower().replace(" ", "_")) for k, v in enumerate(values)]
    return made.select(*group, *named)


def ratio_of_sums(df: DataFrame, group: Sequence[str], top: str, bottom: str, out: str = "ratio") -> DataFrame:
    return df.groupBy(*group).agg(F.try_divide(F.sum(top), F.nullif(F.sum(bottom), F.lit(0.0))).alias(out))


def lead_lag(df: DataFrame, group: Sequence[str], category: str, date: str, least: int = 3) -> DataFrame:
    """Per group and category: rows, first and median day, busiest week (Sunday; the earliest on ties), days to the group's first, and whether it leads.

    The leader has the earliest median among categories with ``least`` rows.
    """
    ids = [*group, category]
    week = F.next_day(F.date_sub(date, 1), "Sun")
    weekly = df.groupBy(*ids, week.alias("week")).agg(F.count("*").alias("c"))
    peaks = weekly.groupBy(*ids).agg(F.min_by("week", F.struct(-F.col("c"), F.col("week"))).alias("peak_week"))
    days = df.groupBy(*ids).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.percentile(F.unix_date(date), F.lit(0.5)).alias("__m"))
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.col("n") < least, "__m", category))
    made = days.join(peaks, ids).withColumn("lag_days", F.datediff("first_date", F.min("first_date").over(w))).withColumn("leads", (rank == 1) & (F.col("n") >= least))
    return made.select(*ids, "n", "first_date", F.date_from_unix_date(F.floor("__m").cast("int")).alias("median_date"), "peak_week", "lag_days", "leads")


def selected(counts: DataFrame, group: Sequence[str], value: str, n: str, points: Sequence[float]) -> DataFrame:
    """Per group the linear-interpolated quantiles ``q0, q1, ...`` at ``points``, from distinct values and how often each occurs.

    Values are dealt to ranges in order of group and value.  Sums over ranges say which of them hold the ranks
    that are sought, and only the rows of those are looked at again: no task holds a group.  Groups without a
    value have nulls.
    """
    placed = blocks.dealt(counts.select(*group, F.col(value).cast("double").alias("__v"), F.when(F.col(value).isNotNull(), F.col(n)).alias("__c")), [*group, "__v"], "value-counts")
    every = Window.partitionBy(*group)
    ranges = blocks.before(placed, group, {"lt": F.col("__c")}).withColumn("__n", F.sum("__n_lt").over(every))
    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in points]
    ends = [(F.floor(q), F.ceil(q)) for q in at]
    holds = reduce(Column.__or__, [(F.col("lt") <= hi) & (F.col("lt") + F.col("__n_lt") > lo) for lo, hi in ends])
    needed = blocks.named(ranges.filter(holds & (F.col("__n") > 0)).select(*group, blocks.RANGE, "lt", "__n"), [*group, blocks.RANGE], "__k_")
    inside = Window.partitionBy(*group, blocks.RANGE).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.filter("__v is not null").join(needed, blocks.same_keys([*group, blocks.RANGE], "__k_")).withColumn("__to", F.col("lt") + F.sum("__c").over(inside))
    pick = lambda rank: F.max(F.when((F.col("__to") - F.col("__c") <= rank) & (rank < F.col("__to")), F.col("__v")))
    picked = found.groupBy(*group).agg(F.first("__n").alias("__n"), *[pick(r).alias(f"__{side}{k}") for k, pair in enumerate(ends) for side, r in zip(("lo", "hi"), pair, strict=True)])
    between = [F.when(lo == hi, F.col(f"__lo{k}")).otherwise((hi - q) * F.col(f"__lo{k}") + (q - lo) * F.col(f"__hi{k}")).alias(f"q{k}") for k, (q, (lo, hi)) in enumerate(zip(at, ends, strict=True))]
    groups = ranges.select(*group).distinct()
    known = blocks.named(picked.select(*group, *between), group, "__k_")
    return groups.join(known, blocks.same_keys(group, "__k_"), "left").select(*group, *[f"q{k}" for k in range(len(points))])


def quantiles(df: DataFrame, group: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles, named ``q<percent>``; exact for groups of any size (``selected``)."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__c"))
    made = selected(counts, group, value, "__c", points)
    return made.select(*group, *[F.col(f"q{k}").alias(f"q{round(100 * p)}") for k, p in enumerate(points)])


def share_where(predicate: Column) -> Column:
    return F.avg(predicate.cast("double"))


def distinct_sorted(column: str, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


# The weights of the parts of the channel score.
CHANNEL_WEIGHTS = {"early": 0.20, "recurrence": 0.15, "cross_event": 0.15, "scale": 0.15, "role": 0.15, "centrality": 0.20}


def channel_score(df: DataFrame, event: str, party: str, amount: str, date: str, official: str, category: str, roles: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Composite score of each party from early, recurrent, cross-event, large, intermediary and central activity, each between 0 and 1.

    early: 1 with a row before some event's official date; recurrence: rows against the busiest party's;
    cross_event: other events joined of those there are; scale: 1 if some event total exceeds the 75th
    percentile of the event's single amounts; role: 1 if the party's most frequent category (the first by
    name on ties) is one of ``roles``; centrality: total against the largest.
    """
    first = df.groupBy(event, party).agg(F.max((F.col(date) < F.col(official)).cast("double")).alias("early"), F.sum(amount).alias("total"), F.count("*").alias("n"))
    cut = quantiles(df, [event], amount, [0.75]).withColumnRenamed("q75", "cut")
    per = first.join(cut, event).groupBy(party).agg(
        F.max("early").alias("early"), F.sum("n").alias("n"), F.count("*").alias("events"), F.max((F.col("total") > F.col("cut")).cast("double")).alias("scale"), F.sum("total").alias("total"),
    )
    usual = df.groupBy(party).agg(F.mode(category, True).isin(*roles).cast("double").alias("role"))
    tops = per.agg(F.max("n").alias("__n"), F.max("total").alias("__t"))
    count = df.agg(F.count_distinct(event).alias("__e"))
    joined = per.join(usual, party).crossJoin(F.broadcast(tops)).crossJoin(F.broadcast(count))  # one row each
    parts = joined.withColumns({
        "recurrence": F.try_divide(F.col("n").cast("double"), F.col("__n")), "cross_event": F.coalesce(F.try_divide((F.col("events") - 1).cast("double"), F.nullif(F.col("__e") - 1, F.lit(0))), F.lit(0.0)),
        "role": F.coalesce("role", F.lit(0.0)), "centrality": F.try_divide("total", "__t"),
    })
    score = reduce(Column.__add__, [F.col(name) * w for name, w in (weights or CHANNEL_WEIGHTS).items()])
    return parts.select(party, "early", "recurrence", "cross_event", "scale", "role", "centrality", score.alias("score"))


def scorecard(df: DataFrame, rules: Sequence[tuple[str, str, float, float, bool]]) -> DataFrame:
    """Points by two thresholds per rule ``(name, column, strong, weak, higher_is_better)``: 2, 1 or 0, null without a value; ``score`` is null if any is."""
    points = {}
    for name, column, strong, weak, up in rules:
        v = F.col(column)
        points[name] = F.when(v.isNull(), None).when(v >= strong if up else v <= strong, 2).when(v >= weak if up else v <= weak, 1).otherwise(0)
    return df.withColumns({n: c.cast("int") for n, c in points.items()}).withColumn("score", reduce(Column.__add__, [F.col(n) for n in points]))


def criteria_index(df: DataFrame, columns: Sequence[str], out: str = "index") -> DataFrame:
    """Number of criteria (Boolean or 0/1) that hold; a null does not."""
    return df.withColumn(out, reduce(Column.__add__, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns]))


def series_summary(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Per series: points, span, share of nonzero values, location and spread, slope on the row number, and the last 12 points against the earlier ones."""
    w = Window.partitionBy(*keys).orderBy(time)
    held = df.filter(F.col(value).isNotNull())
    placed = held.withColumn("i", F.row_number().over(w)).withColumn("__back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc())))
    v = F.col(value)
    made = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("stop"), F.avg((v != 0).cast("double")).alias("nonzero"), F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"), F.min_by(v, F.col(time)).alias("first"), F.max_by(v, F.col(time)).alias("last"),
        F.regr_slope(v, F.col("i").cast("double")).alias("slope"), F.try_divide(F.stddev_samp(v), F.nullif(F.avg(v), F.lit(0.0))).alias("cv"),
        F.avg(F.when(F.col("__back") <= 12, v)).alias("last12"), F.avg(F.when(F.col("__back") > 12, v)).alias("earlier"),
    )
    return made.withColumn("declines", F.col("last12") < F.col("earlier"))


def evaluate_alerts(df: DataFrame, group: Sequence[str], alert: str, label: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 per group; null flags count as false."""
    a, y = F.coalesce(F.col(alert), F.lit(False)), F.coalesce(F.col(label), F.lit(False))
    made = df.groupBy(*group).agg(F.count_if(a & y).alias("tp"), F.count_if(a & ~y).alias("fp"), F.count_if(~a & y).alias("fn"), F.count_if(~a & ~y).alias("tn"))
    tp = F.col("tp").cast("double")
    return made.withColumns({
        "precision": F.try_divide(tp, F.nullif(F.col("tp") + F.col("fp"), F.lit(0))), "recall": F.try_divide(tp, F.nullif(F.col("tp") + F.col("fn"), F.lit(0))),
        "f1": F.try_divide(2 * tp, F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))),
    })


def false_alarm_rate(df: DataFrame, group: Sequence[str], alert: str) -> DataFrame:
    """Alerts per decade and per year of weekly rows."""
    rate = F.avg(F.coalesce(F.col(alert), F.lit(False)).cast("double"))
    return df.groupBy(*group).agg(F.count("*").alias("weeks"), (rate * 520).alias("per_decade"), (rate * 52).alias("per_year"))


def crosstab(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each listed value per group, zeros included."""
    return df.groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(f"n_{str(v).lower()}") for v in values])


def topn_profile(df: DataFrame, keys: Sequence[str], by: str, flag: Column, sizes: Sequence[int]) -> DataFrame:
    """For the first 10, 20, ... rows by a measure: rows, share of the measure and share where ``flag`` holds."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc(), *[c for c in df.columns if c not in keys and c != by])))
    ranked = ranked.withColumn("top", F.explode(F.array(*[F.when(F.col("__r") <= s, F.lit(s)) for s in sizes]))).filter("top is not null")
    totals = df.groupBy(*keys).agg(F.sum(by).alias("__t"))
    made = ranked.groupBy(*keys, "top").agg(F.count("*").alias("n"), F.sum(by).alias("__s"), F.avg(flag.cast("double")).alias("flag_share"))
    return made.join(totals, list(keys)).select(*keys, "top", "n", (100 * F.try_divide("__s", F.nullif(F.col("__t"), F.lit(0.0)))).alias("share"), "flag_share")


def load_summary(df: DataFrame, key: str, date: str, party: str, amount: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_distinct(date).alias("dates"), F.count_distinct(party).alias("parties"), F.sum(amount).alias("total"), F.min(date).alias("first"), F.max(date).alias("last")
    )


def appearance_matrix(df: DataFrame, actor: str, event: str, values: Sequence[str]) -> DataFrame:
    """One row per actor, one 0/1 column per listed event."""
    return df.groupBy(actor).agg(*[F.max((F.col(event) == v).cast("int")).alias(f"in_{str(v).lower()}") for v in values])


def pre_event_return(panel: DataFrame, events: DataFrame, keys: Sequence[str], date: str, value: str, days: int, declining: str | None = None) -> DataFrame:
    """First and last value of the days before each acute start, the return in %, the mean share declining, and a verdict.

    ``declining`` names a column with the share of members that fell; without it that mean is left out.
    """
    from eventscope.operators.events import window_join

    held = window_join(panel.filter(F.col(value).isNotNull()), events, date, F.date_sub("acute_start", days), F.date_sub("acute_start", 1))
    more = [F.avg(declining).alias("mean_declining")] if declining else []
    made = held.groupBy(*keys, "event_key").agg(F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"), F.count("*").alias("n"), *more)
    made = made.withColumn("return_pct", 100 * (F.try_divide("last", F.nullif(F.col("first"), F.lit(0.0))) - 1))
    return made.withColumn("verdict", F.when(F.col("return_pct").isNull(), "no data").when(F.col("return_pct") <= -5, "fell before").when(F.col("return_pct") >= 5, "rose before").otherwise("flat"))


def rollup_period(df: DataFrame, group: Sequence[str], year: str, value: str) -> DataFrame:
    return df.groupBy(*group, year).agg(F.sum(value).alias(value))


def grouped_medians(df: DataFrame, sets: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Median, mean and count for several groupings stacked in one table (grouping sets); medians as ``selected`` gives them."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    by = lambda more: df.groupingSets([[F.col(c) for c in [*s, *more]] for s in sets], *[F.col(c) for c in [*columns, *more]])
    level = F.grouping_id()
    counts = by([value]).agg(F.count("*").alias("__c"), level.alias("__set")).withColumn("__set", F.shiftright("__set", 1))
    medians = blocks.named(selected(counts, [*columns, "__set"], value, "__c", [0.5]), [*columns, "__set"], "__g_")
    rest = by([]).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), level.alias("__set"))
    joined = rest.join(medians, blocks.same_keys([*columns, "__set"], "__g_"), "left")
    return joined.select(*columns, F.col("q0").alias("median"), "mean", "n")


def ledger_metrics(df: DataFrame, group: Sequence[str], party: str, amount: str) -> DataFrame:
    """Breadth of a ledger: rows, parties, parties with a positive total, top-5 share (%) and Herfindahl index over all totals."""
    totals = df.groupBy(*group, party).agg(F.sum(amount).alias("x"), F.count("*").alias("rows"))
    ranked = totals.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("x").desc_nulls_last(), party)))
    made = ranked.groupBy(*group).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("parties"), F.count_if(F.col("x") > 0).alias("positive"), F.sum("x").alias("__t"),
        F.sum(F.when(F.col("__r") <= 5, F.col("x"))).alias("__top"), F.sum(F.col("x") * F.col("x")).alias("__sq"),
    )
    t = F.nullif(F.col("__t"), F.lit(0.0))
    return made.select(*group, "rows", "parties", "positive", (100 * F.try_divide(F.col("__top"), t)).alias("top5_share"), (10000 * F.try_divide(F.col("__sq"), t * t)).alias("hhi"))


def moved_between(df: DataFrame, group: Sequence[str], old: str, new: str, amount: str) -> DataFrame:
    """Rows, share of rows and of amount (%) that a new classification moves, per group."""
    moved = ~F.col(old).eqNullSafe(F.col(new))
    made = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(moved).alias("moved"), F.sum(F.when(moved, F.col(amount)).otherwise(0.0)).alias("__m"), F.sum(amount).alias("__t"))
    return made.select(*group, "n", "moved", (100 * F.try_divide(F.col("moved").cast("double"), F.col("n"))).alias("moved_rows"), (100 * F.try_divide(F.col("__m"), F.nullif(F.col("__t"), F.lit(0.0)))).alias("moved_amount"))


def compare_segmentations(df: DataFrame, group: Sequence[str], parties: tuple[str, str], categories: tuple[str, str], amount: str, values: Sequence[str]) -> DataFrame:
    """Old against new naming and classification per group: parties, those merged, concentration, shares of the listed categories, and what moved.

    ``parties`` and ``categories`` name the old and the new column; columns of the result end in ``_old`` and ``_new``.
    """
    out = moved_between(df, group, *categories, amount)
    for end, party, category in zip(("old", "new"), parties, categories, strict=True):
        known = concentration(df, group, party, amount, tops=(5,)).select(*group, F.col("n_parties").alias(f"n_parties_{end}"), F.col("top5_share").alias(f"top5_share_{end}"), F.col("hhi").alias(f"hhi_{end}"))
        shares = category_share(df, group, category, amount, values)
        out = out.join(known, list(group), "left").join(shares.withColumnsRenamed({c: f"{c}_{end}" for c in shares.columns if c not in group}), list(group), "left")
    return out.withColumn("n_merged", F.col("n_parties_old") - F.col("n_parties_new"))


def pivot_long(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with stated columns, the first non-null value of each."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def unpivot_wide(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(columns), "name", "value")
