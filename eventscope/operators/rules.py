"""Feature sets, stress indices, alert rules and their backtests over weekly panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventscope.functions import timeseries as ts
from eventscope.functions.columns import row_mean
from eventscope.operators import events as ev
from eventscope.operators.aggregates import evaluate_alerts, false_alarm_rate

#: Features: name -> (column, kind, rows); the sign says which direction is stress.
Spec = Sequence[tuple[str, str, str, int]]


def build_features(panel: DataFrame, keys: Sequence[str], time: str, spec: Spec, delay: int = 0) -> DataFrame:
    """Add one column per entry of ``spec``: ``diff`` or ``pct`` over rows, or ``gap`` to the mean of earlier rows."""
    made = {}
    for name, column, kind, rows in spec:
        if kind == "diff":
            made[name] = ts.diff(column, keys, time, rows, delay)
        elif kind == "pct":
            made[name] = ts.pct_change(column, keys, time, rows, delay)
        else:
            made[name] = F.col(column) - ts.past_mean(column, keys, time, rows, rows // 2)
    return panel.withColumns(made)


def warning_index(feats: DataFrame, keys: Sequence[str], time: str, components: dict[str, int], plain: dict[str, int] | None = None, seasonal: bool = False, min_periods: int = 52, prefix: str = "") -> DataFrame:
    """Add signed past z-scores of the components (``<c>_z``), their mean ``index`` and its past percentile ``score``.

    ``plain`` names columns that enter the mean with their sign as they are.  With ``seasonal`` the scores are
    taken within calendar months of earlier years.  ``prefix`` goes before all names that are added.
    """
    z, periods = (ts.past_seasonal_z, 5) if seasonal else (ts.past_z, min_periods)
    scored = feats.withColumns({f"{prefix}{c}_z": z(c, keys, time, periods) * sign for c, sign in components.items()})
    parts = [F.col(f"{prefix}{c}_z") for c in components] + [F.col(c) * sign for c, sign in (plain or {}).items()]
    # nine decimals, so that equal weeks rank equal whatever the order of sums
    indexed = scored.withColumn(f"{prefix}index", F.round(row_mean(*parts), 9))
    return ts.past_pct_rank(indexed, f"{prefix}index", keys, time, min_periods, f"{prefix}score")


@dataclass(frozen=True)
class AlertRule:
    """An alert rule over a score or an index: ``kind`` is threshold, persistence, ewma or cusum."""

    name: str
    kind: str
    column: str
    params: tuple[float, ...]


# The menu of rules that is backtested.
MENU = (
    AlertRule("threshold_score>=80", "threshold", "score", (80,)),
    AlertRule("threshold_score>=90", "threshold", "score", (90,)),
    AlertRule("threshold_score>=95", "threshold", "score", (95,)),
    AlertRule("persistence_2of4_80", "persistence", "score", (2, 4, 80)),
    AlertRule("persistence_3of6_80", "persistence", "score", (3, 6, 80)),
    AlertRule("persistence_6of12_80", "persistence", "score", (6, 12, 80)),
    AlertRule("ewma_lam=0.2_2sigma", "ewma", "index", (0.2, 2.0)),
    AlertRule("ewma_lam=0.1_2sigma", "ewma", "index", (0.1, 2.0)),
    AlertRule("cusum_k=0.5_h=5", "cusum", "index", (0.5, 5.0)),
    AlertRule("cusum_k=0.25_h=4", "cusum", "index", (0.25, 4.0)),
    AlertRule("threshold_seasonal>=80", "threshold", "seasonal_score", (80,)),
    AlertRule("persistence_3of6_seasonal_80", "persistence", "seasonal_score", (3, 6, 80)),
)


def menu_alerts(scored: DataFrame, keys: Sequence[str], time: str, menu: Sequence[AlertRule] = MENU, min_periods: int = 52) -> DataFrame:
    """Alerts of all rules of a menu as ``(keys, time, rule, alert)``.

    All recursions go over the series together: smoothed means of the ``ewma`` rules, and CUSUMs of the
    columns scored against their own past.  The rest are window expressions.
    """
    w = ts.past(keys, time)
    used = list(dict.fromkeys(r.column for r in menu))
    made = scored.select(*keys, time, *used)
    made = made.withColumns({f"{c}_past_z": ts.past_z(c, keys, time, min_periods) for c in {r.column for r in menu if r.kind == "cusum"}})
    steps = {f"r{k}": (r.column, ts.Ewma(r.params[0])) for k, r in enumerate(menu) if r.kind == "ewma"}
    steps |= {f"r{k}": (f"{r.column}_past_z", ts.Cusum(*r.params)) for k, r in enumerate(menu) if r.kind == "cusum"}
    if steps:
        made = ts.fold_each(made, keys, time, steps)
    flags, hot = {}, {}
    for k, r in enumerate(menu):
        if r.kind == "threshold":
            flags[r.name] = threshold_rule(r.column, r.params[0])
        elif r.kind == "persistence":
            hot[f"h{k}"] = threshold_rule(r.column, r.params[2])
            flags[r.name] = ts.persistence(f"h{k}", keys, time, int(r.params[0]), int(r.params[1]))
        elif r.kind == "ewma":
            flags[r.name] = above_own_past(f"r{k}", w, r.params[1], min_periods)
        else:
            flags[r.name] = F.col(f"r{k}") == 1
    return long_alerts(made.withColumns(hot) if hot else made, keys, time, flags)


def above_own_past(x: str, earlier: WindowSpec, sigmas: float, min_periods: int) -> Column:
    """Whether a value exceeds the mean of its earlier ones by so many of their deviations."""
    high = F.col(x) > F.avg(x).over(earlier) + sigmas * F.stddev_samp(x).over(earlier)
    return F.coalesce((F.count(x).over(earlier) >= min_periods) & high, F.lit(False))


def threshold_rule(score: str, at: float) -> Column:
    return F.coalesce(F.col(score) >= at, F.lit(False))


def ewma_rule(df: DataFrame, keys: Sequence[str], time: str, x: str, alpha: float = 0.2, sigmas: float = 2.0, min_periods: int = 52) -> DataFrame:
    """Add ``ewma`` and ``alert``: the mean exceeds its own past mean by so many past deviations."""
    smooth = ts.ewma(df.select(*keys, time, x), keys, time, x, alpha)
    return smooth.withColumn("alert", above_own_past("ewma", ts.past(keys, time), sigmas, min_periods))


def long_alerts(df: DataFrame, keys: Sequence[str], time: str, rules: dict[str, Column]) -> DataFrame:
    """Alerts of several rules over the same columns as ``(keys, time, rule, alert)``."""
    staged = df.select(*keys, time, *[F.coalesce(c, F.lit(False)).alias(f"a{k}") for k, c in enumerate(rules.values())])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"a{k}").alias("alert")) for k, n in enumerate(rules)])
    return staged.select(*keys, time, F.inline(entries))


def backtest(alerts: DataFrame, events: DataFrame, keys: Sequence[str], time: str, horizons: Sequence[int]) -> DataFrame:
    """Precision, recall and F1 by rule and horizon in weeks."""
    out = [evaluate_alerts(ev.label_within(alerts, events, h, time), ["rule"], "alert", "label").withColumn("horizon", F.lit(h)) for h in horizons]
    return reduce(DataFrame.unionByName, out)


def detection(alerts: DataFrame, events: DataFrame, weeks: int, time: str, group: Sequence[str] = ("rule",)) -> DataFrame:
    """Per group and event: alerts of the weeks before the peak, the first of them and its lead in whole weeks."""
    held = ev.pre_window(alerts, events, weeks, time)
    made = held.groupBy(*group, "event_key", "acute_peak").agg(F.count_if("alert").alias("n_alerts"), F.min(F.when(F.col("alert"), F.col(time))).alias("first_alert"))
    return made.withColumn("lead_weeks", F.floor(F.datediff("acute_peak", "first_alert") / 7).cast("int")).withColumn("detected", F.col("n_alerts") > 0).drop("acute_peak")


def lead_summary(found: DataFrame, group: Sequence[str] = ("rule",)) -> DataFrame:
    """Per rule, from ``detection``: events, detected ones, and the median lead in weeks over these."""
    made = found.groupBy(*group).agg(F.count("*").alias("events"), F.count_if("detected").alias("detected"), F.percentile(F.when(F.col("detected"), F.col("lead_weeks")), F.lit(0.5)).alias("median_lead"))
    return made


def quiet_rate(alerts: DataFrame, events: DataFrame, time: str, days: int = 365, group: Sequence[str] = ("rule",)) -> DataFrame:
    """False alarms per decade and year in weeks far from every peak."""
    return false_alarm_rate(ev.quiet(alerts, events, days, time), list(group), "alert")


def rate_signal(rate: DataFrame, events: DataFrame, value: str = "rate", date: str = "date", before: int = 300, after: int = 45, near: int = 90, calm: int = 150) -> DataFrame:
    """Tightening of a step series around each event: sustained start, start of the run-up, baseline, peak and its date.

    All within [acute_peak - before, acute_peak + after] days.  The peak is the earliest highest value from
    ``near`` days before the event on; the baseline is the lowest value at least ``calm`` days before it, or of
    the whole span if there is none.  Up to the peak, the sustained start is the first rise to above the
    baseline after which no value falls below the level before that rise, and the run-up starts with the first
    rise after the last cut.  Missing values are left out; events without observations have no row.
    """
    held = ev.window_join(rate.filter(F.col(value).isNotNull()), events, date, F.date_sub("acute_peak", before), F.date_add("acute_peak", after)).select("event_key", "acute_peak", date, F.col(value).alias("v"))
    w, back = Window.partitionBy("event_key").orderBy(date), Window.partitionBy("event_key").orderBy(F.col(date).desc())
    peak = F.max(F.when(F.col(date) >= F.date_sub("acute_peak", near), F.struct("v", (-F.unix_date(date)).alias("d"))))
    levels = held.groupBy("event_key").agg(peak.alias("p"), F.coalesce(F.min(F.when(F.col(date) <= F.date_sub("acute_peak", calm), F.col("v"))), F.min("v")).alias("baseline"), F.first("acute_peak").alias("peak_of"))
    levels = levels.select("event_key", "baseline", "peak_of", F.col("p.v").alias("peak_value"), F.date_from_unix_date(-F.col("p.d")).alias("peak_date"))
    upto = held.join(levels, "event_key").filter(F.col(date) <= F.col("peak_date")).withColumn("prior", F.lag("v").over(w))
    marked = upto.withColumns({"floor": F.min("v").over(back.rowsBetween(Window.unboundedPreceding, 0)), "last_cut": F.max(F.when(F.col("v") < F.col("prior"), F.col(date))).over(Window.partitionBy("event_key"))})
    up = F.col("v") > F.col("prior")
    sustained = up & (F.col("v") > F.col("baseline")) & (F.col("floor") >= F.col("prior") - 1e-9)
    run_up = up & (F.col("last_cut").isNull() | (F.col(date) > F.col("last_cut")))
    starts = marked.groupBy("event_key").agg(F.min(F.when(sustained, F.col(date))).alias("sustained_start"), F.min(F.when(run_up, F.col(date))).alias("run_up_start"))
    made = levels.join(starts, "event_key", "left")
    leads = [F.datediff("peak_of", f"{c}_start").alias(f"{c}_lead") for c in ("sustained", "run_up")]
    return made.select("event_key", "sustained_start", "run_up_start", "baseline", "peak_value", "peak_date", *leads)


#: Spans before the peak that ``warning_summary`` looks at, in weeks.
SPANS = (12, 8, 4)


def warning_summary(scored: DataFrame, events: DataFrame, keys: Sequence[str], time: str, score: str, components: Sequence[str], spans: Sequence[int] = SPANS, high: float = 80.0, forest: DataFrame | None = None) -> DataFrame:
    """Per series and event, over each span of weeks before the peak: highest score, first date at ``high`` and whole weeks ahead.

    Over the longest span also the three components with the highest means, with those (``name=value``, two
    decimals, zero without a sign; equal means by name).  ``forest`` (``keys, event_key, time, score, anomaly``: rows of a model
    fitted on what was known before) adds its highest score, its first flag and whether there is any.
    """
    held = ev.pre_window(scored, events, max(spans), time)
    ids = [*keys, "event_key"]
    inside = lambda w, c: F.when(F.col(time) >= F.date_sub("acute_peak", 7 * w), c)
    made = held.groupBy(*ids, "acute_peak").agg(
        *[F.max(inside(w, F.col(score))).alias(f"max_score_{w}w") for w in spans], *[F.min(inside(w, F.when(F.col(score) >= high, F.col(time)))).alias(f"first_high_{w}w") for w in spans],
        *[F.avg(c).alias(f"__{c}") for c in components],
    )
    named = F.filter(F.array(*[F.struct((-F.col(f"__{c}")).alias("v"), F.lit(c).alias("n")) for c in components]), lambda s: s["v"].isNotNull())
    top = F.array_join(F.transform(F.slice(F.array_sort(named), 1, 3), lambda s: F.concat(s["n"], F.lit("="), F.round(-s["v"], 2).cast("string"))), ", ")
    weeks = [F.floor(F.datediff("acute_peak", f"first_high_{w}w") / 7).cast("int").alias(f"weeks_before_{w}w") for w in spans]
    made = made.select(*ids, *[f"max_score_{w}w" for w in spans], *[f"first_high_{w}w" for w in spans], *weeks, top.alias("top_components"))
    if forest is None:
        return made
    found = forest.groupBy(*ids).agg(F.max("score").alias("max_forest_score"), F.min(F.when(F.col("anomaly"), F.col(time))).alias("first_forest_flag"))
    status = F.when(F.col("max_forest_score").isNotNull(), "ok").otherwise("insufficient_training_data")
    return made.join(found, ids, "left").withColumn("forest_status", status)
