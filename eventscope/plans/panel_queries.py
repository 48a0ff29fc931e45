"""Queries over panels and ledgers: event windows, aggregates, time series and alert rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions import columns as fc
from eventscope.functions import timeseries as ts
from eventscope.operators import aggregates as ag
from eventscope.operators import chains
from eventscope.operators import events as ev
from eventscope.operators import rules as ru
from eventscope.plans.fixtures import table, view
from eventscope.plans.registry import query
from eventscope.sources import readers
from eventscope.sources.storage import materialize

KEYS = ["series_id"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero: results then compare across engines."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- event windows -------------------------------------------------------------------------

_TAGGED = """tg AS (SELECT p.*, e.event_key, e.acute_start, e.acute_peak, CASE WHEN date >= pre_start AND date < acute_start THEN 'pre' WHEN date BETWEEN acute_start AND acute_end THEN 'acute'
  WHEN date > acute_end AND date <= post_end THEN 'post' END AS phase FROM weekly_panel p JOIN events_dim e ON date BETWEEN pre_start AND post_end)"""


_PANEL = """pz AS (SELECT *, reserve / nullif(deposits, 0) AS rr, CASE WHEN lending IS NULL AND reserve IS NULL AND deposits IS NULL THEN NULL ELSE coalesce(lending, 0) + coalesce(reserve, 0) + coalesce(deposits, 0) END AS size FROM weekly_panel)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel with the ratio that serves as a rate, and the total."""
    made = readers.add_ratios(view(spark, sf_dir, "weekly_panel"), {"rr": ("reserve", "deposits")})
    return made.withColumn("size", fc.sum_nullable(F.col("lending"), F.col("reserve"), F.col("deposits")))


@query(
    "event_metrics",
    f"""WITH {_PANEL}, {_TAGGED.replace("FROM weekly_panel p", "FROM pz p")},
    b AS (SELECT series_id, event_key, avg(lending) FILTER (phase='pre') AS pre_level, avg(reserve) FILTER (phase='pre') AS pre_stock, avg(rr) FILTER (phase='pre') AS pre_rate, max(lending) FILTER (phase='acute') AS acute_level,
      min(reserve) FILTER (phase='acute') AS acute_stock, max(rr) FILTER (phase='acute') AS acute_rate, max(size) FILTER (phase='acute') AS acute_size, first(acute_start) AS acute_start, max(date) FILTER (phase='pre') AS last_pre FROM tg GROUP BY 1,2),
    lr AS (SELECT b.series_id, b.event_key, rr AS last_rate FROM b JOIN pz p ON p.series_id = b.series_id AND p.date = b.last_pre),
    pk AS (SELECT tg.series_id, tg.event_key, min(date) AS peak_date FROM tg JOIN b USING (series_id, event_key) WHERE phase='acute' AND lending = acute_level GROUP BY 1,2),
    a AS (SELECT tg.series_id, tg.event_key, min(date) FILTER (phase = 'acute' AND rr > last_rate) AS rise_date, min(date) FILTER (date >= peak_date AND reserve >= pre_stock) AS recovery_date, min(date) FILTER (date >= peak_date AND lending <= pre_level) AS normal_date
      FROM tg JOIN b USING (series_id, event_key) LEFT JOIN pk USING (series_id, event_key) LEFT JOIN lr USING (series_id, event_key) GROUP BY 1,2)
    SELECT series_id, event_key, round(pre_level,6) AS pre_level, round(pre_stock,6) AS pre_stock, round(pre_rate,6) AS pre_rate, round(acute_level,6) AS acute_level, round(acute_stock,6) AS acute_stock, round(acute_rate,6) AS acute_rate,
      round(acute_level/nullif(pre_level,0),6) AS scale_ratio, round(acute_level/nullif(acute_size,0),6) AS size_share, round(100*(pre_stock-acute_stock)/nullif(pre_stock,0),6) AS stock_loss_pct, round(acute_rate-pre_rate,6) AS rate_change,
      peak_date - acute_start AS days_to_peak, rise_date - acute_start AS days_to_rise, recovery_date - peak_date AS days_to_recovery, normal_date - peak_date AS days_to_normal
    FROM b LEFT JOIN pk USING (series_id, event_key) LEFT JOIN a USING (series_id, event_key)""",
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rounded(ev.event_metrics(_panel(spark, sf_dir), view(spark, sf_dir, "events_dim"), KEYS, "lending", "reserve", "rr", "size"))
    return made.withColumns({c: F.col(c).cast("long") for c in ("days_to_peak", "days_to_rise", "days_to_recovery", "days_to_normal")})


@query(
    "phase_counts",
    f"WITH {_TAGGED} SELECT series_id, event_key, phase, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM tg GROUP BY 1,2,3",
)
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = ev.tag_phase(view(spark, sf_dir, "weekly_panel"), view(spark, sf_dir, "events_dim"))
    return tagged.groupBy("series_id", "event_key", "phase").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    "window_masks",
    """SELECT series_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM events_dim WHERE date BETWEEN acute_start AND acute_peak + 84)) AS outside_post,
      count(*) FILTER (NOT EXISTS (SELECT 1 FROM events_dim WHERE date BETWEEN acute_peak - 365 AND acute_peak + 365)) AS quiet,
      count(*) FILTER (EXISTS (SELECT 1 FROM events_dim WHERE acute_peak > date AND acute_peak <= date + 56)) AS labelled,
      count(*) FILTER (EXISTS (SELECT 1 FROM events_dim WHERE date BETWEEN acute_peak - 84 AND acute_peak - 1)) AS pre_rows FROM weekly_panel GROUP BY series_id""",
)
def window_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, events = view(spark, sf_dir, "weekly_panel").select("series_id", "date"), view(spark, sf_dir, "events_dim")
    count = lambda df, name: df.groupBy("series_id").agg(F.count("*").alias(name))
    out = ev.label_within(panel, events, 8).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if("label").alias("labelled"))
    parts = [count(ev.exclude_post(panel, events), "outside_post"), count(ev.quiet(panel, events), "quiet"), count(ev.pre_window(panel, events, 12), "pre_rows")]
    for p in parts:
        out = out.join(p, "series_id", "left")
    return out.fillna(0)


@query(
    "asof_nearest",
    """WITH c AS (SELECT p.series_id, p.date, r.rate, row_number() OVER (PARTITION BY p.series_id, p.date ORDER BY abs(p.date - r.date), r.date DESC) AS k
      FROM (SELECT DISTINCT series_id, date FROM weekly_panel) p JOIN daily_rate r ON abs(p.date - r.date) <= 400) SELECT series_id, date, rate FROM c WHERE k = 1""",
)
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every series meets the same rates, so the join is by date alone: each distinct date is sought once
    return ev.asof_join(view(spark, sf_dir, "weekly_panel").select("series_id", "date"), view(spark, sf_dir, "daily_rate"), "date", (), "rate")


@query(
    "asof_backward",
    """WITH l AS (SELECT CAST(date AS DATE) + 3 AS date, count(*) AS n FROM ledger GROUP BY 1) SELECT l.date, l.n, r.rate FROM l ASOF LEFT JOIN daily_rate r ON l.date >= r.date""",
)
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = view(spark, sf_dir, "ledger").groupBy(F.date_add("date", 3).alias("date")).agg(F.count("*").alias("n"))
    return ev.asof_join(left, view(spark, sf_dir, "daily_rate"), "date", (), "rate", "backward")


@query("asof_forward", """WITH l AS (SELECT CAST(date AS DATE) + 3 AS date, count(*) AS n FROM ledger GROUP BY 1) SELECT l.date, l.n, r.rate FROM l ASOF LEFT JOIN daily_rate r ON l.date <= r.date""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = view(spark, sf_dir, "ledger").groupBy(F.date_add("date", 3).alias("date")).agg(F.count("*").alias("n"))
    return ev.asof_join(left, view(spark, sf_dir, "daily_rate"), "date", (), "rate", "forward")


@query(
    "nearest_event",
    """WITH d AS (SELECT DISTINCT date FROM weekly_panel), c AS (SELECT d.date, event_key, (d.date - acute_peak)::INT AS gap, row_number() OVER (PARTITION BY d.date ORDER BY abs(d.date - acute_peak), event_key) AS k FROM d, events_dim)
      SELECT date, event_key AS nearest_event, gap AS gap_days FROM c WHERE k = 1""",
)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.nearest_event(view(spark, sf_dir, "weekly_panel").select("date").distinct(), view(spark, sf_dir, "events_dim"))


@query(
    "band_count",
    """SELECT c.center, count(p.date) AS n FROM (SELECT DISTINCT date AS center FROM daily_rate) c LEFT JOIN (SELECT DISTINCT date FROM weekly_panel) p ON abs(c.center - p.date) <= 90 GROUP BY 1""",
)
def band_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = view(spark, sf_dir, "daily_rate").select(F.col("date").alias("center")).distinct()
    return ev.count_within(centers, view(spark, sf_dir, "weekly_panel").select("date").distinct(), 90)


@query(
    "interval_lookup",
    """WITH d AS (SELECT DISTINCT date FROM daily_rate), h AS (SELECT d.date, arg_min(event_key, pre_start) AS event_key FROM d JOIN events_dim ON date BETWEEN pre_start AND post_end GROUP BY 1)
      SELECT d.date, h.event_key FROM d LEFT JOIN h USING (date)""",
)
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.interval_lookup(view(spark, sf_dir, "daily_rate").select("date").distinct(), view(spark, sf_dir, "events_dim"), "date", "pre_start", "post_end", "event_key")


@query(
    "anchor_in_interval",
    "SELECT event_key, max(date) AS anchor_date, arg_max(rate, date) AS anchor_value FROM daily_rate JOIN events_dim ON date BETWEEN acute_start AND acute_end GROUP BY 1",
)
def anchor_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_in_interval(view(spark, sf_dir, "daily_rate"), view(spark, sf_dir, "events_dim"), "date", "acute_start", "acute_end", "event_key", "rate")


@query(
    "event_time_index",
    """WITH t AS (SELECT series_id, event_key, round_even((date - acute_peak) / 7.0, 0)::INT AS rel, deposits FROM weekly_panel JOIN events_dim ON date BETWEEN pre_start AND post_end),
      b AS (SELECT *, avg(deposits) FILTER (rel BETWEEN -12 AND -1) OVER (PARTITION BY series_id, event_key) AS base FROM t)
      SELECT series_id, event_key, rel, round(100 * deposits / nullif(base, 0), 6) AS deposits_index FROM b""",
)
def event_time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = ev.event_time(view(spark, sf_dir, "weekly_panel"), view(spark, sf_dir, "events_dim"), "week")
    made = ev.rebase(timed, ["series_id", "event_key"], "deposits", F.col("rel").between(-12, -1))
    return rounded(made.select("series_id", "event_key", "rel", "deposits_index"))


@query(
    "event_time_deviation",
    """WITH t AS (SELECT series_id, event_key, date, (year(date) - year(acute_peak)) * 12 + month(date) - month(acute_peak) AS month, (date - acute_peak)::INT AS day, deposits FROM weekly_panel JOIN events_dim ON date BETWEEN pre_start AND post_end),
      b AS (SELECT *, avg(deposits) FILTER (month BETWEEN -6 AND -1) OVER (PARTITION BY series_id, event_key) AS base FROM t)
      SELECT series_id, event_key, month::INT AS month, day, round(deposits - base, 12) AS deposits_deviation FROM b""",
)
def event_time_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, events = view(spark, sf_dir, "weekly_panel"), view(spark, sf_dir, "events_dim")
    timed = ev.event_time(panel, events, "month").withColumn("day", F.datediff("date", "acute_peak"))
    made = ev.rebase(timed.withColumnRenamed("rel", "month"), ["series_id", "event_key"], "deposits", F.col("month").between(-6, -1), "deviation")
    return rounded(made.select("series_id", "event_key", F.col("month").cast("int").alias("month"), "day", "deposits_deviation"), 12)


# Days before the acute start that make the baseline, and days by which the acute window widens at both ends.
_VARIANTS = "(VALUES ('baseline', 360, 0), ('short baseline', 180, 0), ('plus 2 weeks', 360, 14), ('minus 2 weeks', 360, -14), ('plus 4 weeks', 360, 28), ('minus 4 weeks', 360, -28)) AS v(variant, baseline_days, widen_days)"


@query(
    "sensitivity_grid",
    f"""WITH {_PANEL}, g AS (SELECT event_key, variant, acute_start, acute_start - baseline_days AS bs, acute_start - 1 AS be, acute_start - widen_days AS ws, acute_end + widen_days AS we FROM events_dim, {_VARIANTS}),
      j AS (SELECT series_id, event_key, variant, acute_start, date, lending, rr, date BETWEEN bs AND be AS pre, date BETWEEN ws AND we AS ac FROM pz JOIN g ON date BETWEEN least(bs, ws) AND greatest(be, we)),
      b AS (SELECT series_id, event_key, variant, avg(lending) FILTER (pre) AS pre_level, avg(rr) FILTER (pre) AS pre_rate, max(lending) FILTER (ac) AS acute_level, max(rr) FILTER (ac) AS acute_rate, max(date) FILTER (pre) AS last_pre FROM j GROUP BY 1,2,3),
      lr AS (SELECT b.series_id, b.event_key, b.variant, rr AS last_rate FROM b JOIN pz p ON p.series_id = b.series_id AND p.date = b.last_pre),
      d AS (SELECT j.series_id, j.event_key, j.variant, min(date) FILTER (ac AND lending = acute_level) - first(acute_start) AS days_to_peak, min(date) FILTER (ac AND rr > last_rate) - first(acute_start) AS days_to_rise
        FROM j JOIN b USING (series_id, event_key, variant) LEFT JOIN lr USING (series_id, event_key, variant) GROUP BY 1,2,3)
      SELECT series_id, event_key, variant, round(pre_level, 6) AS pre_level, round(pre_rate, 6) AS pre_rate, round(acute_level, 6) AS acute_level, round(acute_rate, 6) AS acute_rate, round(acute_level / nullif(pre_level, 0), 6) AS scale_ratio,
        round(acute_rate - pre_rate, 6) AS rate_change, days_to_peak, days_to_rise FROM b JOIN d USING (series_id, event_key, variant)""",
)
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spark.sql(f"SELECT * FROM {_VARIANTS}")
    made = rounded(ev.sensitivity(_panel(spark, sf_dir), view(spark, sf_dir, "events_dim"), variants, KEYS, "lending", "rr"))
    return made.withColumns({c: F.col(c).cast("long") for c in ("days_to_peak", "days_to_rise")})


# ---- concentration, shares, lead and lag ------------------------------------------------------


def _concentration_sql(source: str, group: str, keep: str) -> str:
    return f"""WITH s AS (SELECT {group}, counterparty, sum(total_amount) AS x FROM {source} GROUP BY ALL), p AS (SELECT * FROM s WHERE {keep}),
      r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY x DESC, counterparty) AS d, row_number() OVER (PARTITION BY {group} ORDER BY x, counterparty DESC) AS u FROM p)
      SELECT {group}, count(*) AS n_parties, round(sum(x), 2) AS total, round(100*sum(x) FILTER (d <= 1)/nullif(sum(x), 0), 6) AS top1_share, round(100*sum(x) FILTER (d <= 5)/nullif(sum(x), 0), 6) AS top5_share,
        round(100*sum(x) FILTER (d <= 10)/nullif(sum(x), 0), 6) AS top10_share, round(10000*sum(x*x)/nullif(sum(x)*sum(x), 0), 6) AS hhi,
        round((2*sum(u*x)-(count(*)+1)*sum(x))/nullif(count(*)*sum(x), 0), 6) AS gini FROM r GROUP BY {group}"""


def _money(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return rounded(df.withColumns({n: F.round(n, digits) for n in names}))


_IN_EVENTS = "(SELECT l.*, event_key FROM ledger l JOIN events_dim ON date BETWEEN acute_start AND acute_end)"


def _event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.window_join(view(spark, sf_dir, "ledger"), view(spark, sf_dir, "events_dim"), "date", F.col("acute_start"), F.col("acute_end"))


@query("event_ledger_concentration", _concentration_sql(_IN_EVENTS, "event_key", "x > 0"))
def event_ledger_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(ag.concentration(_event_ledger(spark, sf_dir), ["event_key"], "counterparty", "total_amount"), "total")


_PHASED = """(SELECT l.*, event_key, unnest(CASE WHEN date < acute_peak THEN ['full', 'before'] ELSE ['full', 'after'] END) AS part FROM ledger l JOIN events_dim ON date BETWEEN acute_start AND acute_end)"""


@query("concentration_by_phase", _concentration_sql(_PHASED, "event_key, part", "x IS NOT NULL"))
def concentration_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.when(F.col("date") < F.col("acute_peak"), F.array(F.lit("full"), F.lit("before"))).otherwise(F.array(F.lit("full"), F.lit("after")))
    phased = _event_ledger(spark, sf_dir).withColumn("part", F.explode(parts))
    return _money(ag.concentration(phased, ["event_key", "part"], "counterparty", "total_amount", positive_only=False), "total")


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(
    "category_shares",
    f"SELECT event_key, {', '.join(f'''round(100*coalesce(sum(total_amount) FILTER (category='{r}'), 0)/nullif(sum(total_amount), 0), 6) AS share_{r.lower().replace(' ', '_')}''' for r in REGIONS)} FROM {_IN_EVENTS} GROUP BY 1",
)
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.category_share(_event_ledger(spark, sf_dir), ["event_key"], "category", "total_amount", REGIONS))


@query("rejection_ratio", f"SELECT event_key, category, round(sum(value_rejected)/nullif(sum(value_brought), 0), 6) AS ratio FROM {_IN_EVENTS} GROUP BY 1,2")
def rejection_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.ratio_of_sums(_event_ledger(spark, sf_dir), ["event_key", "category"], "value_rejected", "value_brought"))


@query(
    "lead_lag",
    f"""WITH e AS {_IN_EVENTS}, w AS (SELECT event_key, category, date_trunc('week', date)::DATE + 6 AS week, count(*) AS c FROM e GROUP BY ALL),
      k AS (SELECT event_key, category, week, row_number() OVER (PARTITION BY event_key, category ORDER BY c DESC, week) AS k FROM w),
      d AS (SELECT event_key, category, count(*) AS n, min(date) AS first_date, quantile_cont(date - DATE '1970-01-01', 0.5) AS m FROM e GROUP BY 1,2)
      SELECT event_key, category, n, first_date, DATE '1970-01-01' + floor(m)::INT AS median_date, week AS peak_week, (first_date - min(first_date) OVER (PARTITION BY event_key))::INT AS lag_days,
        row_number() OVER (PARTITION BY event_key ORDER BY n < 3, m, category) = 1 AND n >= 3 AS leads FROM d JOIN k USING (event_key, category) WHERE k = 1""",
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.lead_lag(_event_ledger(spark, sf_dir), ["event_key"], "category", "date")


@query("amount_quantiles", "SELECT category, round(quantile_cont(total_amount, 0.1), 4) AS q10, round(quantile_cont(total_amount, 0.5), 4) AS q50, round(quantile_cont(total_amount, 0.95), 4) AS q95 FROM ledger GROUP BY 1")
def amount_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.quantiles(view(spark, sf_dir, "ledger"), ["category"], "total_amount", [0.1, 0.5, 0.95]), 4)


@query(
    "party_profile",
    """WITH m AS (SELECT counterparty, r, row_number() OVER (PARTITION BY counterparty ORDER BY count(*) DESC, r) AS k FROM (SELECT counterparty, round(rate, 0)::INT AS r FROM ledger) GROUP BY 1,2)
      SELECT l.counterparty, count(*) AS n, count(DISTINCT date) AS dates, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, first(m.r) AS usual_rate, round(avg((round(rate, 0) > 5)::INT::DOUBLE), 9) AS share_high
      FROM ledger l JOIN m ON m.counterparty = l.counterparty AND m.k = 1 GROUP BY 1""",
)
def party_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = view(spark, sf_dir, "ledger").withColumn("r", F.round("rate", 0).cast("int"))
    return led.groupBy("counterparty").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("dates"), ag.distinct_sorted("category").alias("categories"), F.mode("r", True).alias("usual_rate"), F.round(ag.share_where(F.col("r") > 5), 9).alias("share_high")
    )


ROLES = ("ASIA", "EUROPE")


@query(
    "channel_score",
    f"""WITH e AS (SELECT l.*, event_key, acute_peak FROM ledger l JOIN events_dim ON date BETWEEN acute_start AND acute_end),
      f AS (SELECT event_key, counterparty, max((date < acute_peak)::INT::DOUBLE) AS early, sum(total_amount) AS total, count(*) AS n FROM e GROUP BY 1,2), c AS (SELECT event_key, quantile_cont(total_amount, 0.75) AS cut FROM e GROUP BY 1),
      p AS (SELECT counterparty, max(early) AS early, sum(n) AS n, count(*) AS events, max((total > cut)::INT::DOUBLE) AS scale, sum(total) AS total FROM f JOIN c USING (event_key) GROUP BY 1),
      u AS (SELECT counterparty, category, row_number() OVER (PARTITION BY counterparty ORDER BY count(*) DESC, category) AS k FROM e GROUP BY 1,2),
      s AS (SELECT p.counterparty, early, n::DOUBLE / max(n) OVER () AS recurrence, coalesce((events - 1)::DOUBLE / nullif((SELECT count(DISTINCT event_key) FROM e) - 1, 0), 0) AS cross_event, scale, (category IN {ROLES})::INT::DOUBLE AS role,
        total / max(total) OVER () AS centrality FROM p JOIN u ON u.counterparty = p.counterparty AND k = 1)
      SELECT counterparty, round(early, 6) AS early, round(recurrence, 6) AS recurrence, round(cross_event, 6) AS cross_event, round(scale, 6) AS scale, round(role, 6) AS role, round(centrality, 6) AS centrality,
        round(0.2*early + 0.15*recurrence + 0.15*cross_event + 0.15*scale + 0.15*role + 0.2*centrality, 6) AS score FROM s""",
)
def channel_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.channel_score(_event_ledger(spark, sf_dir), "event_key", "counterparty", "total_amount", "date", "acute_peak", "category", ROLES))


@query(
    "scorecard",
    f"""WITH {_TAGGED}, b AS (SELECT series_id, event_key, avg(lending) FILTER (phase='pre') AS p, max(lending) FILTER (phase='acute') AS a, avg(reserve) FILTER (phase='pre') AS rp, min(reserve) FILTER (phase='acute') AS ra FROM tg GROUP BY 1,2),
      c AS (SELECT series_id, event_key, a/nullif(p,0) AS scale_ratio, 100*(rp-ra)/nullif(rp,0) AS loss FROM b),
      s AS (SELECT *, CASE WHEN scale_ratio IS NULL THEN NULL WHEN scale_ratio >= 2 THEN 2 WHEN scale_ratio >= 1.5 THEN 1 ELSE 0 END AS scale, CASE WHEN loss IS NULL THEN NULL WHEN loss <= 20 THEN 2 WHEN loss <= 40 THEN 1 ELSE 0 END AS cushion FROM c)
      SELECT series_id, event_key, scale, cushion, scale + cushion AS score FROM s""",
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ev.event_metrics(_panel(spark, sf_dir), view(spark, sf_dir, "events_dim"), KEYS, "lending", "reserve", "rr", "size")
    made = ag.scorecard(metrics, [("scale", "scale_ratio", 2.0, 1.5, True), ("cushion", "stock_loss_pct", 20.0, 40.0, False)])
    return made.select("series_id", "event_key", "scale", "cushion", "score")


@query(
    "series_summary",
    """WITH h AS (SELECT series_id, date, deposits AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS b FROM weekly_panel WHERE deposits IS NOT NULL)
      SELECT series_id, count(*) AS n, min(date) AS start, max(date) AS stop, round(avg((v<>0)::INT::DOUBLE), 6) AS nonzero, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max,
        round(arg_min(v, date), 6) AS first, round(arg_max(v, date), 6) AS last, round(regr_slope(v, i::DOUBLE), 6) AS slope, round(stddev_samp(v)/nullif(avg(v), 0), 6) AS cv, round(avg(v) FILTER (b <= 12), 6) AS last12,
        round(avg(v) FILTER (b > 12), 6) AS earlier, avg(v) FILTER (b <= 12) < avg(v) FILTER (b > 12) AS declines FROM h GROUP BY 1""",
)
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.series_summary(view(spark, sf_dir, "weekly_panel"), KEYS, "date", "deposits"))


@query(
    "load_summary",
    "SELECT category, count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT counterparty) AS parties, round(sum(total_amount), 2) AS total, min(date) AS first, max(date) AS last FROM ledger GROUP BY 1",
)
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(ag.load_summary(view(spark, sf_dir, "ledger"), "category", "date", "counterparty", "total_amount"), "total")


@query("crosstab", f"SELECT event_key, {', '.join(f'''count(*) FILTER (category='{r}') AS \"n_{r.lower()}\"''' for r in REGIONS)} FROM {_IN_EVENTS} GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.crosstab(_event_ledger(spark, sf_dir), ["event_key"], "category", REGIONS)


@query(
    "topn_profile",
    f"""WITH t AS (SELECT event_key, counterparty, sum(total_amount) AS x, avg(rate) AS r FROM {_IN_EVENTS} GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY x DESC, counterparty) AS k, sum(x) OVER (PARTITION BY event_key) AS tot FROM t)
      SELECT event_key, top, count(*) AS n, round(100*sum(x)/nullif(first(tot), 0), 6) AS share, round(avg((round(r, 6) > 5)::INT::DOUBLE), 6) AS flag_share FROM k, (VALUES (10), (20), (30)) v(top) WHERE k <= top GROUP BY 1,2""",
)
def topn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _event_ledger(spark, sf_dir).groupBy("event_key", "counterparty").agg(F.sum("total_amount").alias("x"), F.avg("rate").alias("r"))
    return rounded(ag.topn_profile(totals, ["event_key"], "x", F.round("r", 6) > 5, (10, 20, 30)))


@query(
    "appearance_matrix",
    f"SELECT counterparty, {', '.join(f'''max((event_key='{e}')::INT) AS in_{e.lower()}''' for e in ('E1', 'E2', 'E3', 'E4'))}, count(DISTINCT event_key)::INT AS index FROM {_IN_EVENTS} GROUP BY 1",
)
def appearance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ag.appearance_matrix(_event_ledger(spark, sf_dir), "counterparty", "event_key", ("E1", "E2", "E3", "E4"))
    return ag.criteria_index(made, ["in_e1", "in_e2", "in_e3", "in_e4"])


@query(
    "pre_event_return",
    """WITH d AS (SELECT series_id, date, deposits AS v, (deposits < lag(deposits) OVER (PARTITION BY series_id ORDER BY date))::INT::DOUBLE AS fell FROM weekly_panel),
      h AS (SELECT series_id, event_key, date, v, fell FROM d JOIN events_dim ON date BETWEEN acute_start - 180 AND acute_start - 1 WHERE v IS NOT NULL),
      a AS (SELECT series_id, event_key, arg_min(v, date) AS first, arg_max(v, date) AS last, count(*) AS n, avg(fell) AS mean_declining FROM h GROUP BY 1,2), r AS (SELECT *, 100*(last/nullif(first, 0)-1) AS return_pct FROM a)
      SELECT series_id, event_key, round(first, 6) AS first, round(last, 6) AS last, n, round(mean_declining, 6) AS mean_declining, round(return_pct, 6) AS return_pct, CASE WHEN return_pct IS NULL THEN 'no data' WHEN return_pct <= -5 THEN 'fell before' WHEN return_pct >= 5 THEN 'rose before' ELSE 'flat' END AS verdict FROM r""",
)
def pre_event_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "weekly_panel").withColumn("fell", (ts.diff("deposits", KEYS, "date") < 0).cast("double"))
    return rounded(ag.pre_event_return(panel, view(spark, sf_dir, "events_dim"), KEYS, "date", "deposits", 180, "fell"))


@query(
    "grouped_medians",
    """SELECT category, y, round(quantile_cont(rate, 0.5), 6) AS median, round(avg(rate), 6) AS mean, count(rate) AS n FROM (SELECT *, year(date)::INT AS y FROM ledger) GROUP BY GROUPING SETS ((category), (y), (category, y), ())""",
)
def grouped_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.grouped_medians(view(spark, sf_dir, "ledger").withColumn("y", F.year("date")), [["category"], ["y"], ["category", "y"], []], "rate"))


@query("annual_counts", "SELECT country, (year // 2)::INT AS year, round(sum(gdp), 2) AS gdp FROM annual_panel GROUP BY 1,2")
def annual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = view(spark, sf_dir, "annual_panel").withColumn("year", F.floor(F.col("year") / 2).cast("int"))
    return _money(ag.rollup_period(halves, ["country"], "year", "gdp"), "gdp")


# ---- time series --------------------------------------------------------------------------


@query(
    "lag_features",
    """SELECT series_id, date, round(deposits - lag(deposits, 4) OVER w, 8) AS diff4, round(deposits / nullif(lag(deposits, 4) OVER w, 0) - 1, 8) AS pct4, round(lag(deposits, 1) OVER w - lag(deposits, 5) OVER w, 8) AS diff4_late,
      round(lag(deposits, 1) OVER w, 8) AS level_late FROM weekly_panel WINDOW w AS (PARTITION BY series_id ORDER BY date)""",
)
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "weekly_panel")
    return rounded(panel.select(
        "series_id", "date", ts.diff("deposits", KEYS, "date", 4).alias("diff4"), ts.pct_change("deposits", KEYS, "date", 4).alias("pct4"),
        ts.diff("deposits", KEYS, "date", 4, delay=1).alias("diff4_late"), ts.level("deposits", KEYS, "date").alias("level_late"),
    ), 8)


@query(
    "past_z",
    """SELECT series_id, date, round(CASE WHEN count(deposits) OVER w >= 52 THEN (deposits - avg(deposits) OVER w) / nullif(stddev_samp(deposits) OVER w, 0) END, 6) AS z,
      round(CASE WHEN count(deposits) OVER r >= 26 THEN avg(deposits) OVER r END, 13) AS mean52,
      round(CASE WHEN count(deposits) OVER s >= 5 THEN (deposits - avg(deposits) OVER s) / nullif(stddev_pop(deposits) OVER s, 0) END, 6) AS seasonal_z FROM weekly_panel
      WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING),
        s AS (PARTITION BY series_id, month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def past_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "weekly_panel")
    return rounded(panel.select(
        "series_id", "date", F.round(ts.past_z("deposits", KEYS, "date"), 6).alias("z"), F.round(ts.past_mean("deposits", KEYS, "date"), 13).alias("mean52"), F.round(ts.past_seasonal_z("deposits", KEYS, "date"), 6).alias("seasonal_z")
    ), 13)


@query(
    "past_pct_rank",
    """WITH n AS (SELECT series_id, date, deposits, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly_panel)
      SELECT a.series_id, a.date, round(CASE WHEN a.i > 52 AND count(b.deposits) >= 52 AND a.deposits IS NOT NULL THEN 100.0 * count(*) FILTER (b.deposits <= a.deposits) / count(b.deposits) END, 6) AS pct_rank
      FROM n a LEFT JOIN n b ON a.series_id = b.series_id AND b.i < a.i GROUP BY a.series_id, a.date, a.i, a.deposits""",
)
def past_pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.past_pct_rank(view(spark, sf_dir, "weekly_panel").select("series_id", "date", "deposits"), "deposits", KEYS, "date").drop("deposits"))


@query(
    "robust_z",
    """WITH m AS (SELECT *, CASE WHEN count(deposits) OVER w >= 26 THEN quantile_cont(deposits, 0.5) OVER w END AS med FROM weekly_panel WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
      d AS (SELECT *, abs(deposits - med) AS dev FROM m)
      SELECT series_id, date, round((deposits - med) / nullif(1.4826 * CASE WHEN count(dev) OVER w >= 26 THEN quantile_cont(dev, 0.5) OVER w END, 0), 6) AS robust_z FROM d WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)""",
)
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.robust_z(view(spark, sf_dir, "weekly_panel"), "deposits", KEYS, "date").select("series_id", "date", "robust_z"))


@query(
    "persistence_alerts",
    """WITH f AS (SELECT series_id, date, coalesce(deposits > lag(deposits) OVER (PARTITION BY series_id ORDER BY date), false) AS flag FROM weekly_panel)
      SELECT series_id, date, flag, count(*) OVER w = 4 AND sum(flag::INT) OVER w >= 3 AS alert FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def persistence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = view(spark, sf_dir, "weekly_panel").select("series_id", "date", F.coalesce(ts.diff("deposits", KEYS, "date") > 0, F.lit(False)).alias("flag"))
    return flagged.withColumn("alert", ts.persistence("flag", KEYS, "date", 3, 4))


@query(
    "ewma_alerts",
    """WITH RECURSIVE n AS (SELECT series_id, date, deposits AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly_panel),
      e AS (SELECT series_id, date, x, i, x AS ewma FROM n WHERE i = 1 UNION ALL SELECT n.series_id, n.date, n.x, n.i, CASE WHEN n.x IS NULL THEN e.ewma WHEN e.ewma IS NULL THEN n.x ELSE 0.2 * n.x + 0.8 * e.ewma END FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)
      SELECT series_id, date, round(ewma, 6) AS ewma, coalesce(count(ewma) OVER w >= 52 AND ewma > avg(ewma) OVER w + 2 * stddev_samp(ewma) OVER w, false) AS alert FROM e
      WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def ewma_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ru.ewma_rule(view(spark, sf_dir, "weekly_panel"), KEYS, "date", "deposits").select("series_id", "date", "ewma", "alert"))


@query(
    "cusum_alerts",
    """WITH RECURSIVE z AS (SELECT series_id, date, round(CASE WHEN count(deposits) OVER w >= 52 THEN (deposits - avg(deposits) OVER w) / nullif(stddev_samp(deposits) OVER w, 0) END, 6) AS z,
        row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM weekly_panel WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      c AS (SELECT series_id, date, i, z, 0.0::DOUBLE AS s, false AS alert FROM z WHERE i = 0 UNION ALL SELECT series_id, date, i, z, CASE WHEN z IS NULL OR greatest(0, z - 0.5) >= 3 THEN 0 ELSE greatest(0, z - 0.5) END, coalesce(greatest(0, z - 0.5) >= 3, false) AND z IS NOT NULL FROM z WHERE i = 1
        UNION ALL SELECT z.series_id, z.date, z.i, z.z, CASE WHEN z.z IS NULL OR greatest(0, c.s + z.z - 0.5) >= 3 THEN 0 ELSE greatest(0, c.s + z.z - 0.5) END, z.z IS NOT NULL AND greatest(0, c.s + z.z - 0.5) >= 3 FROM c JOIN z ON z.series_id = c.series_id AND z.i = c.i + 1)
      SELECT series_id, date, z, alert::INT::DOUBLE AS alert FROM c""",
)
def cusum_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rounded(view(spark, sf_dir, "weekly_panel").select("series_id", "date", ts.past_z("deposits", KEYS, "date").alias("z")))
    return ts.cusum(scored, KEYS, "date", "z", 0.5, 3.0).select("series_id", "date", "z", "alert")


@query(
    "drawdown",
    """WITH r AS (SELECT series_id, date, deposits, deposits / nullif(lag(deposits) OVER w, 0) - 1 AS r FROM weekly_panel WINDOW w AS (PARTITION BY series_id ORDER BY date)),
      c AS (SELECT *, exp(sum(ln(1 + coalesce(CASE WHEN r BETWEEN -0.8 AND 2 THEN r END, 0))) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)) * 100 AS idx FROM r)
      SELECT series_id, date, round(r, 6) AS r, round(idx, 4) AS idx, round(idx / max(idx) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS dd FROM c""",
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = view(spark, sf_dir, "weekly_panel").select("series_id", "date", ts.simple_return("deposits", KEYS, "date").alias("r"))
    indexed = priced.withColumn("idx", ts.cum_index(fc.null_outside(F.col("r"), -0.8, 2.0), KEYS, "date"))
    made = indexed.withColumn("dd", ts.drawdown("idx", KEYS, "date"))
    return rounded(made.withColumn("idx", F.round("idx", 4)))


@query(
    "fill_and_steps",
    """WITH s AS (SELECT date, rate, lag(rate) OVER (ORDER BY date) AS b FROM daily_rate) SELECT date, rate, coalesce(rate <> b, false) AS step, min(rate) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low_ahead,
      (date - lag(date) OVER (ORDER BY date))::INT AS gap, last_value(CASE WHEN rate <> b THEN rate END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS last_change FROM s""",
)
def fill_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = view(spark, sf_dir, "daily_rate")
    made = rate.select("date", "rate", ts.step_change("rate", [], "date").alias("step"), ts.suffix_min("rate", [], "date").alias("low_ahead"), ts.gap_days([], "date").alias("gap"))
    return made.withColumn("last_change", ts.ffill(F.when(F.col("step"), F.col("rate")), [], "date"))


@query(
    "yoy",
    """SELECT a.country, a.year, round(a.gdp / nullif(b.gdp, 0) - 1, 6) AS gdp_yoy, round(a.stir - b.stir, 4) AS stir_diff FROM annual_panel a LEFT JOIN annual_panel b ON a.country = b.country AND b.year = a.year - 1""",
)
def yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ts.yoy(view(spark, sf_dir, "annual_panel"), ["country"], "year", ["gdp"], ["stir"]).select("country", "year", "gdp_yoy", F.round("stir_diff", 4).alias("stir_diff"))
    return rounded(made)


@query(
    "weekly_resample",
    """WITH w AS (SELECT category, date_trunc('week', date)::DATE + 6 AS week, count(*) AS n, sum(total_amount) AS total FROM ledger WHERE rate > 9 GROUP BY ALL), b AS (SELECT category, min(week) AS lo, max(week) AS hi FROM w GROUP BY 1),
      s AS (SELECT category, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS week FROM b) SELECT category, week, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM s LEFT JOIN w USING (category, week)""",
)
def weekly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ts.resample_week(view(spark, sf_dir, "ledger").filter("rate > 9"), ["category"], "date", {"n": F.count("*"), "total": F.sum("total_amount")})
    return _money(made, "total", digits=4)


@query("monthly_resample", "SELECT category, strftime(date, '%Y-%m') AS month, count(*) AS n, round(sum(total_amount), 4) AS total FROM ledger GROUP BY ALL")
def monthly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(ts.resample_month(view(spark, sf_dir, "ledger"), ["category"], "date", {"n": F.count("*"), "total": F.sum("total_amount")}), "total", digits=4)


@query(
    "top_parties",
    """WITH t AS (SELECT category, counterparty, round(sum(total_amount), 4) AS total FROM ledger GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC) AS place FROM t) SELECT category, counterparty, total, place::INT AS place FROM k WHERE place <= 5""",
)
def top_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = view(spark, sf_dir, "ledger").groupBy("category", "counterparty").agg(F.round(F.sum("total_amount"), 4).alias("total"))
    return ts.top_k(totals, F.col("total").desc(), 5, ["category"])


# ---- rules ----------------------------------------------------------------------------------

def _past_z_sql(x: str, w: str, least: int, spread: str) -> str:
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN ({x} - avg({x}) OVER {w}) / nullif({spread}({x}) OVER {w}, 0) END"


def _mean_sql(*parts: str) -> str:
    return f"round(({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({' + '.join(f'({p} IS NOT NULL)::INT' for p in parts)}, 0), 9)"


def _rank_sql(x: str) -> str:
    return f"CASE WHEN a.i > 52 AND count(b.{x}) >= 52 AND a.{x} IS NOT NULL THEN 100.0 * count(*) FILTER (b.{x} <= a.{x}) / count(b.{x}) END"


#: The stress index of the panel: past scores of deposits and (negative) reserves and their changes over 8 weeks; and by season.
_INDEX = f"""zs AS (SELECT series_id, date, {_past_z_sql('deposits', 'w', 52, 'stddev_samp')} AS dz, -({_past_z_sql('reserve', 'w', 52, 'stddev_samp')}) AS rz, deposits / nullif(lag(deposits, 8) OVER o, 0) - 1 AS dp, -(reserve / nullif(lag(reserve, 8) OVER o, 0) - 1) AS rp,
    {_past_z_sql('deposits', 's', 5, 'stddev_pop')} AS sdz, -({_past_z_sql('reserve', 's', 5, 'stddev_pop')}) AS srz FROM weekly_panel WINDOW o AS (PARTITION BY series_id ORDER BY date),
    w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY series_id, month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ix AS (SELECT *, {_mean_sql('dz', 'rz', 'dp', 'rp')} AS idx, {_mean_sql('sdz', 'srz')} AS sidx, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM zs),
  sc AS (SELECT a.series_id, a.date, a.i, a.dz, a.rz, a.sdz, a.srz, a.idx, a.sidx, {_rank_sql('idx')} AS score, {_rank_sql('sidx')} AS sscore FROM ix a LEFT JOIN ix b ON a.series_id = b.series_id AND b.i < a.i GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY a.series_id, a.date, a.i, a.dz, a.rz, a.sdz, a.srz, a.idx, a.sidx")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = ru.build_features(view(spark, sf_dir, "weekly_panel"), KEYS, "date", [("deposits_p8", "deposits", "pct", 8), ("reserve_p8", "reserve", "pct", 8)])
    scored = ru.warning_index(feats, KEYS, "date", {"deposits": 1, "reserve": -1}, {"deposits_p8": 1, "reserve_p8": -1})
    return ru.warning_index(scored, KEYS, "date", {"deposits": 1, "reserve": -1}, seasonal=True, prefix="seasonal_")


@query(
    "warning_index",
    f"""WITH {_INDEX} SELECT series_id, date, round(dz, 6) AS deposits_z, round(rz, 6) AS reserve_z, idx AS \"index\", round(score, 6) AS score,
      round(sdz, 6) AS seasonal_deposits_z, round(srz, 6) AS seasonal_reserve_z, sidx AS seasonal_index, round(sscore, 6) AS seasonal_score FROM sc""",
)
def warning_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{p}{c}" for p in ("", "seasonal_") for c in ("deposits_z", "reserve_z", "index", "score")]
    made = _scored(spark, sf_dir).select("series_id", "date", *[c if c.endswith("index") else F.round(c, 6).alias(c) for c in names])
    return rounded(made, 9)


def _persistence_sql(rule: str, score: str, k: int, n: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT series_id, date, '{rule}' AS rule, count(*) OVER {frame} = {n} AND sum(coalesce({score} >= 80, false)::INT) OVER {frame} >= {k} AS alert FROM sc"


def _ewma_sql(rule: str, x: str) -> str:
    return f"SELECT series_id, date, '{rule}', coalesce(count({x}) OVER w >= 52 AND {x} > avg({x}) OVER w + 2 * stddev_samp({x}) OVER w, false) FROM fo WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


_SMOOTH = "CASE WHEN n.idx IS NULL THEN fo.{e} WHEN fo.{e} IS NULL THEN n.idx ELSE {a} * n.idx + {b} * fo.{e} END"
_SUM = "greatest(0, fo.{c} + n.cz - {k})"
_ALERTS = f"""{_INDEX}, cz AS (SELECT *, {_past_z_sql('idx', 'w', 52, 'stddev_samp')} AS cz FROM sc WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  fo AS (SELECT series_id, date, i, idx AS e2, idx AS e1, 0.0::DOUBLE AS c5, 0.0::DOUBLE AS c4, false AS f5, false AS f4 FROM cz WHERE i = 1
    UNION ALL SELECT n.series_id, n.date, n.i, {_SMOOTH.format(e='e2', a=0.2, b=0.8)}, {_SMOOTH.format(e='e1', a=0.1, b=0.9)}, CASE WHEN n.cz IS NULL OR {_SUM.format(c='c5', k=0.5)} >= 5 THEN 0 ELSE {_SUM.format(c='c5', k=0.5)} END,
      CASE WHEN n.cz IS NULL OR {_SUM.format(c='c4', k=0.25)} >= 4 THEN 0 ELSE {_SUM.format(c='c4', k=0.25)} END, n.cz IS NOT NULL AND {_SUM.format(c='c5', k=0.5)} >= 5, n.cz IS NOT NULL AND {_SUM.format(c='c4', k=0.25)} >= 4
    FROM fo JOIN cz n ON n.series_id = fo.series_id AND n.i = fo.i + 1),
  al AS ({' UNION ALL '.join([*[f"SELECT series_id, date, 'threshold_score>={t}' AS rule, coalesce(score >= {t}, false) AS alert FROM sc" for t in (80, 90, 95)], _persistence_sql('persistence_2of4_80', 'score', 2, 4), _persistence_sql('persistence_3of6_80', 'score', 3, 6),
    _persistence_sql('persistence_6of12_80', 'score', 6, 12), _ewma_sql('ewma_lam=0.2_2sigma', 'e2'), _ewma_sql('ewma_lam=0.1_2sigma', 'e1'), "SELECT series_id, date, 'cusum_k=0.5_h=5', f5 FROM fo", "SELECT series_id, date, 'cusum_k=0.25_h=4', f4 FROM fo",
    "SELECT series_id, date, 'threshold_seasonal>=80', coalesce(sscore >= 80, false) FROM sc", _persistence_sql('persistence_3of6_seasonal_80', 'sscore', 3, 6)])})"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all twelve rules, written once for the evaluations that read them several times."""
    return materialize(ru.menu_alerts(_scored(spark, sf_dir), KEYS, "date"), "rule-alerts")


@query(
    "rule_evaluation",
    f"""WITH RECURSIVE {_ALERTS}, lb AS (SELECT al.*, h AS horizon, EXISTS (SELECT 1 FROM events_dim WHERE acute_peak > date AND acute_peak <= date + 7*h) AS y FROM al, (VALUES (4), (8), (12)) v(h)),
      c AS (SELECT rule, horizon, count(*) FILTER (alert AND y) AS tp, count(*) FILTER (alert AND NOT y) AS fp, count(*) FILTER (NOT alert AND y) AS fn, count(*) FILTER (NOT alert AND NOT y) AS tn FROM lb GROUP BY 1,2)
      SELECT rule, horizon, tp, fp, fn, tn, round(tp::DOUBLE/nullif(tp+fp, 0), 6) AS precision, round(tp::DOUBLE/nullif(tp+fn, 0), 6) AS recall, round(2.0*tp::DOUBLE/nullif(2*tp+fp+fn, 0), 6) AS f1 FROM c""",
)
def rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ru.backtest(_alerts(spark, sf_dir), view(spark, sf_dir, "events_dim"), KEYS, "date", (4, 8, 12)))


@query(
    "rule_detection",
    f"""WITH RECURSIVE {_ALERTS}, h AS (SELECT rule, event_key, acute_peak, date, alert FROM al JOIN events_dim ON date BETWEEN acute_peak - 84 AND acute_peak - 1), g AS (SELECT rule, event_key, acute_peak, count(*) FILTER (alert) AS n_alerts, min(date) FILTER (alert) AS first_alert FROM h GROUP BY 1,2,3)
      SELECT rule, event_key, n_alerts, first_alert, floor((acute_peak - first_alert) / 7.0)::INT AS lead_weeks, n_alerts > 0 AS detected FROM g""",
)
def rule_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.detection(_alerts(spark, sf_dir), view(spark, sf_dir, "events_dim"), 12, "date")


@query(
    "rule_leads",
    f"""WITH RECURSIVE {_ALERTS}, h AS (SELECT rule, event_key, acute_peak, date, alert, h AS horizon FROM al, (VALUES (4), (8), (12)) v(h), events_dim WHERE date BETWEEN acute_peak - 7*h AND acute_peak - 1),
      g AS (SELECT rule, horizon, event_key, floor((first(acute_peak) - min(date) FILTER (alert)) / 7.0) AS lead, count(*) FILTER (alert) > 0 AS detected FROM h GROUP BY 1,2,3)
      SELECT rule, horizon, count(*) AS events, count(*) FILTER (detected) AS detected, quantile_cont(lead, 0.5)::DOUBLE AS median_lead FROM g GROUP BY 1,2""",
)
def rule_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, events = _alerts(spark, sf_dir), view(spark, sf_dir, "events_dim")
    parts = [ru.lead_summary(ru.detection(alerts, events, h, "date")).withColumn("horizon", F.lit(h)) for h in (4, 8, 12)]
    return reduce(DataFrame.unionByName, parts)


@query(
    "false_alarm_rate",
    f"""WITH RECURSIVE {_ALERTS} SELECT rule, count(*) AS weeks, round(520*avg(alert::INT::DOUBLE), 6) AS per_decade, round(52*avg(alert::INT::DOUBLE), 6) AS per_year FROM al WHERE NOT EXISTS (SELECT 1 FROM events_dim WHERE date BETWEEN acute_peak - 365 AND acute_peak + 365) GROUP BY 1""",
)
def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ru.quiet_rate(_alerts(spark, sf_dir), view(spark, sf_dir, "events_dim"), "date"))


_SPAN_SQL = ", ".join(f"max(score) FILTER (date >= acute_peak - {7 * w}) AS m{w}, min(date) FILTER (score >= 80 AND date >= acute_peak - {7 * w}) AS f{w}" for w in ru.SPANS)
_SPAN_OUT = ", ".join(f"round(m{w}, 6) AS max_score_{w}w, f{w} AS first_high_{w}w, floor((acute_peak - f{w}) / 7.0)::INT AS weeks_before_{w}w" for w in ru.SPANS)


@query(
    "warning_summary",
    f"""WITH {_INDEX}, h AS (SELECT sc.*, event_key, acute_peak FROM sc JOIN events_dim ON date BETWEEN acute_peak - 84 AND acute_peak - 1), g AS (SELECT series_id, event_key, acute_peak, {_SPAN_SQL}, avg(dz) AS dz, avg(rz) AS rz FROM h GROUP BY 1,2,3),
      c AS (SELECT *, 'deposits_z=' || (round(dz, 2) + 0.0)::VARCHAR AS d, 'reserve_z=' || (round(rz, 2) + 0.0)::VARCHAR AS r FROM g)
      SELECT series_id, event_key, {_SPAN_OUT}, CASE WHEN dz IS NULL AND rz IS NULL THEN '' WHEN rz IS NULL THEN d WHEN dz IS NULL THEN r WHEN dz >= rz THEN d || ', ' || r ELSE r || ', ' || d END AS top_components FROM c""",
)
def warning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ru.warning_summary(_scored(spark, sf_dir), view(spark, sf_dir, "events_dim"), KEYS, "date", "score", ["deposits_z", "reserve_z"]))


#: Each condition of the signal by a subquery of its own, as the rules state it.
_SIGNAL = """h AS (SELECT event_key, acute_peak, date, rate FROM daily_rate JOIN events_dim ON date BETWEEN acute_peak - 300 AND acute_peak + 45 WHERE rate IS NOT NULL),
      p AS (SELECT event_key, acute_peak, (SELECT max(rate) FROM h n WHERE n.event_key = e.event_key AND n.date >= e.acute_peak - 90) AS peak_value,
              coalesce((SELECT min(rate) FROM h n WHERE n.event_key = e.event_key AND n.date <= e.acute_peak - 150), (SELECT min(rate) FROM h n WHERE n.event_key = e.event_key)) AS baseline FROM (SELECT DISTINCT event_key, acute_peak FROM h) e),
      q AS (SELECT p.*, (SELECT min(date) FROM h n WHERE n.event_key = p.event_key AND n.date >= p.acute_peak - 90 AND n.rate = p.peak_value) AS peak_date FROM p),
      c AS (SELECT h.event_key, h.date, h.rate, lag(h.rate) OVER (PARTITION BY h.event_key ORDER BY h.date) AS prior, q.baseline FROM h JOIN q USING (event_key) WHERE h.date <= q.peak_date),
      u AS (SELECT event_key, min(date) AS sustained_start FROM c WHERE rate > prior AND rate > baseline AND NOT EXISTS (SELECT 1 FROM c x WHERE x.event_key = c.event_key AND x.date >= c.date AND x.rate < c.prior - 1e-9) GROUP BY 1),
      a AS (SELECT event_key, min(date) AS run_up_start FROM c WHERE rate > prior AND NOT EXISTS (SELECT 1 FROM c x WHERE x.event_key = c.event_key AND x.date >= c.date AND x.rate < x.prior) GROUP BY 1),
      rs AS (SELECT q.event_key, sustained_start, run_up_start, baseline, peak_value, peak_date, (acute_peak - sustained_start)::INT AS sustained_lead, (acute_peak - run_up_start)::INT AS run_up_lead FROM q LEFT JOIN u USING (event_key) LEFT JOIN a USING (event_key))"""


@query("rate_signal", f"WITH {_SIGNAL} SELECT * FROM rs")
def rate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.rate_signal(view(spark, sf_dir, "daily_rate"), view(spark, sf_dir, "events_dim"))


@query("rate_clocks", f"WITH {_SIGNAL} SELECT e.event_key, origin, acute_peak, sustained_start, run_up_start, sustained_lead AS sustained_start_lead, run_up_lead AS run_up_start_lead FROM events_dim e LEFT JOIN rs USING (event_key)")
def rate_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock table fed by the signals of the rate."""
    events = view(spark, sf_dir, "events_dim")
    return chains.clock_table(events, ru.rate_signal(view(spark, sf_dir, "daily_rate"), events), ["sustained_start", "run_up_start"], "acute_peak")
