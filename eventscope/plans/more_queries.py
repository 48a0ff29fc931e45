"""Queries for scalar guards, set operations, feature tables, anomaly tables and further streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions import columns as fc
from eventscope.functions import timeseries as ts
from eventscope.operators import aggregates as ag
from eventscope.operators import entities, models, placebo, reconcile
from eventscope.operators import events as ev
from eventscope.operators import rules as ru
from eventscope.plans.corpus_queries import NAME_RULES, _event_stream, _gate, _model_rows
from eventscope.plans.fixtures import table, view
from eventscope.plans.panel_queries import KEYS, _event_ledger, _money, rounded
from eventscope.plans.registry import query
from eventscope.sources import readers
from eventscope.sources.storage import extract, scratch
from eventscope.streaming import online

_IN_EVENTS = "(SELECT l.*, event_key FROM ledger l JOIN events_dim ON date BETWEEN acute_start AND acute_end)"


@query(
    "scalar_guards",
    """SELECT series_id, date, round(CASE WHEN lending IS NULL AND reserve IS NULL THEN NULL ELSE coalesce(lending, 0) + coalesce(reserve, 0) END, 8) AS total, round(lending / nullif(deposits, 0), 6) AS ratio,
      round((coalesce(lending, 0) + coalesce(reserve, 0)) / nullif((lending IS NOT NULL)::INT + (reserve IS NOT NULL)::INT, 0), 10) AS mean2, CASE WHEN deposits IS NOT NULL THEN round(greatest(0.5, least(1.0, deposits)), 8) END AS clipped,
      round(CASE WHEN deposits BETWEEN 0.5 AND 1 THEN deposits END, 8) AS inside, lending IS NOT NULL AND reserve IS NOT NULL AS complete,
      CASE WHEN lending IS NULL AND reserve IS NULL THEN NULL WHEN reserve IS NULL OR lending >= reserve THEN 'lending' ELSE 'reserve' END AS top,
      CASE WHEN coalesce(lending, 0) > 0 AND coalesce(reserve, 0) > 0 THEN 'discount+advance' WHEN coalesce(lending, 0) > 0 THEN 'discount' WHEN coalesce(reserve, 0) > 0 THEN 'advance' ELSE 'other' END AS kind, coalesce(regexp_matches(series_id, 'B.I'), false) AS flagged, round(greatest(abs(lending), abs(reserve)), 8) AS max_abs
    FROM weekly_panel""",
)
def scalar_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lending, reserve, deposits = F.col("lending"), F.col("reserve"), F.col("deposits")
    return readers.add_ratios(view(spark, sf_dir, "weekly_panel"), {"ratio": ("lending", "deposits")}).select(
        "series_id", "date", F.round(fc.sum_nullable(lending, reserve), 8).alias("total"), F.round("ratio", 6).alias("ratio"), F.round(fc.row_mean(lending, reserve), 10).alias("mean2"),
        F.round(fc.clip(deposits, 0.5, 1.0), 8).alias("clipped"), F.round(fc.null_outside(fc.finite(deposits), 0.5, 1.0), 8).alias("inside"), fc.complete("lending", "reserve").alias("complete"),
        fc.row_argmax({"lending": lending, "reserve": reserve}).alias("top"), fc.transaction_type(lending, reserve).alias("kind"), fc.flag_contains(F.col("series_id"), "B.I").alias("flagged"),
        F.round(fc.row_max_abs(lending, reserve), 8).alias("max_abs"),
    )


@query("weekday_filters", "SELECT date, weekday(date) = 3 AS wednesday, weekday(date) <> 0 AS business, strftime(date, '%d/%m/%Y') AS text, date AS parsed, NULL::DOUBLE AS bad, round(rate, 1) AS good FROM daily_rate")
def weekday_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "daily_rate").withColumn("text", F.date_format("date", "dd/MM/yyyy"))
    return made.select(
        "date", fc.on_weekday(F.col("date"), "Wednesday").alias("wednesday"), fc.business_day(F.col("date")).alias("business"), "text", fc.to_date_lenient(F.col("text")).alias("parsed"),
        fc.to_double(F.lit("n/a")).alias("bad"), fc.to_double(F.format_number("rate", 1)).alias("good"),
    )


@query(
    "join_panels",
    "SELECT coalesce(a.date, b.date) AS date, a.n_orders, b.n_lines FROM (SELECT o_orderdate::DATE AS date, count(*) AS n_orders FROM orders GROUP BY 1) a FULL JOIN (SELECT l_shipdate::DATE AS date, count(*) AS n_lines FROM lineitem GROUP BY 1) b ON a.date = b.date",
)
def join_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n_orders"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("n_lines"))
    return reconcile.join_panels(orders, lines, ["date"])


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT counterparty FROM ledger WHERE rate > 9.5), b AS (SELECT DISTINCT counterparty FROM ledger WHERE rate < 0.5) SELECT 'union' AS op, counterparty FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', counterparty FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
      UNION ALL SELECT 'intersect', counterparty FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = view(spark, sf_dir, "ledger")
    a, b = (led.filter(c).select("counterparty").distinct() for c in ("rate > 9.5", "rate < 0.5"))
    parts = {"union": readers.union_sources(a, b).distinct(), "except": a.join(b, "counterparty", "left_anti"), "intersect": a.join(b, "counterparty", "left_semi")}
    return readers.union_sources(*[df.select(F.lit(n).alias("op"), "counterparty") for n, df in parts.items()])


@query("rows_at", "SELECT series_id, date, round(deposits, 8) AS deposits FROM weekly_panel WHERE date IN (SELECT date_trunc('week', acute_peak)::DATE FROM events_dim)")
def rows_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = view(spark, sf_dir, "events_dim").select(F.date_trunc("week", "acute_peak").cast("date").alias("date"))
    return reconcile.rows_at(view(spark, sf_dir, "weekly_panel"), dates, "date").select("series_id", "date", F.round("deposits", 8).alias("deposits"))


@query(
    "build_features",
    """SELECT series_id, date, round(lending - lag(lending, 8) OVER w, 8) AS lending_d8, round(deposits / nullif(lag(deposits, 8) OVER w, 0) - 1, 6) AS deposits_p8, round(reserve - CASE WHEN count(reserve) OVER r >= 26 THEN avg(reserve) OVER r END, 12) AS reserve_gap FROM weekly_panel
      WINDOW w AS (PARTITION BY series_id ORDER BY date), r AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)""",
)
def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ru.build_features(view(spark, sf_dir, "weekly_panel"), KEYS, "date", [("lending_d8", "lending", "diff", 8), ("deposits_p8", "deposits", "pct", 8), ("reserve_gap", "reserve", "gap", 52)])
    return made.select("series_id", "date", F.round("lending_d8", 8).alias("lending_d8"), F.round("deposits_p8", 6).alias("deposits_p8"), F.round("reserve_gap", 12).alias("reserve_gap"))


@query(
    "ledger_breadth",
    f"""WITH t AS (SELECT event_key, counterparty, sum(total_amount) AS x, count(*) AS r FROM {_IN_EVENTS} GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY x DESC NULLS LAST, counterparty) AS k FROM t)
      SELECT event_key, sum(r)::BIGINT AS rows, count(*) AS parties, count(*) FILTER (x > 0) AS positive, round(100*sum(x) FILTER (k <= 5)/nullif(sum(x), 0), 6) AS top5_share, round(10000*sum(x*x)/nullif(sum(x)*sum(x), 0), 6) AS hhi FROM k GROUP BY 1""",
)
def ledger_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.ledger_metrics(_event_ledger(spark, sf_dir), ["event_key"], "counterparty", "total_amount"))


def _segmentation_sql(end: str, party: str, category: str) -> str:
    return f"""t_{end} AS (SELECT event_key, {party} AS p, sum(x) AS x FROM s GROUP BY ALL HAVING sum(x) > 0), r_{end} AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY x DESC, p) AS k FROM t_{end}),
      c_{end} AS (SELECT event_key, count(*) AS n_parties_{end}, round(100*sum(x) FILTER (k <= 5)/nullif(sum(x), 0), 6) AS top5_share_{end}, round(10000*sum(x*x)/nullif(sum(x)*sum(x), 0), 6) AS hhi_{end} FROM r_{end} GROUP BY 1),
      h_{end} AS (SELECT event_key, {', '.join(f"round(100*coalesce(sum(x) FILTER ({category} = '{v}'), 0)/nullif(sum(x), 0), 6) AS share_{v.lower()}_{end}" for v in ('ASIA', 'EUROPE'))} FROM s GROUP BY 1)"""


@query(
    "compare_segmentations",
    f"""WITH s AS (SELECT event_key, counterparty AS op, left(counterparty, length(counterparty) - 1) AS np, category AS oc, CASE WHEN rate > 5 THEN 'ASIA' ELSE category END AS nc, total_amount AS x FROM {_IN_EVENTS}),
      m AS (SELECT event_key, count(*) AS n, count(*) FILTER (oc <> nc) AS moved, round(100.0*count(*) FILTER (oc <> nc)/count(*), 6) AS moved_rows, round(100*coalesce(sum(x) FILTER (oc <> nc), 0)/nullif(sum(x), 0), 6) AS moved_amount FROM s GROUP BY 1),
      {_segmentation_sql('old', 'op', 'oc')}, {_segmentation_sql('new', 'np', 'nc')}
      SELECT *, n_parties_old - n_parties_new AS n_merged FROM m LEFT JOIN c_old USING (event_key) LEFT JOIN c_new USING (event_key) LEFT JOIN h_old USING (event_key) LEFT JOIN h_new USING (event_key)""",
)
def compare_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _event_ledger(spark, sf_dir).withColumns({"merged": F.expr("left(counterparty, length(counterparty) - 1)"), "new": F.when(F.col("rate") > 5, "ASIA").otherwise(F.col("category"))})
    return rounded(ag.compare_segmentations(held, ["event_key"], ("counterparty", "merged"), ("category", "new"), "total_amount", ("ASIA", "EUROPE")))


@query("pivot_shares", f"SELECT event_key, {', '.join(f'''count(*) FILTER (category='{r}') AS \"{r}\"''' for r in ('ASIA', 'EUROPE'))} FROM {_IN_EVENTS} GROUP BY 1 HAVING count(*) FILTER (category = 'ASIA') > 0 AND count(*) FILTER (category = 'EUROPE') > 0")
def pivot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _event_ledger(spark, sf_dir).groupBy("event_key", "category").agg(F.count("*").alias("n"))
    return ag.pivot_long(long, ["event_key"], "category", "n", ["ASIA", "EUROPE"])


@query("unpivot_panel", "SELECT series_id, date, name, round(value, 8) AS value FROM weekly_panel UNPIVOT INCLUDE NULLS (value FOR name IN (lending, reserve, deposits))")
def unpivot_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ag.unpivot_wide(view(spark, sf_dir, "weekly_panel"), ["series_id", "date"], ["lending", "reserve", "deposits"])
    return long.withColumn("value", F.round("value", 8))


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(lower(name_raw), '{r.pattern}') THEN '{r.label}'" for r in NAME_RULES) + " ELSE 'other' END"


@query("classification_summary", f"SELECT truth, {_RULE} AS label, count(*) AS n, string_agg(DISTINCT (name_id % 4)::VARCHAR, ',' ORDER BY (name_id % 4)::VARCHAR) AS events FROM raw_names GROUP BY 1,2")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "raw_names").select("truth", entities.classify_first(F.col("name_raw"), NAME_RULES).alias("label"), (F.col("name_id") % 4).cast("string").alias("event"))
    return entities.classification_summary(made, "truth", "label", "event")


@query("label_agreement", f"SELECT (name_id % 4)::VARCHAR AS stratum, CASE WHEN {_RULE} = 'bank' THEN 'agree' ELSE 'disagree' END AS verdict, count(*) AS n FROM raw_names GROUP BY 1,2")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = entities.classify_first(F.col("name_raw"), NAME_RULES)
    made = view(spark, sf_dir, "raw_names").select((F.col("name_id") % 4).cast("string").alias("stratum"), F.when(label == "bank", "agree").otherwise("disagree").alias("verdict"))
    return entities.agreement(made, "stratum", "verdict")


@query("quality_gate", "SELECT title, count(*) AS n, count(*) FILTER (ocr_quality_mean >= 0.7 AND word_count >= 40) AS passing FROM articles GROUP BY 1")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "articles").groupBy("title").agg(F.count("*").alias("n"), F.count_if(_gate()).alias("passing"))


@query("window_scan", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-07-01' AND DATE '1996-09-30' OR o_orderdate::DATE BETWEEN DATE '1998-09-01' AND DATE '1998-10-31'")
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.scan_windows(spark, f"{sf_dir}/orders.parquet", [("1996-07-01", "1996-09-30"), ("1998-09-01", "1998-10-31")], ["o_orderkey", "o_orderdate"], "o_orderdate")
    return found.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


@query("placebo_sampled")
def placebo_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, events = view(spark, sf_dir, "daily_rate"), view(spark, sf_dir, "events_dim")
    centers = placebo.placebo_centers(rate.agg(F.min("date").alias("lo"), F.max("date").alias("hi")), events, 365, 90, n=1000)
    return placebo.false_positive_rate(placebo.placebo_windows(rate, centers, 42, {"m": F.max("rate")}), "m", 5.0)


@query("anomaly_table")
def anomaly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    for c in ("deposits", "reserve"):
        rows = ts.robust_z(rows, c, KEYS, "date", out=f"{c}_rz")
    made = models.isolation_forest(rows, "row_id", ["deposits", "d4", "r4"])
    return models.anomaly_scores(made, ["deposits_rz", "reserve_rz"], "score", "anomaly").select("series_id", "date", "score", "max_abs_z", "dominant", "z_flag", "both")


@query("isolation_backtest")
def isolation_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.isolation_backtest(_model_rows(spark, sf_dir), view(spark, sf_dir, "events_dim"), "row_id", "date", ["deposits", "d4", "r4"])
    return made.groupBy("event_key", "series_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


@query("coefficient_summary")
def coefficient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.coefficient_summary(models.loeo_logistic(_model_rows(spark, sf_dir), view(spark, sf_dir, "events_dim"), "date", ["d4", "r4", "z"], keep=KEYS)[1])


@query(
    "stream_ewma",
    """WITH RECURSIVE n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), e AS (SELECT user_id, ts, value, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.ts, n.value, n.i, 0.3 * n.value + 0.7 * e.y FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1)
      SELECT user_id, ts, round(y, 8) AS ewma FROM e""",
)
def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = online.drain(online.ewma(_event_stream(spark, sf_dir), "user_id", "ts", "value", 0.3), "append", "ewma")
    return made.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("ewma", 8).alias("ewma"))


@query(
    "stream_persistence",
    "SELECT user_id, ts, (count(*) OVER w = 4 AND sum((value >= 15)::INT) OVER w >= 2)::INT::DOUBLE AS alert FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
def stream_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = online.drain(online.persistence(_event_stream(spark, sf_dir), "user_id", "ts", "value", 15.0, 2, 4), "append", "persistence")
    return made.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "alert")


@query("stream_first_mentions", r"""SELECT title, min(date) AS date, arg_min(doc_id, (date, doc_id)) AS doc_id FROM articles WHERE ocr_quality_mean >= 0.7 AND word_count >= 40 AND regexp_matches(lower(coalesce(text, '')), 'licen[cs]e') AND title IS NOT NULL GROUP BY 1""")
def stream_first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive by id, whatever their dates; a last row moves the watermark past them."""
    articles = view(spark, sf_dir, "articles").withColumn("ts", F.col("date").cast("timestamp")).filter("title is not null")
    parts = [*[articles.filter(F.pmod("doc_id", F.lit(4)) == k) for k in (2, 0, 3, 1)], online.closing_row(articles, "ts", 900)]
    hit = F.lower(F.coalesce("text", F.lit(""))).rlike("licen[cs]e")
    found = online.first_mentions(online.replay_parts(parts, "articles"), _gate(), hit, "title", "ts", "doc_id", "800 days")
    return online.drain(found, "append", "mentions").select("title", F.col("ts").cast("date").alias("date"), "doc_id")


def _late_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Events of three spans of days where every fifth row arrives one part late, then a row that closes them, and the days of delay that keep every row.

    A span is eleven days, or a third of the table where that is more; a row is late by less than a span.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, days, rows = events.agg(F.min(F.to_date("ts")), F.datediff(F.max("ts"), F.min("ts")), F.count("*")).first()
    width = max(11, (days or 0) // 3 + 1)
    delay = max(30, width)
    span = F.floor(F.datediff("ts", F.lit(first).cast("date")) / width) + F.when(F.pmod("event_id", F.lit(5)) == 0, 1).otherwise(0)
    parts = [events.filter(span == k).select("user_id", "ts", "value") for k in range(4)]
    return online.replay_parts([*parts, online.closing_row(events.select("user_id", "ts", "value"), "ts", 2 * delay)], "late-rows", online.files_for(rows, 4)), delay


@query(
    "stream_ewma_late",
    """WITH RECURSIVE n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), e AS (SELECT user_id, ts, value, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.ts, n.value, n.i, 0.3 * n.value + 0.7 * e.y FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1)
      SELECT user_id, ts, round(y, 8) AS ewma FROM e""",
)
def stream_ewma_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows are taken in order of time, as in the batch twin."""
    stream, delay = _late_stream(spark, sf_dir)
    made = online.drain(online.ewma(stream, "user_id", "ts", "value", 0.3, late=f"{delay} days"), "append", "ewma-late")
    return made.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("ewma", 8).alias("ewma"))


_LATE, _SECOND = "user_id % 50 = 7", "user_id % 50 = 8"


@query(
    "stream_late_rows",
    f"""WITH w AS (SELECT *, {_LATE} AS late, {_SECOND} AS second, date_trunc('week', ts) AS week_start FROM events), m AS (SELECT max(ts) FILTER (NOT late AND NOT second) - INTERVAL 2 DAY AS first, max(ts) - INTERVAL 2 DAY AS last FROM w)
      SELECT event_type, week_start, count(*) AS n, round(sum(value), 2) AS total FROM w, m WHERE (NOT late OR week_start + INTERVAL 7 DAY > first) AND week_start + INTERVAL 7 DAY <= last GROUP BY 1,2""",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users' rows arrive after all others: those of closed weeks are dropped, and only closed weeks are given out.

    A batch's rows are held against the watermark that the batch before started with, hence three parts.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = online.replay_parts([events.filter(f"NOT ({_LATE}) AND NOT ({_SECOND})"), events.filter(_SECOND), events.filter(_LATE)], "late-events")
    made = online.drain(online.weekly_counts(stream, "ts", "event_type", "value"), "append", "late")
    return made.select("event_type", F.col("week_start").cast("timestamp_ntz").alias("week_start"), "n", F.round("total", 2).alias("total"))


# ---- readers over files that are derived from the tables --------------------------------------


@query("read_panel", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN NOT isnan(l_discount) THEN l_discount END AS l_discount FROM lineitem")
def read_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_panel(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("read_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_acctbal FROM customer")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as gzipped CSV and read with a stated schema, keys as text, and some columns only."""
    path, source = scratch(spark, "customers"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    source.write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_csv(spark, path, "c_custkey string, c_name string, c_mktsegment string, c_acctbal double", ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("read_csv_with_preamble", "SELECT date, rate FROM daily_rate")
def read_csv_with_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates below a title and a header line, one file per year."""
    path = scratch(spark, "rates")
    rows = view(spark, sf_dir, "daily_rate").select(F.year("date").alias("y"), F.concat_ws(",", F.date_format("date", "d MMM yyyy"), F.col("rate").cast("string")).alias("value"), F.lit(2).alias("part"))
    heads = rows.select("y").distinct().select("y", F.explode(F.array(F.struct(F.lit("Rates, DATED").alias("value"), F.lit(0).alias("part")), F.struct(F.lit("DATE,RATE").alias("value"), F.lit(1).alias("part")))).alias("h")).select("y", "h.*")
    heads.unionByName(rows).repartition("y").sortWithinPartitions("y", "part").select("y", "value").write.partitionBy("y").text(path)
    read = readers.read_csv_with_preamble(spark, path, "DATE,", "date string, rate double")
    return read.select(fc.to_date_lenient(F.col("date")).alias("date"), "rate")


@query("shaped_columns", "SELECT o_orderdate::DATE AS day, o_totalprice AS price FROM orders")
def shaped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sheet with headings among its rows: columns by position, dated rows, columns by a word of the header."""
    sheet = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("c0"), F.col("o_totalprice").alias("c1"))
    notes = sheet.groupBy(F.substring("c0", 1, 4).alias("c0")).agg(F.max("c1").alias("c1")).withColumn("c0", F.concat(F.lit("Year "), F.col("c0")))
    named = readers.project_by_position(sheet.unionByName(notes), {0: "Date of order", 1: "Total Price (gbp)"})
    dated = readers.keep_dated_rows(named, "Date of order")
    picked = readers.select_by_header_keyword(dated, {"day": "date", "price": "price", "absent": "interest"})
    return picked.withColumn("day", F.to_date("day"))


@query("lenient_dates", "SELECT DISTINCT o_orderdate::DATE AS date, o_orderdate::DATE AS parsed FROM orders")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    written = F.regexp_replace(F.date_format("date", "d MMM yyyy"), "Sep ", "Sept ")
    return days.select("date", fc.to_date_lenient(written).alias("parsed"))


@query("epoch_units", "SELECT user_id, ts, 'us' AS unit FROM events")
def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    unit, read = readers.infer_epoch_unit(raw, "ts", (1990, 2035))
    return read.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(unit).alias("unit"))


@query("filter_country", "SELECT country, year, round(gdp, 2) AS gdp FROM annual_panel WHERE country = 'ASIA'")
def filter_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(readers.filter_country(view(spark, sf_dir, "annual_panel"), "Asia", "AS"), "gdp").select("country", "year", "gdp")


@query("window_extract", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-07-01' AND DATE '1996-09-30'")
def window_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's rows, extracted once; the second call finds the extract."""
    path = scratch(spark, "extract")
    found = readers.scan_windows(spark, f"{sf_dir}/orders.parquet", [("1996-07-01", "1996-09-30")], ["o_orderkey", "o_orderdate"], "o_orderdate")
    dated = found.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    extract(dated, path)
    return extract(dated, path)


@query("csv_sink", "SELECT o_orderkey, o_totalprice, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their parts written as CSV, where arrays become joined text, and read again."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey").select("o_orderkey", "o_totalprice", F.col("l.l_partkey").alias("parts"))
    path = scratch(spark, "orders-csv")
    readers.write_table(made, path, "csv")
    return readers.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, parts string")


@query(
    "file_inventory",
    "SELECT c_nationkey::INT AS nation, sum(length(c_name) + 1)::BIGINT AS bytes, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256 FROM customer GROUP BY 1",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names written as one text file a nation: size and digest of each file."""
    path = scratch(spark, "names")
    named = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_name")
    named.repartition("nation").sortWithinPartitions("nation", "c_name").write.partitionBy("nation").text(path)
    found = readers.file_inventory(spark, path).filter(F.col("path").endswith(".txt"))
    return found.select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("nation"), "bytes", "sha256")
