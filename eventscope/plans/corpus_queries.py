"""Queries over documents, names, graphs, chains, reconciliation and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions import columns as fc
from eventscope.functions import timeseries as ts
from eventscope.operators import chains, changepoint, entities, graph, models, placebo, reconcile, text
from eventscope.operators import events as ev
from eventscope.operators import rules as ru
from eventscope.plans.fixtures import table, view
from eventscope.plans.panel_queries import KEYS, rounded
from eventscope.plans.registry import query
from eventscope.sources import readers
from eventscope.sources.storage import materialize
from eventscope.streaming import online

# ---- documents ------------------------------------------------------------------------------

GATE = "ocr_quality_mean >= 0.7 AND word_count >= 40"
FAMILIES = {"license": "licen[cs]e", "login": "(password|token|secret)", "the_and": (r"\bthe\b", r"\band\b"), "near": r"\bthe\b[^.]{0,40}\bof\b"}


def _gate() -> F.Column:
    return fc.quality_gate(F.col("ocr_quality_mean"), F.col("word_count"))


def _hit_sql(clause) -> str:
    parts = (clause,) if isinstance(clause, str) else clause
    return "(" + " AND ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}')" for p in parts) + ")"


@query("coverage_probe", f"SELECT event_key, count(*) AS raw, count(*) FILTER ({GATE}) AS after_gate FROM articles JOIN events_dim ON date BETWEEN pre_start AND post_end GROUP BY 1")
def coverage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.coverage_probe(view(spark, sf_dir, "articles"), view(spark, sf_dir, "events_dim"), "date", _gate())


@query(
    "coverage_monthly",
    f"SELECT event_key, strftime(date, '%Y-%m') AS month, count(*) AS articles, count(*) FILTER ({_hit_sql(FAMILIES['login'])}) AS matching FROM articles JOIN events_dim ON date BETWEEN pre_start AND post_end WHERE {GATE} GROUP BY 1,2",
)
def coverage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.coverage_monthly(view(spark, sf_dir, "articles").filter(_gate()), view(spark, sf_dir, "events_dim"), "date", text.matches("text", FAMILIES["login"]))


_LABELS = ", ".join(f"CASE WHEN {_hit_sql(c)} THEN '{n}' END" for n, c in FAMILIES.items())


@query("match_clauses", f"SELECT doc_id, concat_ws(',', {_LABELS}) AS labels FROM articles WHERE {GATE} AND ({' OR '.join(map(_hit_sql, FAMILIES.values()))})")
def match_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.match_clauses(view(spark, sf_dir, "articles").filter(_gate()), FAMILIES)
    return found.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(
    "match_snippets",
    r"""WITH p AS (SELECT doc_id, text, length(regexp_extract(lower(text), '(?s)^(.*?)licen[cs]e', 1)) + 1 AS position FROM articles WHERE regexp_matches(lower(text), 'licen[cs]e'))
      SELECT doc_id, position::INT AS position, trim(regexp_replace(substring(text, greatest(1, position - 90), position + 170 - greatest(1, position - 90)), '\s+', ' ', 'g')) AS snippet FROM p""",
)
def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.describe_match(view(spark, sf_dir, "articles"), FAMILIES["license"]).filter("position > 0").select("doc_id", "position", "snippet")


_MARKED = f"mk AS (SELECT a.*, event_key FROM articles a JOIN events_dim ON date BETWEEN pre_start AND post_end WHERE {GATE} AND {_hit_sql(FAMILIES['license'])})"


@query(
    "first_marker",
    f"""WITH {_MARKED}, w AS (SELECT event_key, date_trunc('week', date)::DATE + 6 AS week, count(*) AS c FROM mk GROUP BY ALL), pk AS (SELECT event_key, week, row_number() OVER (PARTITION BY event_key ORDER BY c DESC, week) AS k FROM w),
      f AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY date, doc_id) AS k, count(*) OVER (PARTITION BY event_key) AS n FROM mk)
      SELECT f.event_key, n, date AS first_date, doc_id, title, word_count, week AS peak_week FROM f JOIN pk ON pk.event_key = f.event_key AND pk.k = 1 WHERE f.k = 1""",
)
def first_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "articles").filter(_gate()).filter(text.matches("text", FAMILIES["license"]))
    return text.first_marker(hits, view(spark, sf_dir, "events_dim"), "date", ["doc_id", "title", "word_count"], "doc_id")


@query("earliest_matches", f"WITH {_MARKED}, f AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY date, doc_id) AS place FROM mk) SELECT event_key, doc_id, date, place::INT AS place FROM f WHERE place <= 3")
def earliest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "articles").filter(_gate()).filter(text.matches("text", FAMILIES["license"]))
    return text.earliest_k(hits, view(spark, sf_dir, "events_dim"), "date", "doc_id").select("event_key", "doc_id", "date", "place")


_FAMILY_ROWS = " UNION ALL ".join(f"SELECT event_key, '{n}' AS family, date, {_hit_sql(c)} AS hit FROM ga" for n, c in FAMILIES.items())


@query(
    "coverage_families",
    f"""WITH ga AS (SELECT a.*, event_key FROM articles a JOIN events_dim ON date BETWEEN pre_start AND post_end WHERE {GATE}), r AS ({_FAMILY_ROWS}),
      m AS (SELECT event_key, family, strftime(date, '%Y-%m') AS month, count(*) AS base, count(*) FILTER (hit) AS hits, min(date) FILTER (hit) AS f FROM r GROUP BY 1,2,3),
      k AS (SELECT *, row_number() OVER (PARTITION BY event_key, family ORDER BY CASE WHEN base >= 3 THEN 0 ELSE 1 END, CASE WHEN base >= 3 THEN hits::DOUBLE / base END DESC, month) AS s, max(base) OVER (PARTITION BY event_key, family) >= 3 AS enough, row_number() OVER (PARTITION BY event_key, family ORDER BY hits DESC, month) AS p FROM m)
      SELECT event_key, family, sum(hits)::BIGINT AS hits, CASE WHEN bool_or(enough) THEN min(month) FILTER (s = 1) ELSE min(month) FILTER (p = 1) END AS surge_month, min(month) FILTER (p = 1) AS peak_month, min(f) AS first_mention FROM k GROUP BY 1,2""",
)
def coverage_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.coverage_families(view(spark, sf_dir, "articles").filter(_gate()), view(spark, sf_dir, "events_dim"), "date", FAMILIES)


# ---- placebo --------------------------------------------------------------------------------

_CENTERS = """ce AS (SELECT d::DATE AS center FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT min(date) + 90 AS lo, max(date) - 90 AS hi FROM daily_rate)) WHERE NOT EXISTS (SELECT 1 FROM events_dim WHERE d::DATE BETWEEN acute_peak - 365 AND acute_peak + 365))"""
_AROUND = "pw AS (SELECT center, max(rate) AS m, count(*) AS n FROM ce JOIN daily_rate ON abs(date - center) <= 42 GROUP BY 1), rv AS (SELECT event_key, max(rate) AS m FROM daily_rate JOIN events_dim ON abs(date - acute_peak) <= 42 GROUP BY 1)"


def _placebo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rate, events = view(spark, sf_dir, "daily_rate"), view(spark, sf_dir, "events_dim")
    centers = placebo.placebo_centers(rate.agg(F.min("date").alias("lo"), F.max("date").alias("hi")), events, 365, 90)
    stats = {"m": F.max("rate"), "n": F.count("*")}
    real = placebo.placebo_windows(rate, events.select("event_key", F.col("acute_peak").alias("center")), 42, stats).select("event_key", "m")
    return placebo.placebo_windows(rate, centers, 42, stats).filter("n is not null"), real


@query("placebo_windows", f"WITH {_CENTERS}, {_AROUND} SELECT center, m, n FROM pw")
def placebo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placebo(spark, sf_dir)[0]


@query(
    "placebo_percentile",
    f"WITH {_CENTERS}, {_AROUND} SELECT event_key, rv.m, round((SELECT avg(m) FROM pw), 6) AS placebo_mean, round((SELECT quantile_cont(m, 0.95) FROM pw), 6) AS placebo_p95, (SELECT max(m) FROM pw) AS placebo_max, (SELECT count(m) FROM pw) AS n_placebo, round(100.0 * (SELECT count(*) FROM pw WHERE pw.m <= rv.m) / (SELECT count(m) FROM pw), 6) AS percentile FROM rv",
)
def placebo_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fake, real = _placebo(spark, sf_dir)
    return rounded(placebo.placebo_compare(real, fake, "m"))


# ---- reconciliation ---------------------------------------------------------------------------


@query(
    "reconcile_anchors",
    """WITH d AS (SELECT date, model_value, anchor_value, 100*abs(model_value-anchor_value)/nullif(abs(anchor_value), 0) AS p FROM observed) SELECT date, 'total' AS variable, round(p, 6) AS pct_diff,
      CASE WHEN p IS NULL THEN 'missing' WHEN p <= 1 THEN 'pass' WHEN p <= 5 THEN 'warning' ELSE 'fail' END AS status, coalesce(round(model_value, 2) = round(anchor_value, 2), false) AS exact FROM d""",
)
def reconcile_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.compare(view(spark, sf_dir, "observed"), ["date"], {"total": ("model_value", "anchor_value")}).select("date", "variable", "pct_diff", "status", "exact"))


@query(
    "usability",
    """WITH d AS (SELECT 100*abs(model_value-anchor_value)/nullif(abs(anchor_value), 0) AS p FROM observed), u AS (SELECT count(*) AS n, 100*avg((p <= 1)::INT::DOUBLE) AS r, quantile_cont(p, 0.5) AS m FROM d)
      SELECT 'total' AS variable, n, round(r, 6) AS pass_rate, round(m, 6) AS median_diff, CASE WHEN r >= 80 THEN 'usable' WHEN r >= 50 THEN 'weak' ELSE 'unusable' END AS verdict FROM u""",
)
def usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.usability(reconcile.compare(view(spark, sf_dir, "observed"), ["date"], {"total": ("model_value", "anchor_value")})))


@query(
    "dedupe_most_complete",
    """WITH k AS (SELECT series_id, date, lending, reserve, deposits, row_number() OVER (PARTITION BY date ORDER BY (lending IS NOT NULL)::INT + (reserve IS NOT NULL)::INT + (deposits IS NOT NULL)::INT DESC, series_id) AS k FROM weekly_panel) SELECT date, series_id, round(deposits, 8) AS deposits FROM k WHERE k = 1""",
)
def dedupe_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reconcile.dedupe_most_complete(view(spark, sf_dir, "weekly_panel"), ["date"], ["lending", "reserve", "deposits"], ["series_id"])
    return rounded(kept.select("date", "series_id", "deposits"), 8)


@query(
    "override_with",
    "SELECT o.date, round(o.model_value, 2) AS value_own, round(coalesce(a.anchor_value, o.model_value), 2) AS value, coalesce(round(o.model_value, 2) <> round(a.anchor_value, 2), false) AS mismatch FROM observed o LEFT JOIN (SELECT * FROM observed WHERE weekday(date) = 3) a USING (date)",
)
def override_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view(spark, sf_dir, "observed")
    anchors = seen.filter(fc.on_weekday(F.col("date"), "Wednesday")).select("date", F.round("anchor_value", 2).alias("value"))
    return reconcile.override_with(seen.select("date", F.round("model_value", 2).alias("value")), anchors, ["date"], "value")


@query(
    "fill_rates",
    "SELECT unnest(['lending', 'reserve', 'deposits']) AS variable, unnest([count(lending), count(reserve), count(deposits)]) AS filled, unnest([round(100.0*count(lending)/count(*), 6), round(100.0*count(reserve)/count(*), 6), round(100.0*count(deposits)/count(*), 6)]) AS rate FROM weekly_panel",
)
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.fill_rates(view(spark, sf_dir, "weekly_panel"), ["lending", "reserve", "deposits"]))


@query("range_check", "SELECT event_key, min(rate) AS low, max(rate) AS high, count(rate) AS n, min(rate) = max(rate) AS agrees FROM daily_rate JOIN events_dim ON date BETWEEN acute_start AND acute_end GROUP BY 1")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.range_check(view(spark, sf_dir, "daily_rate"), view(spark, sf_dir, "events_dim"), "date", "rate", "acute_start", "acute_end", "event_key")


@query(
    "review_queue",
    """SELECT d.date, arg_min(e.event_key, e.pre_start) AS event_key, NULL::DOUBLE AS low_value, NULL::DOUBLE AS high_value FROM (SELECT DISTINCT date FROM daily_rate WHERE weekday(date) <> 0) d LEFT JOIN events_dim e ON d.date BETWEEN e.pre_start AND e.post_end GROUP BY 1""",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "daily_rate").select("date").distinct()
    return reconcile.review_queue(days, view(spark, sf_dir, "events_dim"), "date", "pre_start", "post_end", "event_key", ["low_value", "high_value"])


@query(
    "annual_context",
    """WITH g AS (SELECT a.country, a.year, a.gdp, a.gdp/nullif(b.gdp, 0) - 1 AS y FROM annual_panel a LEFT JOIN annual_panel b ON b.country = a.country AND b.year = a.year - 1),
      s AS (SELECT DISTINCT country, event_key, year(acute_peak)::INT AS year FROM annual_panel, events_dim) SELECT s.country, s.event_key, s.year, round(g.gdp, 2) AS gdp, round(g.y, 6) AS gdp_yoy, CASE WHEN g.year IS NULL THEN 'outside' ELSE 'covered' END AS status FROM s LEFT JOIN g ON g.country = s.country AND g.year = s.year""",
)
def annual_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reconcile.annual_context(view(spark, sf_dir, "annual_panel"), view(spark, sf_dir, "events_dim"), ["country"], "year", ["gdp"])
    return rounded(made.select("country", "event_key", "year", F.round("gdp", 2).alias("gdp"), "gdp_yoy", "status"))


_SECURITIES = """sp AS (SELECT security_id, last_day(make_date(year, month, 1)) AS date, quantile_cont(price, 0.5) AS price, min(name) AS name, min(sector) AS sector FROM quotes WHERE price > 0 GROUP BY 1,2),
  sr AS (SELECT *, lag(price) OVER w AS prev_price, CASE WHEN price/nullif(lag(price) OVER w, 0) - 1 BETWEEN -0.8 AND 2 THEN price/nullif(lag(price) OVER w, 0) - 1 END AS ret FROM sp WINDOW w AS (PARTITION BY security_id ORDER BY date))"""


@query("security_panel", f"WITH {_SECURITIES} SELECT security_id, date, round(price, 9) AS price, name, sector, round(prev_price, 9) AS prev_price, round(ret, 6) AS \"return\" FROM sr")
def security_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reconcile.security_panel(view(spark, sf_dir, "quotes"))
    return rounded(made.withColumn("return", F.round("return", 6)), 9)


_SECTORS = f"""{_SECURITIES}, st AS (SELECT sector, date, count(DISTINCT security_id) AS quoted, quantile_cont(ret, 0.5) AS median_return, avg(ret) AS mean_return, avg((ret < 0)::INT::DOUBLE) AS share_declining FROM sr GROUP BY 1,2),
  si AS (SELECT *, exp(sum(ln(1 + coalesce(mean_return, 0))) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING)) * 100 AS idx FROM st)"""


@query("sector_panel", f"WITH {_SECTORS} SELECT sector, date, quoted, round(median_return, 6) AS median_return, round(mean_return, 6) AS mean_return, round(share_declining, 6) AS share_declining, round(idx, 4) AS \"index\" FROM si")
def sector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reconcile.sector_panel(reconcile.security_panel(view(spark, sf_dir, "quotes")))
    return rounded(made.withColumn("index", F.round("index", 4)))


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector panel, written once for the queries that read it several times."""
    return materialize(reconcile.sector_panel(reconcile.security_panel(view(spark, sf_dir, "quotes"))), "sector-panel")


@query(
    "event_study",
    f"""WITH {_SECTORS}, ax AS (SELECT event_key, r::INT AS rel, last_day((acute_peak + to_months(r::INT))::DATE) AS date FROM events_dim, range(-12, 13) t(r)),
      j AS (SELECT s.sector, ax.event_key, ax.rel, ax.date, si.quoted, si.mean_return, si.idx FROM (SELECT DISTINCT sector FROM si) s CROSS JOIN ax LEFT JOIN si ON si.sector = s.sector AND si.date = ax.date),
      f AS (SELECT *, last_value(idx IGNORE NULLS) OVER (PARTITION BY sector, event_key ORDER BY rel ROWS UNBOUNDED PRECEDING) AS i2 FROM j)
      SELECT sector, event_key, rel, date, coalesce(quoted, 0) AS quoted, round(100 * i2 / nullif(max(i2) FILTER (rel = -1) OVER (PARTITION BY sector, event_key), 0), 4) AS rebased, round(i2 / nullif(max(i2) OVER w, 0) - 1, 6) AS drawdown,
        round(exp(sum(CASE WHEN rel >= 0 THEN ln(1 + coalesce(mean_return, 0)) ELSE 0 END) OVER w) - 1, 6) AS cumulative FROM f WINDOW w AS (PARTITION BY sector, event_key ORDER BY rel ROWS UNBOUNDED PRECEDING)""",
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reconcile.event_study(_sectors(spark, sf_dir), view(spark, sf_dir, "events_dim")).drop("index")
    return rounded(made.withColumn("rebased", F.round("rebased", 4)))


@query(
    "event_study_summary",
    f"""WITH {_SECTORS}, ax AS (SELECT event_key, r::INT AS rel, last_day((acute_peak + to_months(r::INT))::DATE) AS date FROM events_dim, range(-12, 13) t(r)),
      j AS (SELECT s.sector, ax.event_key, ax.rel, ax.date, coalesce(si.quoted, 0) AS quoted, si.mean_return, si.share_declining, si.idx FROM (SELECT DISTINCT sector FROM si) s CROSS JOIN ax LEFT JOIN si ON si.sector = s.sector AND si.date = ax.date),
      f AS (SELECT *, last_value(idx IGNORE NULLS) OVER (PARTITION BY sector, event_key ORDER BY rel ROWS UNBOUNDED PRECEDING) AS i2 FROM j),
      g AS (SELECT *, i2 / nullif(max(i2) OVER (PARTITION BY sector, event_key ORDER BY rel ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd, first_value(i2) OVER (PARTITION BY sector, event_key ORDER BY rel) AS i0, first_value(quoted) OVER (PARTITION BY sector, event_key ORDER BY rel) AS q0 FROM f)
      SELECT sector, event_key, max(quoted) FILTER (rel = 0) AS quoted, round(100.0 * max(quoted) FILTER (rel = 0) / nullif(first(q0), 0), 6) AS quote_index, round(max(mean_return) FILTER (rel = 0), 6) AS mean_return, round(max(share_declining) FILTER (rel = 0), 6) AS share_declining,
        round(exp(sum(ln(1 + mean_return)) FILTER (rel BETWEEN 0 AND 2)) - 1, 6) AS return_after, round(exp(sum(ln(1 + mean_return)) FILTER (rel BETWEEN -2 AND 0)) - 1, 6) AS return_before, round(min(dd), 6) AS max_drawdown,
        round(min(100 * i2 / nullif(i0, 0)), 4) AS low, round(max(100 * i2 / nullif(i0, 0)), 4) AS high FROM g GROUP BY 1,2""",
)
def event_study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = _sectors(spark, sf_dir)
    made = reconcile.event_study_summary(reconcile.event_study(sectors, view(spark, sf_dir, "events_dim")), sectors)
    return rounded(made.withColumns({c: F.round(c, 4) for c in ("low", "high")}))


@query(
    "flatten_records",
    "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, turn, role, length(text)::INT AS chars FROM conversations",
)
def flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("days"))).alias("page"))
    fenced = nested.withColumn("page", F.concat(F.lit("```json\n"), F.col("page"), F.lit("\n```")))
    parsed = fenced.withColumn("record", reconcile.parse_json_lenient(F.col("page"), "days array<struct<turn:bigint,role:string,text:string>>"))
    flat = reconcile.flatten_records(parsed.withColumn("days", F.col("record.days")), "days", ["conv_id"])
    return flat.select("conv_id", "pos", "turn", "role", F.length("text").alias("chars"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").withColumn("r", reconcile.parse_json_lenient(F.col("props"), "k bigint"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r.k").alias("total"))


# ---- names ------------------------------------------------------------------------------------


@query(
    "clean_names",
    r"""WITH c AS (SELECT name_id, regexp_replace(trim(regexp_replace(name_raw, '\s+', ' ', 'g')), ' [aA]nd ', ' & ', 'g') AS s FROM raw_names)
      SELECT name_id, array_to_string(list_transform(string_split(lower(s), ''), lambda x, i: CASE WHEN i = 1 OR NOT regexp_matches(lower(s)[i-1:i-1], '\pL') THEN upper(x) ELSE x END), '') AS name FROM c""",
)
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_names").select("name_id", entities.clean_name(F.col("name_raw")).alias("name"))


# word by word, unlike the operator's patterns
_NORMAL = """array_to_string(list_transform(list_filter(regexp_split_to_array(trim(replace(regexp_replace(lower(name_raw), '[^a-z0-9_\\s&]', ' ', 'g'), 'messrs', '')), '\\s+'),
  lambda w: w NOT IN ('', 'mess', 'mr', 'the', 'co', 'coy', 'company', 'cmpy', 'limited', 'ltd', 'brothers', 'bros', 'brs', 'sons', 'son', 'inc', 'incorporated')),
  lambda w: CASE w WHEN 'and' THEN '&' WHEN 'commercial' THEN 'commerc' WHEN 'discount' THEN 'disc' WHEN 'corporation' THEN 'corp' ELSE w END), ' ')"""


@query("normalize_names", f"WITH n AS (SELECT name_id, {_NORMAL} AS normal FROM raw_names) SELECT name_id, normal, CASE WHEN split_part(normal, ' ', 1) <> '' THEN left(split_part(normal, ' ', 1), 5) END AS block FROM n")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "raw_names").select("name_id", entities.normalize_name(F.col("name_raw")).alias("normal"))
    return made.withColumn("block", entities.block_key(F.col("normal")))


@query("resolve_entities")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve_entities(view(spark, sf_dir, "raw_names"), "name_raw")


NAME_RULES = (
    entities.Rule("almond|antique", "merchant", 0.6, "a-goods"), entities.Rule("blush|blue", "broker", 0.65, "b-goods"), entities.Rule("brand#1", "bank", 0.8, "first brand"),
    entities.Rule("limited", "company", 0.5, "limited"), entities.Rule("& co", "company", 0.5, "co"),
)


@query(
    "classify_first",
    "SELECT name_id, CASE WHEN coalesce(name_raw, '') = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(lower(name_raw), '{r.pattern}') THEN '{r.label}'" for r in NAME_RULES) + " ELSE 'other' END AS label FROM raw_names",
)
def classify_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_names").select("name_id", entities.classify_first(F.col("name_raw"), NAME_RULES).alias("label"))


@query(
    "classify_ordered",
    "SELECT name_id, CASE WHEN trim(coalesce(name_raw, '')) = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(lower(name_raw), '{r.pattern}') THEN '{r.label}'" for r in NAME_RULES) + " ELSE 'unknown' END AS label, CASE WHEN trim(coalesce(name_raw, '')) = '' THEN 0 "
    + " ".join(f"WHEN regexp_matches(lower(name_raw), '{r.pattern}') THEN {r.weight}" for r in NAME_RULES) + " ELSE 0.2 END::DOUBLE AS confidence FROM raw_names",
)
def classify_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_names").select("name_id", entities.classify_ordered(F.col("name_raw"), NAME_RULES).alias("c")).select("name_id", "c.*")


_WEIGHTED = f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{r.pattern}', '{r.label}', {r.weight}::DOUBLE, '{r.term}')" for k, r in enumerate(NAME_RULES))}) t(k, pattern, label, w, term)),
      h AS (SELECT name_id, arg_max(label, w - k*1e-6) AS label, max(w) AS w, count(*) AS n, count(DISTINCT label) AS labels, string_agg(DISTINCT term, ',' ORDER BY term) AS evidence FROM raw_names JOIN r ON regexp_matches(lower(name_raw), pattern) GROUP BY 1),
      b AS (SELECT name_id, len(list_filter(regexp_split_to_array(name_raw, '\\s+'), lambda x: x <> '')) BETWEEN 2 AND 4 AND NOT regexp_matches(name_raw, '\\d') AS bare FROM raw_names)
      SELECT b.name_id, CASE WHEN h.n > 0 THEN h.label WHEN bare THEN 'individual_or_partnership' ELSE 'unknown' END AS label, CASE WHEN h.n > 0 THEN round(least(w + 0.05*(n-1), 0.95), 2) WHEN bare THEN 0.55 ELSE 0 END::DOUBLE AS confidence,
        coalesce(h.evidence, '') AS evidence, CASE WHEN h.n > 0 THEN labels > 1 AND w < 0.7 ELSE true END AS review FROM b LEFT JOIN h USING (name_id)"""


@query("classify_weighted", _WEIGHTED)
def classify_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entities.classify_weighted(view(spark, sf_dir, "raw_names"), "name_raw", NAME_RULES)
    return made.select("name_id", "label", "confidence", F.array_join("evidence", ",").alias("evidence"), "review")


CURATED = (entities.Rule("brand#55", "house", 0.95, "brand 55"), entities.Rule("brand#5", "agent", 0.95, "brand 5"))


@query(
    "classify_curated",
    f"""WITH w AS ({_WEIGHTED}), n AS (SELECT name_id, lower(name_raw) AS l FROM raw_names), c AS (SELECT name_id, regexp_matches(l, 'brand#55') AS a, regexp_matches(l, 'brand#5') AS b, regexp_matches(l, 'messrs') AS p FROM n)
      SELECT name_id, CASE WHEN a THEN 'house' WHEN b THEN 'agent' WHEN p THEN 'individual_or_partnership' ELSE label END AS label, CASE WHEN b THEN 0.95 WHEN p THEN 0.7 ELSE confidence END::DOUBLE AS confidence,
        CASE WHEN a THEN 'brand 55' WHEN b THEN 'brand 5' WHEN p THEN 'honorific' ELSE evidence END AS evidence, CASE WHEN b OR p THEN false ELSE review END AS review FROM w JOIN c USING (name_id)""",
)
def classify_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entities.classify_weighted(view(spark, sf_dir, "raw_names"), "name_raw", NAME_RULES, CURATED, ("messrs",))
    return made.select("name_id", "label", "confidence", F.array_join("evidence", ",").alias("evidence"), "review")


PARTY_RULES = (entities.Rule("#0*[1-9]$", "founder", 0.9, "single digit"), entities.Rule("[02468]$", "house", 0.6, "even"), entities.Rule("[13]$", "broker", 0.4, "one or three"))
_PARTY = "CASE " + " ".join(f"WHEN regexp_matches(lower(counterparty), '{r.pattern}') THEN {{{k}}}" for k, r in enumerate(PARTY_RULES)) + " ELSE {3} END"


@query(
    "validation_sample",
    f"""WITH h AS (SELECT counterparty, event_key, total_amount, {_PARTY.format(*[f"'{r.label}'" for r in PARTY_RULES], "'unknown'")} AS label, {_PARTY.format(*[r.weight for r in PARTY_RULES], 0.2)} AS confidence FROM ledger JOIN events_dim ON date BETWEEN acute_start AND acute_end),
      t AS (SELECT counterparty, sum(total_amount) AS total, bool_or(confidence < 0.5 OR label = 'unknown') AS low, md5(counterparty || ':7') AS o FROM h GROUP BY 1),
      p AS (SELECT counterparty, event_key, row_number() OVER (PARTITION BY event_key ORDER BY md5(counterparty || ':7'), counterparty) AS k FROM (SELECT DISTINCT counterparty, event_key FROM h)),
      s AS (SELECT * FROM (SELECT counterparty, 'top_by_volume' AS stratum, total FROM t ORDER BY total DESC, counterparty LIMIT 20) UNION ALL SELECT counterparty, 'random_' || event_key, total FROM p JOIN t USING (counterparty) WHERE k <= 20
        UNION ALL SELECT * FROM (SELECT counterparty, 'low_confidence', total FROM t WHERE low ORDER BY o, counterparty LIMIT 20))
      SELECT counterparty, stratum, round(total, 2) AS total FROM s""",
)
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and confidences are those that the ordered rules give to the parties' names."""
    held = ev.window_join(view(spark, sf_dir, "ledger"), view(spark, sf_dir, "events_dim"), "date", F.col("acute_start"), F.col("acute_end"))
    held = held.withColumn("c", entities.classify_ordered(F.col("counterparty"), PARTY_RULES)).withColumns({"label": F.col("c.label"), "confidence": F.col("c.confidence")})
    made = entities.validation_sample(held, "counterparty", "event_key", "total_amount", "confidence", label="label")
    return made.withColumn("total", F.round("total", 2))


# ---- graphs -----------------------------------------------------------------------------------

_EDGES = "ed AS (SELECT a.institution AS src, b.institution AS dst, count(*) AS weight, string_agg(a.period::VARCHAR, ';' ORDER BY a.period::VARCHAR) AS shared FROM membership a JOIN membership b ON a.period = b.period AND a.institution < b.institution GROUP BY 1,2)"


@query("bipartite_projection", f"WITH {_EDGES} SELECT src, dst, weight, shared FROM ed")
def bipartite_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.project_bipartite(view(spark, sf_dir, "membership"), "institution", "period")


@query("degree", f"WITH {_EDGES}, b AS (SELECT src AS v, weight FROM ed UNION ALL SELECT dst, weight FROM ed) SELECT institution, coalesce(count(b.v), 0) AS degree, coalesce(sum(b.weight), 0)::BIGINT AS weighted_degree FROM (SELECT DISTINCT institution FROM membership) m LEFT JOIN b ON b.v = m.institution GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projected_degree(view(spark, sf_dir, "membership"), "institution", "period")


@query(
    "graph_summary",
    f"""WITH {_EDGES}, b AS (SELECT src AS v, weight FROM ed UNION ALL SELECT dst, weight FROM ed), d AS (SELECT institution, coalesce(sum(b.weight), 0) AS w FROM (SELECT DISTINCT institution FROM membership) m LEFT JOIN b ON b.v = m.institution GROUP BY 1)
      SELECT count(*) AS nodes, (SELECT count(*) FROM ed) AS edges, round(2.0*(SELECT count(*) FROM ed)/nullif(count(*)*(count(*)-1), 0), 6) AS density, arg_max(institution, w) FILTER (w = (SELECT max(w) FROM d)) AS top, round(avg((institution LIKE '%1')::INT::DOUBLE), 6) AS type_share FROM (SELECT * FROM d ORDER BY w DESC, institution)""",
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = graph.projected_degree(view(spark, sf_dir, "membership"), "institution", "period")
    return rounded(graph.summary_of(degrees, "institution", F.col("institution").endswith("1")))


@query("eigenvector_centrality")
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projected_eigenvector(view(spark, sf_dir, "membership"), "institution", "period")


@query("betweenness_centrality")
def betweenness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projected_betweenness(view(spark, sf_dir, "membership"), "institution", "period")


@query("betweenness_sampled")
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate from 64 pivots, with its bound."""
    return graph.projected_betweenness(view(spark, sf_dir, "membership"), "institution", "period", pivots=64)


@query(
    "star_edges",
    """WITH t AS (SELECT category AS src, counterparty AS dst, round(sum(total_amount), 2) AS total FROM ledger GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY total DESC, dst) AS place, max(total) OVER (PARTITION BY src) AS m FROM t) SELECT src, dst, total, place::INT AS place, round(total/nullif(m, 0), 6) AS weight FROM k WHERE place <= 5""",
)
def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.star_edges(view(spark, sf_dir, "ledger"), "category", "counterparty", "total_amount", 5).withColumn("total", F.round("total", 2)))


# ---- clocks and chains --------------------------------------------------------------------------

_TIMELINE = """tm AS (SELECT l.*, event_key FROM ledger l JOIN events_dim ON date BETWEEN pre_start AND post_end), wk AS (SELECT event_key, date_trunc('week', date)::DATE + 6 AS week, count(*) AS c FROM tm WHERE category = 'ASIA' AND rate > 9 GROUP BY ALL),
  tl AS (SELECT t.event_key, t.ledger_start, t.ledger_end, t.n, w.first_week, w.peak_week FROM (SELECT event_key, min(date) AS ledger_start, max(date) AS ledger_end, count(*) AS n FROM tm GROUP BY 1) t
    LEFT JOIN (SELECT event_key, min(week) FILTER (c >= 2) AS first_week, arg_max(week, c - (week - DATE '1900-01-01') * 1e-6) AS peak_week FROM wk GROUP BY 1) w USING (event_key))"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.event_timeline(view(spark, sf_dir, "ledger"), view(spark, sf_dir, "events_dim"), "date", (F.col("category") == "ASIA") & (F.col("rate") > 9))


@query("event_timeline", f"WITH {_TIMELINE} SELECT * FROM tl")
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query("marker_timeline", f"WITH {_TIMELINE} SELECT event_key, first_week AS date, 'ledger' AS kind FROM tl WHERE first_week IS NOT NULL UNION ALL SELECT event_key, peak_week, 'peak' FROM tl WHERE peak_week IS NOT NULL UNION ALL SELECT event_key, acute_peak, 'public' FROM events_dim")
def marker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _timeline(spark, sf_dir)
    return chains.marker_timeline((made, "first_week", "ledger"), (made, "peak_week", "peak"), (view(spark, sf_dir, "events_dim"), "acute_peak", "public"))


@query("clock_table", f"WITH {_TIMELINE} SELECT e.event_key, origin, acute_peak, first_week, peak_week, (acute_peak - first_week)::INT AS first_week_lead, (acute_peak - peak_week)::INT AS peak_week_lead FROM events_dim e LEFT JOIN tl USING (event_key)")
def clock_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.clock_table(view(spark, sf_dir, "events_dim"), _timeline(spark, sf_dir), ["first_week", "peak_week"], "acute_peak")


@query("lead_time_summary", f"WITH {_TIMELINE}, c AS (SELECT origin, acute_peak - first_week AS d FROM events_dim LEFT JOIN tl USING (event_key)) SELECT origin, quantile_cont(d, 0.5)::DOUBLE AS median, avg(d)::DOUBLE AS mean, count(d) AS n FROM c GROUP BY GROUPING SETS ((origin), ())")
def lead_time_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventscope.operators.aggregates import grouped_medians

    clocks = chains.clock_table(view(spark, sf_dir, "events_dim"), _timeline(spark, sf_dir), ["first_week"], "acute_peak")
    return grouped_medians(clocks, [["origin"], []], "first_week_lead")


@query("availability", f"WITH {_TIMELINE}, {_MARKED} SELECT event_key, event_key IN (SELECT event_key FROM tl) AS ledger, event_key IN (SELECT event_key FROM mk) AS press FROM events_dim")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events_dim")
    hits = ev.window_join(view(spark, sf_dir, "articles").filter(_gate()).filter(text.matches("text", FAMILIES["license"])), events)
    return chains.availability(events, {"ledger": _timeline(spark, sf_dir), "press": hits})


@query(
    "information_chain",
    f"""WITH {_TIMELINE}, pr AS (SELECT event_key, count(*) AS a FROM articles JOIN events_dim ON date BETWEEN pre_start AND post_end GROUP BY 1), c AS (SELECT event_key, acute_peak, first_week, peak_week, a FROM events_dim LEFT JOIN tl USING (event_key) LEFT JOIN pr USING (event_key))
      SELECT event_key, least(first_week, peak_week) AS earliest_signal, (acute_peak - least(first_week, peak_week))::INT AS lead_days, CASE WHEN coalesce(a, 0) > 0 AND first_week IS NOT NULL AND peak_week IS NOT NULL THEN 'high' WHEN coalesce(a, 0) > 0 OR first_week IS NOT NULL OR peak_week IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM c""",
)
def information_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events_dim")
    press = ev.window_join(view(spark, sf_dir, "articles"), events).groupBy("event_key").agg(F.count("*").alias("articles"))
    staged = events.select("event_key", "acute_peak").join(_timeline(spark, sf_dir), "event_key", "left").join(press, "event_key", "left")
    return chains.information_chain(staged, ["first_week", "peak_week"], "acute_peak", "articles").select("event_key", "earliest_signal", "lead_days", "confidence")


ERAS = {"E1": "early", "E2": "early", "E3": "late", "E4": "late"}


@query(
    "recurrence",
    """SELECT counterparty, count(DISTINCT event_key) AS n_events, string_agg(DISTINCT event_key, ',' ORDER BY event_key) AS events, count(DISTINCT CASE WHEN event_key IN ('E1', 'E2') THEN 'early' ELSE 'late' END) AS n_eras, count(DISTINCT CASE WHEN event_key IN ('E1', 'E2') THEN 'early' ELSE 'late' END) > 1 AS spans_eras
      FROM ledger JOIN events_dim ON date BETWEEN acute_start AND acute_end WHERE rate > 9 GROUP BY 1""",
)
def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ev.window_join(view(spark, sf_dir, "ledger").filter("rate > 9"), view(spark, sf_dir, "events_dim"), "date", F.col("acute_start"), F.col("acute_end"))
    return chains.recurrence(held, "counterparty", "event_key", ERAS)


@query(
    "flow_sequence",
    f"""WITH {_TIMELINE}, st AS (SELECT event_key, category AS actor, min(date) AS date FROM tm WHERE rate > 9 GROUP BY 1,2), ch AS (SELECT event_key, first_week AS s, acute_peak AS r FROM events_dim LEFT JOIN tl USING (event_key)),
      a AS (SELECT event_key, 'signal' AS actor, s AS date, 0 AS p FROM ch WHERE s IS NOT NULL UNION ALL SELECT event_key, actor, date, 1 FROM st JOIN ch USING (event_key) WHERE s IS NULL OR date BETWEEN s AND r UNION ALL SELECT event_key, 'rupture', r, 2 FROM ch)
      SELECT event_key, row_number() OVER w::INT AS step, actor, date, (date - lag(date) OVER w)::INT AS gap, CASE WHEN count(*) OVER (PARTITION BY event_key) > 1 THEN (last_value(date) OVER (PARTITION BY event_key ORDER BY p, date, actor ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(date) OVER w)::INT END AS span_days
      FROM a WINDOW w AS (PARTITION BY event_key ORDER BY p, date, actor)""",
)
def flow_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events_dim")
    steps = ev.window_join(view(spark, sf_dir, "ledger").filter("rate > 9"), events).groupBy("event_key", F.col("category").alias("actor")).agg(F.min("date").alias("date"))
    chain = events.select("event_key", F.col("acute_peak").alias("rupture_date")).join(_timeline(spark, sf_dir).select("event_key", F.col("first_week").alias("signal_date")), "event_key", "left")
    return chains.flow_sequence(steps, chain)


@query(
    "clock_offsets",
    f"""WITH {_TIMELINE} SELECT event_key, (first_week - acute_peak)::INT AS first_week_offset, (peak_week - acute_peak)::INT AS peak_week_offset, (ledger_start - acute_peak)::INT AS ledger_start_offset,
      (greatest(first_week, peak_week, ledger_start) - least(first_week, peak_week, ledger_start))::INT AS spread, coalesce(greatest(first_week, peak_week, ledger_start) - least(first_week, peak_week, ledger_start) <= 60, false) AS tight FROM tl JOIN events_dim USING (event_key)""",
)
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = _timeline(spark, sf_dir).join(ev.small(view(spark, sf_dir, "events_dim").select("event_key", "acute_peak")), "event_key")
    made = chains.clock_offsets(clocks, ["first_week", "peak_week", "ledger_start"], "acute_peak", 60)
    return made.select("event_key", "first_week_offset", "peak_week_offset", "ledger_start_offset", "spread", "tight")


@query(
    "paired_comparison",
    f"""WITH {_TIMELINE}, c AS (SELECT event_key, (acute_peak - first_week)::DOUBLE AS first_week_lead, (acute_peak - peak_week)::DOUBLE AS peak_week_lead, n::DOUBLE AS n FROM tl JOIN events_dim USING (event_key) WHERE event_key IN ('E1', 'E3')),
      u AS (SELECT event_key, 'first_week_lead' AS measure, first_week_lead AS v FROM c UNION ALL SELECT event_key, 'peak_week_lead', peak_week_lead FROM c UNION ALL SELECT event_key, 'n', n FROM c)
      SELECT measure, max(v) FILTER (event_key = 'E1') AS first, max(v) FILTER (event_key = 'E3') AS second, max(v) FILTER (event_key = 'E3') - max(v) FILTER (event_key = 'E1') AS difference FROM u GROUP BY 1""",
)
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = _timeline(spark, sf_dir)
    clocks = chains.clock_table(view(spark, sf_dir, "events_dim"), timeline, ["first_week", "peak_week"], "acute_peak").join(timeline.select("event_key", "n"), "event_key")
    return chains.paired(clocks, "event_key", "E1", "E3", ["first_week_lead", "peak_week_lead", "n"])


# ---- models and streams (no SQL equivalent) -----------------------------------------------------


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "weekly_panel").withColumn("row_id", F.xxhash64("series_id", "date"))
    return panel.withColumns({"d4": ts.diff("deposits", KEYS, "date", 4), "r4": ts.diff("reserve", KEYS, "date", 4), "z": ts.past_z("deposits", KEYS, "date")})


@query("isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.isolation_forest(_model_rows(spark, sf_dir), "row_id", ["deposits", "d4", "r4"])
    return made.select("series_id", "date", "raw_score", "score", "anomaly")


@query("anomaly_overlap")
def anomaly_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.isolation_forest(_model_rows(spark, sf_dir), "row_id", ["deposits", "d4", "r4"])
    return models.anomaly_overlap(made, view(spark, sf_dir, "events_dim"), "date", "score", "anomaly")


@query("loeo_logistic")
def loeo_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events_dim")
    scores, _ = models.loeo_logistic(_model_rows(spark, sf_dir), events, "date", ["d4", "r4", "z"], keep=KEYS)
    return models.fold_summary(scores, events, "date")


@query("loeo_scores")
def loeo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of all folds' scores, with thresholds and alerts."""
    return models.loeo_logistic(_model_rows(spark, sf_dir), view(spark, sf_dir, "events_dim"), "date", ["d4", "r4", "z"], keep=KEYS)[0]


@query("warning_report")
def warning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning summary with the forest's highest score and first flag."""
    rows, events = _model_rows(spark, sf_dir), view(spark, sf_dir, "events_dim")
    forest = models.isolation_backtest(rows, events, "row_id", "date", ["deposits", "d4", "r4"])
    scored = ru.warning_index(rows, KEYS, "date", {"d4": 1, "r4": -1})
    return ru.warning_summary(scored, events, KEYS, "date", "score", ["d4_z", "r4_z"], forest=forest)


@query("change_points")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = changepoint.change_points(view(spark, sf_dir, "weekly_panel"), KEYS, "date", "deposits", penalty=1.0)
    return changepoint.events_near(points, view(spark, sf_dir, "events_dim"), KEYS, "date")


@query(
    "mean_shifts",
    """WITH RECURSIVE v AS (SELECT series_id, date, deposits - avg(deposits) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM weekly_panel WHERE deposits IS NOT NULL),
      p AS MATERIALIZED (SELECT series_id, date, n, row_number() OVER w AS i, sum(v) OVER w AS s FROM v WHERE n >= 30 WINDOW w AS (PARTITION BY series_id ORDER BY date)),
      g AS (SELECT series_id, 0 AS a, n AS b, 0.0::DOUBLE AS sa, s AS sb, NULL::DATE AS date, NULL::DOUBLE AS gain FROM p WHERE i = n
        UNION ALL SELECT series_id, unnest([a, m.i]), unnest([m.i, b]), unnest([sa, m.s]), unnest([m.s, sb]), unnest([m.date, NULL]), unnest([m.gain, NULL]) FROM (
          SELECT g.series_id, g.a, g.b, g.sa, g.sb, arg_max({'i': p.i, 's': p.s, 'date': p.date, 'gain': (p.s - sa) ^ 2 / (p.i - a) + (sb - p.s) ^ 2 / (b - p.i) - (sb - sa) ^ 2 / (b - a)}, (p.s - sa) ^ 2 / (p.i - a) + (sb - p.s) ^ 2 / (b - p.i) - (sb - sa) ^ 2 / (b - a)) AS m
          FROM g JOIN p ON p.series_id = g.series_id AND p.i - a >= 2 AND b - p.i >= 2 GROUP BY ALL) WHERE m.gain > 0.5)
      SELECT series_id, date, round(gain, 6) AS gain FROM g WHERE date IS NOT NULL""",
)
def mean_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = changepoint.mean_shifts(view(spark, sf_dir, "weekly_panel"), KEYS, "date", "deposits", penalty=0.5)
    return made.withColumn("gain", F.round("gain", 6) + 0.0)


_ORDERS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))


@query("profile_orders", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM orders" for c, t in _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.profile(table(spark, sf_dir, "orders"), exact=True)


def _event_stream(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Key, time and value of all events in order of time, in bounded micro-batches."""
    return online.replay(table(spark, sf_dir, "events").select(key, F.col("ts").cast("timestamp").alias("ts"), "value"), "ts", "events")


@query("stream_weekly_counts", "SELECT event_type, date_trunc('week', ts) AS week_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1,2")
def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = online.drain(online.weekly_counts(_event_stream(spark, sf_dir, "event_type"), "ts", "event_type", "value"), "complete", "weekly")
    return made.select("event_type", F.col("week_start").cast("timestamp_ntz").alias("week_start"), "n", F.round("total", 2).alias("total"))


@query(
    "stream_past_z",
    """SELECT user_id, ts, value, round(CASE WHEN count(value) OVER w >= 5 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def stream_past_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = online.drain(online.past_z(_event_stream(spark, sf_dir), "user_id", "ts", "value", 5), "append", "past-z")
    return made.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.round("z", 6).alias("z"))


@query(
    "stream_cusum",
    """WITH RECURSIVE n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
      c AS (SELECT user_id, ts, value, i, CASE WHEN value IS NULL OR greatest(0, value - 20) >= 60 THEN 0 ELSE greatest(0, value - 20) END::DOUBLE AS s, value IS NOT NULL AND greatest(0, value - 20) >= 60 AS f FROM n WHERE i = 1
        UNION ALL SELECT n.user_id, n.ts, n.value, n.i, CASE WHEN n.value IS NULL OR greatest(0, c.s + n.value - 20) >= 60 THEN 0 ELSE greatest(0, c.s + n.value - 20) END, n.value IS NOT NULL AND greatest(0, c.s + n.value - 20) >= 60 FROM c JOIN n ON n.user_id = c.user_id AND n.i = c.i + 1)
      SELECT user_id, ts, value, f::INT::DOUBLE AS alert FROM c""",
)
def stream_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.drain(online.cusum(_event_stream(spark, sf_dir), "user_id", "ts", "value", 20.0, 60.0), "append", "cusum").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
