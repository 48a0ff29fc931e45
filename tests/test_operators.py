"""Hand-made cases for joins, aggregates, names, graphs, models and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.operators import aggregates, changepoint, components, entities, events, graph, models, placebo, reconcile, rules, text
from eventscope.sources import readers
from eventscope.streaming import online


def d(s):
    return dt.date.fromisoformat(s)


def dim(spark, *rows):
    rows = rows or (("E", "external", d("2000-01-01"), d("2000-03-01"), d("2000-03-20"), d("2000-04-01"), d("2000-06-01")),)
    return spark.createDataFrame(list(rows), "event_key string, origin string, pre_start date, acute_start date, acute_peak date, acute_end date, post_end date")


def test_asof_ties_and_directions(spark):
    left = spark.createDataFrame([(d("2000-01-05"),), (d("1999-01-01"),), (d("2001-01-01"),)], "date date")
    right = spark.createDataFrame([(d("2000-01-03"), 1.0), (d("2000-01-07"), 2.0)], "date date, v double")
    got = {k: {r["date"].isoformat(): r["v"] for r in events.asof_join(left, right, "date", (), "v", k).collect()} for k in ("nearest", "backward", "forward")}
    assert got["nearest"] == {"2000-01-05": 2.0, "1999-01-01": 1.0, "2001-01-01": 2.0}
    assert got["backward"] == {"2000-01-05": 1.0, "1999-01-01": None, "2001-01-01": 2.0}
    assert got["forward"] == {"2000-01-05": 2.0, "1999-01-01": 1.0, "2001-01-01": None}


def test_event_metrics_without_a_pre_window(spark):
    panel = spark.createDataFrame([("a", d("2000-03-05"), 5.0, 2.0), ("a", d("2000-03-12"), 5.0, 1.0)], "k string, date date, l double, r double")
    row = events.event_metrics(panel.withColumns({"p": F.col("r"), "s": F.col("l") * 2}), dim(spark), ["k"], "l", "r", "p", "s").first()
    assert row["size_share"] == 0.5 and row["rate_change"] is None and row["days_to_recovery"] is None
    assert row["pre_level"] is None and row["scale_ratio"] is None and row["days_to_rise"] is None
    assert row["days_to_peak"] == 4  # the earliest of equal maxima


def test_asof_join_over_ranges_equals_brute_force(ranges):
    spark = ranges
    day = dt.date(2000, 1, 1)
    left = [(k, day + dt.timedelta(n)) for k in ("a", "b", None) for n in range(0, 90, 4)]
    right = [(k, day + dt.timedelta(n), float(n)) for k, ns in (("a", (3, 4, 30, 31, 77)), (None, (50,))) for n in ns]
    for way in ("nearest", "backward", "forward"):
        made = events.asof_join(spark.createDataFrame(left, "k string, date date"), spark.createDataFrame(right, "k string, date date, v double"), "date", ["k"], "v", way)
        got = {(r["k"], r["date"]): r["v"] for r in made.collect()}
        assert len(got) == len(left)
        for k, at in left:
            near = [(abs((x - at).days), -(x - at).days, v) for j, x, v in right if j == k and (way != "backward" or x <= at) and (way != "forward" or x >= at)]
            assert got[k, at] == (min(near)[2] if near else None)


def test_nearest_event_over_many_events(spark):
    days = spark.createDataFrame([(d("2000-01-01"),), (d("2000-01-06"),), (d("2000-02-01"),), (d("1990-01-01"),)], "date date")
    peaks = spark.createDataFrame([("x", d("2000-01-04")), ("b", d("2000-01-08")), ("a", d("2000-01-08"))], "event_key string, acute_peak date")
    got = {r["date"].isoformat(): (r["nearest_event"], r["gap_days"]) for r in events.nearest_event(days, peaks).collect()}
    assert got == {"2000-01-01": ("x", -3), "2000-01-06": ("a", -2), "2000-02-01": ("a", 24), "1990-01-01": ("x", -3655)}


def test_names_keep_words_that_begin_like_dropped_ones(spark):
    names = ["Mrs Jones", "Mrinal Sen", "Mr. Smith & Co.", "Messrs. A and B", "Messina Bros", "mess & sons", "Theodor Cole", "Commercial Discount Corporation", "Étude Mr Été", None, "Smith& Co"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(entities.normalize_name(F.col("n"))).collect()]
    assert got == ["mrs jones", "mrinal sen", "smith &", "a & b", "messina", "&", "theodor cole", "commerc disc corp", "étude été", "", "smith"]


def test_ordered_classifier_gives_confidence(spark):
    rules = [entities.Rule("gurney", "broker", 0.85), entities.Rule("bank", "bank", 0.4)]
    df = spark.createDataFrame([("Gurney Bank",), ("A Bank",), ("Smith",), ("  ",), (None,)], "n string")
    got = [tuple(r[0]) for r in df.select(entities.classify_ordered(F.col("n"), rules)).collect()]
    assert got == [("broker", 0.85), ("bank", 0.4), ("unknown", 0.2), ("unknown", 0.0), ("unknown", 0.0)]


def many_events(spark, n):
    at = lambda k, days: d("2000-01-02") + dt.timedelta(300 * k + days)
    return spark.createDataFrame([(f"e{k}", "x", at(k, 200), at(k, 280), at(k, 290), at(k, 300), at(k, 320)) for k in range(1, n + 1)], "event_key string, origin string, pre_start date, acute_start date, acute_peak date, acute_end date, post_end date")


def weekly(spark, n=330):
    r = np.random.default_rng(5)
    rows = [(k, d("2000-01-02") + dt.timedelta(7 * k), *(float(x) for x in r.normal(0, 1 + 2 * (k % 43 > 36), 2))) for k in range(n)]
    return spark.createDataFrame([*rows, (-1, d("2001-03-01"), None, 1.0)], "id long, date date, a double, b double")


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_forests_of_all_events_equal_single_ones(spark):
    df, table = weekly(spark), many_events(spark, 6)
    settings = {"trees": 30, "sample": 64, "seed": 3}
    made = models.isolation_backtest(df, table, "id", "date", ["a", "b"], weeks=12, least=60, **settings).collect()
    seen = {}
    for e in table.collect():
        start = e["acute_peak"] - dt.timedelta(84)
        train = events.exclude_windows(df.filter(F.col("date") < F.lit(start)), table, "date", F.col("acute_start"), F.col("acute_end")).dropna(subset=["a", "b"])
        if train.count() < 60:
            continue
        forest = models.fit_forest(train, "id", ["a", "b"], **settings)
        trained = [x["raw_score"] for x in models.score_forest(train, forest, ["a", "b"]).collect()]
        for x in models.score_forest(df.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(e["acute_peak"]))), forest, ["a", "b"]).collect():
            raw = x["raw_score"]
            score = None if raw is None else min(1.0, max(0.0, (raw - min(trained)) / (max(trained) - min(trained))))
            seen[e["event_key"], x["id"]] = raw, score, raw is not None and raw > np.quantile(trained, 0.95)
    assert len(made) == len(seen) and len({e for e, _ in seen}) >= 4
    for x in made:
        raw, score, anomaly = seen[x["event_key"], x["id"]]
        assert x["raw_score"] == (raw if raw is None else pytest.approx(raw)) and x["score"] == (score if score is None else pytest.approx(score)) and x["anomaly"] == anomaly
    assert models.isolation_backtest(df.limit(20), table, "id", "date", ["a", "b"]).collect() == []


def test_jobs_do_not_grow_with_events(spark):
    df = weekly(spark)
    forests = [jobs_of(spark, f"forests {n}", lambda n=n: models.isolation_backtest(df, many_events(spark, n), "id", "date", ["a", "b"], least=10, trees=5, sample=32).collect()) for n in (2, 6)]
    assert 0 < forests[1] <= forests[0] + 3  # adaptive execution may cut a query into a job more or less
    ready = df.dropna().select(F.array("a", "b").alias("x"), F.array(*[F.col("a") + F.pmod("id", F.lit(3)) > 1 for _ in range(3)]).alias("y"), F.array(*[F.pmod("id", F.lit(7)) == k for k in range(6)]).alias("tested")).cache()
    folds = [jobs_of(spark, f"folds {n}", lambda n=n: models.fit_folds(ready, [(e, h) for e in range(n) for h in range(3)], 2, 1.0)) for n in (1, 6)]
    assert 0 < folds[1] <= 2 * folds[0] and folds[1] < 60  # a few more Newton steps, not six times as many


def test_leave_one_event_out_equals_a_direct_fit(spark):
    """The coefficients of each fold make the gradient of its own penalised likelihood vanish."""
    from eventscope.operators import models

    rng = np.random.default_rng(1)
    peaks = [d("2001-03-01"), d("2003-03-01"), d("2005-03-01")]
    span = lambda p: (f"E{p.year}", p - dt.timedelta(400), p - dt.timedelta(20), p, p + dt.timedelta(20), p + dt.timedelta(300))
    table = spark.createDataFrame([span(p) for p in peaks], "event_key string, pre_start date, acute_start date, acute_peak date, acute_end date, post_end date")
    weeks = [d("2000-01-02") + dt.timedelta(7 * k) for k in range(330)]
    near = lambda t, h: any(t < p <= t + dt.timedelta(7 * h) for p in peaks)
    rows = [(t, float(rng.normal(near(t, 8), 1)), float(rng.normal()) if k % 50 else None) for k, t in enumerate(weeks)]
    scores, coefficients = models.loeo_logistic(spark.createDataFrame(rows, "date date, a double, b double"), table, "date", ["a", "b"])
    eligible = [(t, a, b) for t, a, b in rows if b is not None and not any(p - dt.timedelta(20) <= t <= p + dt.timedelta(84) for p in peaks)]
    got = scores.collect()
    assert len(got) == 6 * len(eligible)
    held = {(r["horizon"], r["fold"], r["feature"]): r["coefficient"] for r in coefficients.collect()}
    for h in (8, 12):
        for p in peaks:
            train = np.array([(a, b, near(t, h)) for t, a, b in eligible if not p - dt.timedelta(182) <= t <= p - dt.timedelta(1)], dtype=float)
            x, y = (train[:, :2] - train[:, :2].mean(0)) / train[:, :2].std(0), train[:, 2]
            mine = {r["date"]: r for r in got if r["horizon"] == h and r["fold"] == f"E{p.year}"}
            beta = np.array([held[h, f"E{p.year}", f] for f in "ab"])
            risk = np.array([mine[t]["score"] for t, a, b in eligible if not p - dt.timedelta(182) <= t <= p - dt.timedelta(1)])
            weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
            assert np.abs(x.T @ (weight * (risk - y)) + beta).max() < 0.5 and abs((weight * (risk - y)).sum()) < 0.5
            quiet = [r["score"] for t, r in mine.items() if not near(t, h)]
            assert next(iter(mine.values()))["threshold"] == pytest.approx(np.quantile(quiet, 1 - 10 / 520))
            assert all(r["alert"] == (r["score"] >= r["threshold"]) for r in mine.values())


def test_union_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 3.0)], "k int, b double")
    assert sorted(map(tuple, readers.union_sources(a, b).select("k", "a", "b").collect())) == [(1, "x", None), (2, None, 3.0)]


def varied_names(r, n):
    words = ["overend", "gurney", "overen", "smith", "smyth", "jones", "bank", "of", "london", "county", "discount", "a", "b", "cc", "brown", "browne", "shipley", "x1", "aaaa", "aaab"]
    first = ["overend", "overenda", "overe", "overend1", "a", "aa", "browns"]
    out = set()
    while len(out) < n:
        name = [r.choice(first), *r.choices(words, k=r.randrange(0, 5))]
        if r.random() < 0.5:
            k = r.randrange(len(name))
            w = list(name[k])
            w.insert(r.randrange(len(w) + 1), r.choice("abcdexyz"))
            name[k] = "".join(w)
        out.add(" ".join(name))
    return sorted(out)


@pytest.mark.parametrize("threshold", [80.0, 88.0, 95.0])
def test_similar_names_equal_brute_force(spark, threshold):
    import random

    names = varied_names(random.Random(int(threshold)), 260)
    df = spark.createDataFrame([(n,) for n in names], "normal string")
    block = lambda n: n.split()[0][:5]
    every = [(a, b, entities.token_set_score(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if block(a) == block(b)]
    want = sorted((a, b) for a, b, s in every if s >= threshold)
    assert sorted((x["a"], x["b"]) for x in entities.similarity_pairs(df, threshold).collect()) == want and want
    assert entities.candidate_pairs(df, threshold).count() < len(want) + (len(every) - len(want)) / 2


def test_a_large_block_does_not_meet_itself(spark):
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "qi", "ro", "su", "ta"]
    word = lambda k: "".join(syllables[(k * p + s) // 3 % 16] for p, s in ((1, 5), (7, 1), (31, 2), (5, 9)))
    names = [f"overend {word(k)} {word(3 * k + 7)}" for k in range(4_000)]
    df = spark.createDataFrame([(n,) for n in names], "normal string")
    assert entities.candidate_pairs(df, 88.0).count() < 0.02 * 4_000 * 4_000 / 2


def test_review_is_asked_against_the_canonical_name(spark):
    chain = ["Overend Gurney Partners", "Overend Gurnee Partner", "Overend Gurnee Partne", "Overend Gornee Partn"]
    score = lambda a, b: entities.token_set_score(a.lower(), b.lower())
    steps = [score(a, b) for a, b in zip(chain, chain[1:], strict=False)]
    assert min(steps) >= 88 and score(chain[-1], chain[0]) < 88  # the last is near its neighbour alone
    rows = {x["name"]: x for x in entities.resolve_entities(spark.createDataFrame([(n,) for n in [*chain, "Lone", "&", None]], "n string"), "n").collect()}
    assert {rows[n]["canonical"] for n in chain} == {chain[0]} and len(rows) == 6
    for n in chain:
        assert rows[n]["score"] == pytest.approx(100.0 if n == chain[0] else score(n, chain[0])) and rows[n]["review"] == (n != chain[0] and score(n, chain[0]) < 92)
    assert rows[chain[-1]]["review"] and (rows["Lone"]["method"], rows["Lone"]["score"], rows["Lone"]["review"]) == ("single", 100.0, False)


def test_unknown_labels_are_of_low_confidence(spark):
    rows = [("a", "E1", 5.0, 0.9, "bank"), ("b", "E1", 4.0, 0.9, "unknown"), ("c", "E2", 3.0, 0.3, "bank"), ("d", "E2", 2.0, None, "bank")]
    df = spark.createDataFrame(rows, "n string, e string, x double, c double, l string")
    low = lambda **k: {x["n"] for x in entities.validation_sample(df, "n", "e", "x", "c", **k).filter("stratum = 'low_confidence'").collect()}
    assert low() == {"c"} and low(label="l") == {"b", "c"}


def test_validation_sample_strata(spark):
    rows = [(f"n{k}", f"E{k % 3}", float(k), 0.3 if k % 5 == 0 else 0.9) for k in range(60)] + [("n59", "E0", 1000.0, 0.9)]
    df = spark.createDataFrame(rows, "name string, event string, amount double, sure double")
    got = [tuple(r) for r in entities.validation_sample(df, "name", "event", "amount", "sure", (5, 4, 6)).collect()]
    totals = {}
    for n, _, a, _ in rows:
        totals[n] = totals.get(n, 0) + a
    by = lambda s: [n for n, stratum, _ in got if stratum == s]
    assert by("top_by_volume") == sorted(totals, key=lambda n: (-totals[n], n))[:5]
    assert all(len(set(by(f"random_E{e}"))) == 4 and all((n, f"E{e}") in {(r[0], r[1]) for r in rows} for n in by(f"random_E{e}")) for e in range(3))
    assert len(by("low_confidence")) == 6 and all(int(n[1:]) % 5 == 0 for n in by("low_confidence"))
    assert all(t == totals[n] for n, _, t in got) and len(got) == len({g[:2] for g in got})


def test_extract_is_written_once(spark, tmp_path):
    from eventscope.sources import storage

    path = str(tmp_path / "extract")
    assert storage.extract(spark.range(3), path).count() == 3
    assert storage.extract(spark.range(9), path).count() == 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("k", start + dt.timedelta(days=n), 1.0) for n in range(60)], "k string, ts timestamp, x double")
    late = spark.createDataFrame([("k", start + dt.timedelta(days=n), 100.0) for n in (1, 58)], "k string, ts timestamp, x double")
    more = spark.createDataFrame([("k", start + dt.timedelta(days=59), 1.0)], "k string, ts timestamp, x double")
    counts = online.weekly_counts(online.replay_parts([first, more, late], "late-test", 1), "ts", "k", "x")
    query = counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert online.dropped_late(query) == 1
    assert spark.read.parquet(str(tmp_path / "out")).filter("total > 99").count() == 0  # the week of day 58 is still open


def test_count_within_keeps_empty_centers(spark):
    centers = spark.createDataFrame([(d("2000-01-01"),), (d("2005-01-01"),)], "center date")
    points = spark.createDataFrame([(d("2000-01-04"),), (d("1999-12-29"),), (d("2000-01-05"),)], "date date")
    got = {r["center"].year: r["n"] for r in events.count_within(centers, points, 3).collect()}
    assert got == {2000: 2, 2005: 0}


def test_concentration_guards(spark):
    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", -1.0), ("h", "a", 5.0)], "g string, p string, x double")
    got = {r["g"]: r for r in aggregates.concentration(df, ["g"], "p", "x").collect()}
    assert set(got) == {"h"} and got["h"]["hhi"] == 10000 and got["h"]["gini"] == 0
    zero = aggregates.concentration(df.filter("x = 0"), ["g"], "p", "x", positive_only=False).first()
    assert zero["hhi"] is None and zero["gini"] is None


def test_scorecard_propagates_nulls(spark):
    df = spark.createDataFrame([(2.0, None), (1.0, 0.5)], "a double, b double")
    got = [(r["s"], r["t"], r["score"]) for r in aggregates.scorecard(df, [("s", "a", 2, 1, True), ("t", "b", 0, 1, False)]).orderBy("a").collect()]
    assert got == [(1, 1, 2), (2, None, None)]


def test_placebo_centers_keep_away(spark):
    span = spark.createDataFrame([(d("1998-01-01"), d("2002-12-31"))], "lo date, hi date")
    got = placebo.placebo_centers(span, dim(spark), 365, 10, n=50)
    assert got.count() == 50 and got.filter(F.abs(F.datediff("center", F.lit(d("2000-03-20")))) <= 365).count() == 0
    assert sorted(got.collect()) == sorted(placebo.placebo_centers(span, dim(spark), 365, 10, n=50).collect())


def signal(spark, steps):
    """The rate signal of daily steps ``{days from the peak: value}``, as days from the peak."""
    peak, days = dim(spark).first()["acute_peak"], range(min(steps), 46)
    value = lambda k: steps[max(s for s in steps if s <= k)]
    rate = spark.createDataFrame([(peak + dt.timedelta(k), value(k)) for k in days], "date date, rate double")
    r = rules.rate_signal(rate, dim(spark)).first()
    at = lambda c: None if r[c] is None else (r[c] - peak).days
    assert r["sustained_lead"] == (None if at("sustained_start") is None else -at("sustained_start"))
    return at("run_up_start"), r["baseline"], r["peak_value"], at("peak_date"), at("sustained_start")


def test_rate_signal(spark):
    steps = {-300: 5.0, -250: 2.0, -100: 3.0, -50: 4.0, -30: 3.5, -10: 6.0}
    assert signal(spark, steps) == (-10, 2.0, 6.0, -10, -100)
    assert signal(spark, {**{-300: 7.0, -280: 5.0}, **{k: v for k, v in steps.items() if k > -300}}) == (-10, 2.0, 6.0, -10, -100)
    # back to the level before the first rise, not below it
    assert signal(spark, {-300: 2.0, -120: 3.0, -80: 2.0, -20: 4.0}) == (-20, 2.0, 4.0, -20, -120)
    # below it: the later rise counts
    assert signal(spark, {-300: 3.0, -120: 4.0, -100: 2.5, -20: 3.5, 10: 3.5, 20: 3.0}) == (-20, 3.0, 3.5, -20, -20)
    # a rise to below the baseline is none; no rise at all; a series that starts late has its own lowest value
    assert signal(spark, {-300: 5.0, -140: 2.0, -60: 3.0}) == (-60, 5.0, 3.0, -60, None)
    assert signal(spark, {-300: 5.0}) == (None, 5.0, 5.0, -90, None)
    assert signal(spark, {-100: 4.0, -50: 3.0, -5: 5.0}) == (-5, 3.0, 5.0, -5, -5)


def test_warning_summary_spans_and_forest(spark):
    peak = dim(spark).first()["acute_peak"]
    rows = [("a", peak - dt.timedelta(7 * k), float(s), z, None if z is None else -z) for k, s, z in [(12, 95, 1.0), (9, 50, 2.0), (7, 85, 3.0), (5, 90, None), (3, 70, 1.0), (0, 99, 9.0)]]
    scored = spark.createDataFrame([*rows, ("b", peak - dt.timedelta(70), None, None, None)], "series_id string, date date, score double, x double, y double")
    forest = spark.createDataFrame([("a", "X", peak - dt.timedelta(20), 0.4, False), ("a", "X", peak - dt.timedelta(13), 0.7, True), ("a", "X", peak - dt.timedelta(6), 0.6, True)], "series_id string, event_key string, date date, score double, anomaly boolean")
    forest = forest.withColumn("event_key", F.lit(dim(spark).first()["event_key"]))
    a, b = rules.warning_summary(scored, dim(spark), ["series_id"], "date", "score", ["x", "y"], forest=forest).orderBy("series_id").collect()
    assert [a[f"max_score_{w}w"] for w in (12, 8, 4)] == [95.0, 90.0, 70.0] and [a[f"weeks_before_{w}w"] for w in (12, 8, 4)] == [12, 7, None]
    assert a["top_components"] == "x=1.75, y=-1.75" and (a["max_forest_score"], a["first_forest_flag"], a["forest_status"]) == (0.7, peak - dt.timedelta(13), "ok")
    assert b["max_score_12w"] is None and b["top_components"] == "" and b["forest_status"] == "insufficient_training_data"


def test_names(spark):
    df = spark.createDataFrame([(" messrs. o'neil  and  co ",), (None,), ("SMITH-jones",)], "n string")
    got = [(r[0], r[1], r[2]) for r in df.select(entities.clean_name(F.col("n")), entities.normalize_name(F.col("n")), entities.block_key(entities.normalize_name(F.col("n")))).collect()]
    assert got == [("Messrs. O'Neil & Co", "o neil &", "o"), ("", "", None), ("Smith-Jones", "smith jones", "smith")]


def test_token_set_score():
    assert entities.token_set_score("baring sons london", "london baring") == 100
    assert entities.token_set_score("", "a") == 0
    assert entities.token_set_score("johnson", "jonson") == pytest.approx(200 * 6 / 13)


def test_resolution(spark):
    names = ["Overend Gurney & Co", "overend gurney", "Overend Gurny", "Bank of X", "", None]
    got = {r["name"]: r for r in entities.resolve_entities(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got["overend gurney"]["canonical"] == got["Overend Gurny"]["canonical"] == "Overend Gurney & Co"
    assert got["Bank of X"]["method"] == "single" and len(got) == 5


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and all(got[200 + i] == 100 for i in range(30))
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_path_graph_centralities(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    vertices = spark.createDataFrame([(v,) for v in "abcde"], "v string")
    between = {r["v"]: r["betweenness"] for r in graph.betweenness_centrality(edges, vertices, "v").collect()}
    assert between == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0, "e": 0})
    eigen = {r["v"]: r["eigenvector"] for r in graph.eigenvector_centrality(edges, vertices, "v").collect()}
    x = np.linalg.eigh(np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0]]))[1][:, -1]
    assert [eigen[v] for v in "abcd"] == pytest.approx(abs(x), abs=1e-4)
    assert {r["v"]: r["degree"] for r in graph.degree(edges, vertices, "v").collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 0}


def members_of(spark, most=30):
    """Random memberships: two classes of many members, members with sets of their own, one alone, one without a group."""
    r = np.random.default_rng(6)
    held = {f"big{k:03d}": {1, 2} for k in range(most)} | {f"old{k:03d}": {2, 3} for k in range(most)} | {f"m{k:02d}": {int(g) for g in r.choice(9, r.integers(1, 4), replace=False)} for k in range(25)}
    held |= {"alone": {77}, "none": {None}}
    rows = [(m, g) for m, of in held.items() for g in of] + [("big000", 1), (None, 1)]
    return held, spark.createDataFrame(rows, "m string, g int")


def edges_of(held):
    both = {(a, b): held[a] & held[b] - {None} for a in held for b in held if a < b}
    return {k: (len(v), ";".join(sorted(map(str, v)))) for k, v in both.items() if v}


def test_projection_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4, raising=False)
    held, df = members_of(spark)
    made = graph.project_bipartite(df, "m", "g").collect()
    assert {(r["src"], r["dst"]): (r["weight"], r["shared"]) for r in made} == edges_of(held) and len(made) == len(edges_of(held))


def test_projection_is_dealt_by_the_number_of_its_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4, raising=False)
    monkeypatch.setattr(graph, "TASK_EDGES", 50, raising=False)
    held, df = members_of(spark)
    made = graph.project_bipartite(df, "m", "g").groupBy(F.spark_partition_id()).count().collect()
    edges = len(edges_of(held))
    assert sum(r["count"] for r in made) == edges and max(r["count"] for r in made) <= 300 < edges / 4  # four shuffle partitions would hold more
    members = graph.classes(df, "m", "g")
    assert graph._edge_count(members, members.groupBy("class").agg(F.count("*").alias("size"))) == edges
    assert graph.project_bipartite(df.limit(0), "m", "g").count() == 0
    plan = graph.project_bipartite(df, "m", "g")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [x.strip(" :+-").split()[0] for x in plan if "Generate explode(" in x or "Repartition" in x]
    assert steps[:4] == ["Generate", "Repartition", "Generate", "RepartitionByExpression"]  # one compiled stage would hold a pair's edges at once


def test_membership_holds_every_supplier_and_month(spark, sf_dir):
    from eventscope.plans.fixtures import table, view

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    want = {(r[0], r[1]) for r in lines.select("s_name", (100 * F.year("l_shipdate") + F.month("l_shipdate")).cast("int")).distinct().collect()}
    got = [tuple(r) for r in view(spark, sf_dir, "membership").select("institution", "period").collect()]
    assert set(got) == want and len(got) == len(want)


def test_degrees_of_classes_equal_those_of_edges(spark):
    held, df = members_of(spark)
    want = {m: [0, 0] for m in [*held, None]}
    for (a, b), (weight, _) in edges_of(held).items():
        for v in (a, b):
            want[v] = [want[v][0] + 1, want[v][1] + weight]
    got = {r["m"]: [r["degree"], r["weighted_degree"]] for r in graph.projected_degree(df, "m", "g").collect()}
    assert got == want and got["alone"] == got["none"] == [0, 0]


def test_summary_of_degrees_equals_that_of_edges(spark, sf_dir):
    from eventscope.plans.catalog import QUERIES
    from eventscope.plans.fixtures import table

    held, df = members_of(spark, 5)
    ends = F.col("m").endswith("1")
    of_edges = graph.graph_summary(graph.project_bipartite(df, "m", "g"), df, "m", ends).first()
    assert graph.summary_of(graph.projected_degree(df, "m", "g"), "m", ends).first() == of_edges and of_edges["edges"] == len(edges_of(held))
    sellers = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey")).select("s_name").distinct().count()
    assert QUERIES["graph_summary"](spark, sf_dir).first()["nodes"] == sellers


def test_eigenvector_of_classes_equals_that_of_edges(spark):
    held, df = members_of(spark, 5)
    names = sorted(held)
    a = np.array([[0 if x == y else len(held[x] & held[y] - {None}) for y in names] for x in names])
    want = abs(np.linalg.eigh(a)[1][:, -1])
    got = {r["m"]: r["eigenvector"] for r in graph.projected_eigenvector(df, "m", "g").collect()}
    assert [got[m] for m in names] == pytest.approx(want, abs=1e-4) and got["none"] == got[None] == 0


def test_betweenness_has_no_most_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_EDGES", 5, raising=False)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 300, raising=False)
    near = np.triu(np.random.default_rng(2).random((14, 14)) < 0.2, 1)
    edges = spark.createDataFrame([(int(a), int(b), 1) for a, b in np.argwhere(near)], "src long, dst long, weight long")
    far, paths, step = np.where(np.eye(14), 0, -1), np.eye(14), np.eye(14)
    for k in range(1, 14):
        step = step @ (near | near.T)
        new = (far < 0) & (step > 0)
        far[new], paths[new] = k, step[new]
    through = lambda v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(14) for t in range(14) if len({s, t, v}) == 3 and min(far[s, t], far[s, v], far[v, t]) > 0 and far[s, v] + far[v, t] == far[s, t])
    got = {r["v"]: r["betweenness"] for r in graph.betweenness_centrality(edges, spark.range(14).withColumnRenamed("id", "v"), "v").collect()}
    assert got == pytest.approx({v: through(v) / (13 * 12) for v in range(14)})


def brute_betweenness(near):
    n = len(near)
    far, paths, step = np.where(np.eye(n), 0, -1), np.eye(n), np.eye(n)
    for k in range(1, n):
        step = step @ near
        new = (far < 0) & (step > 0)
        far[new], paths[new] = k, step[new]
    met = (far[:, :, None] > 0) & (far[:, None, :] > 0) & (far[None, :, :] > 0) & (far[:, :, None] + far[None, :, :] == far[:, None, :])  # s, v, t
    share = np.where(met, paths[:, :, None] * paths[None, :, :] / np.where(paths > 0, paths, 1)[:, None, :], 0)
    return share, share.sum((0, 2)) / ((n - 1) * (n - 2))


def chained_members(spark):
    """Classes of several members along a chain of groups, a dense part, a second component, one alone, some without a group or a name."""
    r = np.random.default_rng(8)
    held = {f"c{k}{j}": {k, k + 1} for k in range(5) for j in range(1 + k % 3)} | {f"d{k:02d}": {int(g) for g in r.choice(range(5, 9), 2, replace=False)} for k in range(14)}
    held |= {"x0": {20, 21}, "x1": {21, 22}, "x2": {22}, "x3": {20}, "alone": {77}, "none": {None}}
    near = np.array([[a != b and bool(held[a] & held[b] - {None}) for b in sorted(held)] for a in sorted(held)]).astype(float)
    return sorted(held), near, spark.createDataFrame([(m, g) for m, of in held.items() for g in of] + [("c00", 0), (None, 1)], "m string, g int")


def test_betweenness_of_classes_equals_that_of_members(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 4_000)
    names, near, df = chained_members(spark)
    share, _ = brute_betweenness(near)
    n = len(names) + 1  # the one without a name is a vertex, as in degree
    got = {r["m"]: r["betweenness"] for r in graph.projected_betweenness(df, "m", "g").collect()}
    assert got == pytest.approx(dict(zip([*names, None], [*share.sum((0, 2)) / ((n - 1) * (n - 2)), 0.0], strict=True))) and max(got.values()) > 0.1
    edges = graph.betweenness_centrality(graph.project_bipartite(df, "m", "g"), df, "m").collect()
    assert {r["m"]: r["betweenness"] for r in edges} == pytest.approx(got)


def test_betweenness_of_suppliers_writes_no_edge_of_them(spark, sf_dir, monkeypatch):
    from eventscope.plans.catalog import QUERIES

    monkeypatch.setattr(graph, "project_bipartite", lambda *_: pytest.fail("edges of members"))
    got = QUERIES["betweenness_centrality"](spark, sf_dir).collect()
    assert got and all(r["betweenness"] == 0 for r in got)  # all meet


def test_sampled_betweenness_of_classes_equals_that_of_edges(spark, sf_dir, monkeypatch):
    from eventscope.plans.catalog import QUERIES

    names, near, df = chained_members(spark)
    want = {r["m"]: (r["betweenness"], r["bound"]) for r in graph.betweenness_centrality(graph.project_bipartite(df, "m", "g"), df, "m", pivots=12).collect()}
    got = {r["m"]: (r["betweenness"], r["bound"]) for r in graph.projected_betweenness(df, "m", "g", pivots=12).collect()}
    first = [r["m"] for r in df.select("m").distinct().orderBy(F.xxhash64("m"), "m").limit(12).collect()]
    n = len(names) + 1
    share = brute_betweenness(near)[0][[names.index(m) for m in first if m is not None]].sum((0, 2)) * n / 12 / ((n - 1) * (n - 2))
    assert {m: b for m, (b, _) in got.items()} == pytest.approx(dict(zip([*names, None], [*share, 0.0], strict=True))) and max(share) > 0.1
    assert got == {m: (pytest.approx(b), bound) for m, (b, bound) in want.items()} and want["none"][1] > 0
    monkeypatch.setattr(graph, "project_bipartite", lambda *_: pytest.fail("edges of members"))
    assert QUERIES["betweenness_sampled"](spark, sf_dir).count() > 0


def test_searches_of_a_dense_graph_take_the_few_pairs_that_are_not_near(spark, monkeypatch):
    taken, written = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: taken.append(name) or written(df, name))
    near = np.ones((30, 30)) - np.eye(30)
    edges = lambda: spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(np.triu(near))], "src long, dst long")
    names = spark.range(30).withColumnRenamed("id", "v")
    assert {r["betweenness"] for r in graph.betweenness_centrality(edges(), names, "v").collect()} == {0.0} and taken.count("graph-level") == 2  # the sources and their neighbours
    near[3, 7] = near[7, 3] = near[3, 9] = near[9, 3] = near[11, 12] = near[12, 11] = 0
    got = {r["v"]: r["betweenness"] for r in graph.betweenness_centrality(edges(), names, "v").collect()}
    assert got == pytest.approx(dict(enumerate(brute_betweenness(near)[1]))) and taken.count("graph-level") == 5


def test_planted_step_is_found():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, 40), rng.normal(3, 0.1, 40)])
    for cost, penalty in (("rbf", 2.0), ("l2", 5.0)):
        assert changepoint.segment_ends(x, penalty, cost) == [40, 80]


def test_pruned_search_is_exact():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, 14), 2)

    def cost(s, t):
        return ((x[s:t] - x[s:t].mean()) ** 2).sum()

    best = {0: (-1.0, [])}
    for t in range(2, 15):
        best[t] = min((best[s][0] + cost(s, t) + 1.0, best[s][1] + [t]) for s in best if t - s >= 2)
    assert changepoint.segment_ends(x, 1.0, "l2") == best[14][1]


def test_short_series_have_no_change_points(spark):
    df = spark.createDataFrame([("a", d("2000-01-01") + dt.timedelta(i), float(i)) for i in range(29)], "k string, date date, x double")
    assert changepoint.change_points(df, ["k"], "date", "x").count() == 0


def test_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))] + [(1000, 9.0, 9.0), (1001, -9.0, 8.0), (1002, None, 1.0)]
    made = models.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=60, sample=128, contamination=0.05)
    top = [r["id"] for r in made.orderBy(F.col("score").desc_nulls_last()).limit(2).collect()]
    assert set(top) == {1000, 1001}
    assert abs(made.filter("anomaly").count() - 15) <= 2 and made.filter("id = 1002 and score is null and not anomaly").count() == 1


def test_lenient_json(spark):
    rows = [('```json\n{"a": 1}\n```',), ('here: {"a": 2} end',), ('{"a": ',), (None,)]
    got = spark.createDataFrame(rows, "t string").select(reconcile.parse_json_lenient(F.col("t"), "a int").alias("r")).select("r.a").collect()
    assert [r[0] for r in got] == [1, 2, None, None]
    bad = spark.createDataFrame(rows, "t string").select(reconcile.parse_json_lenient(F.col("t"), "a int").alias("r")).select("r._bad").collect()
    assert [r[0] for r in bad] == [None, None, '{"a": ', None]


def test_match_tuple_clause_and_null_text(spark):
    df = spark.createDataFrame([(1, "Panic in the Bank"), (2, "panic"), (3, None)], "id long, text string")
    got = text.match_clauses(df, {"both": ("panic", "bank"), "any": "panic"}).select("id", "labels").orderBy("id").collect()
    assert [(r[0], r[1]) for r in got] == [(1, ["both", "any"]), (2, ["any"])]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Series notes\n\nDATE,X\n01 JAN 2000,1.5\n02 JAN 2000,2\n")
    got = readers.read_csv_with_preamble(spark, str(tmp_path / "a.csv"), "DATE,", "d string, x double").collect()
    assert [(r.d, r.x) for r in got] == [("01 JAN 2000", 1.5), ("02 JAN 2000", 2.0)]
    stamp = -3_000_000_000  # 1874 in seconds
    for unit, factor in (("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)):
        df = spark.createDataFrame([(stamp * factor,), (stamp * factor + factor,)], "t long")
        assert readers.infer_epoch_unit(df, "t")[0] == unit
    both = readers.union_sources(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string"))
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, "x")]
    named = readers.select_by_header_keyword(spark.createDataFrame([(1, 2)], "`Real GDP (m)` int, year int"), {"gdp": "gdp", "cpi": "cpi"})
    assert named.columns == ["gdp"]
    assert readers.keep_dated_rows(spark.createDataFrame([("Date",), ("2000-01-01",), (None,)], "d string"), "d").count() == 1
    readers.write_table(spark.createDataFrame([(1, ["a", "b"])], "k int, xs array<string>"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["xs"] == "a;b"
    assert readers.file_inventory(spark, str(tmp_path / "a.csv")).first()["bytes"] == (tmp_path / "a.csv").stat().st_size


def test_scan_windows_pushes_ranges(spark, tmp_path):
    rows = [(d("2000-01-01") + dt.timedelta(30 * i), i, i) for i in range(24)]
    spark.createDataFrame(rows, "date date, a int, b int").write.parquet(str(tmp_path / "t"))
    df = readers.scan_windows(spark, str(tmp_path / "t"), [("2000-02-01", "2000-03-31"), ("2001-06-01", "2001-07-31")], ["date", "a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "b#" not in plan
    assert df.count() == sum(d("2000-02-01") <= r[0] <= d("2000-03-31") or d("2001-06-01") <= r[0] <= d("2001-07-31") for r in rows)


def split_stream(spark, tmp_path, df, day):
    """The rows in one file per day, oldest first, as a stream of one file per batch."""
    import os
    import time

    for k, v in enumerate(sorted(r[0] for r in df.select(day).distinct().collect())):
        df.filter(day == F.lit(v)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.name not in seen(tmp_path):
                os.utime(f, (time.time() - 10_000 + 10 * k,) * 2)
                seen(tmp_path).add(f.name)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


_SEEN: dict = {}


def seen(path):
    return _SEEN.setdefault(path, set())


@pytest.fixture
def ticks(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 2}", start + dt.timedelta(hours=7 * i), None if i % 11 == 5 else float((i * 13) % 7)) for i in range(40)]
    return spark.createDataFrame(rows, "k string, ts timestamp, x double")


def test_streams_equal_their_batch_twins(spark, tmp_path, ticks):
    from eventscope.functions import timeseries as ts

    day = F.to_date("ts")
    stream = split_stream(spark, tmp_path, ticks, day)
    pairs = [
        (online.past_z(stream, "k", "ts", "x", 5), ticks.select("k", "ts", "x", ts.past_z("x", ["k"], "ts", 5).alias("z")), "z"),
        (online.ewma(stream, "k", "ts", "x", 0.3), ts.ewma(ticks, ["k"], "ts", "x", 0.3), "ewma"),
        (online.cusum(stream, "k", "ts", "x", 2.0, 4.0), ts.cusum(ticks, ["k"], "ts", "x", 2.0, 4.0), "alert"),
    ]
    for made, twin, name in pairs:
        got = {(r["k"], r["ts"]): r[name] for r in online.drain(made, "append", name).collect()}
        want = {(r["k"], r["ts"]): r[name] for r in twin.collect()}
        assert got.keys() == want.keys()
        for key, value in want.items():
            assert got[key] == (None if value is None else pytest.approx(value)) or (value is None and got[key] is not None and math.isnan(got[key]))


def test_stream_persistence_and_markers(spark, tmp_path, ticks):
    stream = split_stream(spark, tmp_path, ticks, F.to_date("ts"))
    alerts = online.drain(online.persistence(stream, "k", "ts", "x", 4.0, 2, 3), "append", "p")
    assert alerts.count() == ticks.count() and alerts.filter("alert = 1").count() > 0


def shuffled_stream(spark, df, parts, days):
    """Parts of ``df`` by a hash of its rows, so that times go to and fro, and a row that closes them all."""
    at = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    return online.replay_parts([*[df.filter(at == k) for k in range(parts)], online.closing_row(df, "ts", days)], "shuffled", files=1)


def test_streams_with_late_rows_equal_their_batch_twins(spark, ticks):
    from eventscope.functions import timeseries as ts

    stream = lambda: shuffled_stream(spark, ticks, 4, 90)
    pairs = [
        (online.past_z(stream(), "k", "ts", "x", 5, late="30 days"), ticks.select("k", "ts", "x", ts.past_z("x", ["k"], "ts", 5).alias("z")), "z"),
        (online.ewma(stream(), "k", "ts", "x", 0.3, late="30 days"), ts.ewma(ticks, ["k"], "ts", "x", 0.3), "ewma"),
        (online.cusum(stream(), "k", "ts", "x", 2.0, 4.0, late="30 days"), ts.cusum(ticks, ["k"], "ts", "x", 2.0, 4.0), "alert"),
    ]
    for made, twin, name in pairs:
        number = lambda v: None if v is None or math.isnan(v) else pytest.approx(v)
        got = {(r["k"], r["ts"]): r[name] for r in online.drain(made, "append", name).collect()}
        want = {(r["k"], r["ts"]): number(r[name]) for r in twin.collect()}
        assert {k: v if v is None or not math.isnan(v) else None for k, v in got.items()} == want


STREAMS = {
    "ewma": lambda s: online.ewma(s, "k", "ts", "x", 0.3),
    "persistence": lambda s: online.persistence(s, "k", "ts", "x", 4.0, 2, 4),
    "past_z": lambda s: online.past_z(s, "k", "ts", "x", 5),
    "late": lambda s: online.ewma(s, "k", "ts", "x", 0.3, late="30 days"),
    "cusum": lambda s: online.cusum(s, "k", "ts", "x", 2.0, 4.0),
}


@pytest.mark.parametrize("name", STREAMS)
def test_many_keys_are_few_calls_with_the_results_of_single_keys(spark, monkeypatch, tmp_path, name):
    """A bucket of keys is one row of state; 40 keys, one of them null, in three buckets give what each key gives by itself."""
    monkeypatch.setattr(online, "BUCKETS", 3, raising=False)
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [(k or None, at(7 * i + k), None if (i + k) % 9 == 5 else float((i * 13 + k) % 11)) for k in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, x double")
    stream = online.replay(df, "ts", "many", batches=3, files=1) if name != "late" else shuffled_stream(spark, df, 3, 90)
    query = STREAMS[name](stream).writeStream.outputMode("append").format("memory").queryName(f"many_{name}").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3
    number = lambda v: None if v is None or math.isnan(v) else v
    got = {}
    for k, t, _, y in sorted(map(tuple, spark.table(f"many_{name}").collect()), key=lambda r: (r[0] or 0, r[1])):
        got.setdefault(k, []).append((t, number(y)))
    assert {k: len(v) for k, v in got.items()} == {k or None: 12 for k in range(40)}
    for k in (None, 1, 17, 39):
        alone = online.drain(STREAMS[name](online.replay_parts([df.filter(F.col("k").eqNullSafe(k)), online.closing_row(df, "ts", 90)], "one", files=1)), "append", "one")
        assert got[k] == [(t, number(y)) for _, t, _, y in sorted(map(tuple, alone.filter(F.col("ts") < at(1000)).collect()), key=lambda r: r[1])][:12]


@pytest.mark.parametrize("name", ["stream_persistence", "stream_past_z", "stream_ewma_late", "stream_cusum"])
def test_streams_have_few_partitions_of_state(spark, sf_dir, name):
    """State in 2 partitions a core however many a shuffle has, rows of three columns in the replayed files, and all rows."""
    from pathlib import Path

    from eventscope.plans.catalog import QUERIES
    from eventscope.sources import storage

    before, mark = spark.conf.get("spark.sql.shuffle.partitions"), storage.written()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        made = QUERIES[name](spark, sf_dir)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    replayed, drained = (Path(p.removeprefix("file:")) for p in storage._written[mark:])
    assert sum(p.name.isdigit() for p in (drained / "state/state/0").iterdir()) == max(16, 2 * spark.sparkContext.defaultParallelism)
    assert set(spark.read.option("recursiveFileLookup", "true").parquet(str(replayed)).columns) == {"user_id", "ts", "value"}
    assert made.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def small_events(spark, tmp_path, days: list[float | None]):
    """An events table of one user with a row at each of the given days, None without a time."""
    at = lambda n: None if n is None else dt.datetime(2024, 1, 20) + dt.timedelta(days=n)
    rows = [(i, at(n), 1, float((i * 13) % 37)) for i, n in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def in_sql(sf: str, name: str) -> list[tuple]:
    import duckdb

    from eventscope.plans.oracles import ORACLE_SQL

    con = duckdb.connect(config={"threads": 2})
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{sf}/events.parquet/*.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall()


def by_time(rows: list) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: (r[1] is None, r[1] or dt.datetime.min))


@pytest.mark.parametrize("name", ["stream_past_z", "stream_cusum", "stream_ewma", "stream_persistence"])
def test_small_parts_and_rows_without_a_time_are_replayed_whole_and_in_order(spark, tmp_path, name):
    """Parts of fewer rows than files are still a micro-batch each; the row without a time comes last."""
    from eventscope.plans.catalog import QUERIES

    sf = small_events(spark, tmp_path, [5, 2, 8, 1, None, 4, 7, 3, 6, 0, 9, 10, 11])
    events = spark.read.parquet(f"{sf}/events.parquet")
    seen_in = []
    stream = online.replay(events.select("user_id", "ts", "value"), "ts", "few")
    query = stream.writeStream.foreachBatch(lambda df, _: seen_in.append(sorted((r.ts for r in df.collect()), key=lambda t: (t is None, t or dt.datetime.min)))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [t for part in seen_in for t in part] == [dt.datetime(2024, 1, 20) + dt.timedelta(days=n) for n in range(12)] + [None]
    assert len(seen_in) == 4
    assert by_time(QUERIES[name](spark, sf).collect()) == by_time(in_sql(sf, name))


def test_late_rows_of_a_table_of_many_months_are_all_taken(spark, tmp_path):
    """Spans of a table longer than a month are in order of time, and the watermark waits for a whole one."""
    from eventscope.plans.catalog import QUERIES

    sf = small_events(spark, tmp_path, [(i * 7) % 200 for i in range(200)])
    got = by_time(QUERIES["stream_ewma_late"](spark, sf).collect())
    assert got == by_time(in_sql(sf, "stream_ewma_late")) and len(got) == 200


def test_files_of_a_micro_batch_grow_with_the_rows():
    assert [online.files_for(n, 4) for n in (0, 100_000, 6_000_000, 36_000_000)] == [4, 4, 6, 36]


def test_rows_later_than_the_watermark_are_dropped_and_idle_keys_start_anew(spark):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    frame = lambda *rows: spark.createDataFrame([(k, at(n), float(v)) for k, n, v in rows], "k string, ts timestamp, x double")
    parts = [frame(("a", 1, 1), ("a", 0, 3)), frame(("a", 3, 5), ("b", 3, 1)), frame(("a", 4, 2), ("a", 0, 100)), frame(("b", 40, 9)), frame(("a", 60, 8)), frame(("b", 99, 0))]
    made = online.drain(online.ewma(online.replay_parts(parts, "idle", files=1), "k", "ts", "x", 0.5, late="1 day", idle_days=20), "append", "idle")
    got = {(r["k"], (r["ts"] - at(0)).days): r["ewma"] for r in made.collect()}
    # day 0 comes before day 1 though it arrived after; its second row is later than the watermark; a and b start anew
    assert got == {("a", 0): 3.0, ("a", 1): 2.0, ("a", 3): 3.5, ("a", 4): 2.75, ("b", 3): 1.0, ("b", 40): 9.0, ("a", 60): 8.0}


def test_first_mentions_of_a_shuffled_stream(spark):
    rows = [(i, f"m{i % 5}" if i % 9 else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=(i * 7) % 31)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    found = online.drain(online.first_mentions(shuffled_stream(spark, df, 5, 90), F.col("id") % 4 != 0, F.lit(True), "k", "ts", "id", "40 days"), "append", "m")
    want = {}
    for i, k, t in rows:
        if k and i % 4:
            want[k] = min(want.get(k, (t, i)), (t, i))
    assert {r["k"]: (r["ts"], r["id"]) for r in found.collect()} == want and found.count() == 5


def test_sampled_betweenness_is_within_its_bound(spark):
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(a, int(b), 1) for a in range(40) for b in rng.choice(40, 3, replace=False) if a != b], "src long, dst long, weight long")
    vertices = spark.range(42).withColumnRenamed("id", "v")
    exact = {r["v"]: r["betweenness"] for r in graph.betweenness_centrality(edges, vertices, "v").collect()}
    every = graph.betweenness_centrality(edges, vertices, "v", pivots=1_000).collect()
    assert {r["v"]: (r["betweenness"], r["bound"]) for r in every} == {v: (pytest.approx(b), 0.0) for v, b in exact.items()}
    some = graph.betweenness_centrality(edges, vertices, "v", pivots=20).collect()
    assert len(some) == 42 and 0 < some[0]["bound"] < 0.5 and all(abs(r["betweenness"] - exact[r["v"]]) <= r["bound"] for r in some)
    assert any(r["betweenness"] != pytest.approx(exact[r["v"]]) for r in some)


def test_a_failed_shard_is_skipped(spark, tmp_path):
    df = spark.createDataFrame([(k, d("2000-01-01") + dt.timedelta(k)) for k in range(40)], "k int, date date")
    df.repartition(4).write.parquet(str(tmp_path / "shards"))
    whole = sorted((tmp_path / "shards").glob("*.parquet"))
    assert readers.scan_windows(spark, str(tmp_path / "shards"), [("2000-01-01", "2001-01-01")], ["k"]).count() == 40
    lost = spark.read.parquet(str(whole[-1])).count()
    whole[-1].write_bytes(b"PAR1 this is no table PAR1")
    (tmp_path / "shards" / f".{whole[-1].name}.crc").unlink(missing_ok=True)
    assert lost and readers.scan_windows(spark, str(tmp_path / "shards"), [("2000-01-01", "2001-01-01")], ["k"]).count() == 40 - lost
