"""Joins and selections that are dealt to ranges and buckets: results by brute force, and plans without all pairs."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.functions import blocks
from eventscope.operators import aggregates, events, placebo

DAY = dt.date(2000, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows(r, n=80):
    rows = [(f"e{k}", DAY + dt.timedelta(a), DAY + dt.timedelta(a + r.choice([0, 3, 10, 200]))) for k in range(n) for a in [r.randrange(-50, 400)]]
    return [*rows, ("null", None, DAY), ("turned", DAY + dt.timedelta(9), DAY)]


@pytest.mark.parametrize("most", [10_000, 5])
def test_range_joins_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(events, "BROADCAST_EVENTS", most)
    r = random.Random(most)
    held = windows(r)
    rows = [(k, DAY + dt.timedelta(r.randrange(-80, 450))) for k in range(300)] + [(-1, None), (-2, DAY), (-2, DAY)]
    df, dim = spark.createDataFrame(rows, "id long, date date"), spark.createDataFrame(held, "event_key string, lo date, hi date")
    hits = [(i, e) for i, at in rows for e, lo, hi in held if at and lo and lo <= at <= hi]
    met = events.range_join(df, dim, "date", F.col("lo"), F.col("hi"))
    assert sorted((x["id"], x["event_key"]) for x in met.collect()) == sorted(hits) and met.columns == ["id", "date", "event_key", "lo", "hi"]
    inside = {i for i, _ in hits}
    semi = events.range_join(df, dim, "date", F.col("lo"), F.col("hi"), "left_semi")
    anti = events.range_join(df, dim, "date", F.col("lo"), F.col("hi"), "left_anti")
    assert sorted(x["id"] for x in semi.collect()) == sorted(i for i, _ in rows if i in inside)
    assert sorted(x["id"] for x in anti.collect()) == sorted(i for i, _ in rows if i not in inside)
    if most < 10_000:
        assert all(word not in plan_of(x) for x in (met, semi, anti) for word in ("NestedLoop", "Cartesian"))


def test_windows_and_labels_of_many_events(spark, monkeypatch):
    """The joins of the library give the same by buckets as by broadcast, and no plan compares all pairs."""
    day = lambda n: DAY + dt.timedelta(n)
    dim = spark.createDataFrame([(f"e{k}", "x", day(9 * k), day(9 * k + 20), day(9 * k + 25), day(9 * k + 30), day(9 * k + 60)) for k in range(40)], "event_key string, origin string, pre_start date, acute_start date, acute_peak date, acute_end date, post_end date")
    df = spark.createDataFrame([(k, day(3 * k - 100)) for k in range(250)], "id long, date date")
    made = lambda: {
        "phase": events.tag_phase(df, dim).select("id", "event_key", "phase"), "pre": events.pre_window(df, dim, 4).select("id", "event_key"), "quiet": events.quiet(df, dim, 20).select("id"),
        "post": events.exclude_post(df, dim, 1).select("id"), "label": events.label_within(df, dim, 2).select("id", "label"), "name": events.interval_lookup(df, dim, "date", "acute_start", "acute_end", "event_key").select("id", "event_key"),
        "last": events.last_in_interval(df, dim, "date", "acute_start", "acute_end", "event_key", "id"),
    }
    small = {k: sorted(x.collect(), key=str) for k, x in made().items()}
    monkeypatch.setattr(events, "BROADCAST_EVENTS", 3)
    large = made()
    assert {k: sorted(x.collect(), key=str) for k, x in large.items()} == small and all(small.values())
    assert all(word not in plan_of(x) for x in large.values() for word in ("NestedLoop", "Cartesian"))


def test_a_hundred_thousand_events(spark):
    dim = spark.range(100_000).select(F.col("id").alias("event_key"), F.date_add(F.lit(DAY), (F.col("id") % 9_000).cast("int")).alias("pre_start"))
    dim = dim.withColumn("post_end", F.date_add("pre_start", (F.col("event_key") % 5).cast("int")))
    df = spark.range(2_000).select("id", F.date_add(F.lit(DAY), (F.col("id") * 7 % 9_100).cast("int")).alias("date"))
    met = events.window_join(df, dim)
    assert all(word not in plan_of(met) for word in ("NestedLoop", "Cartesian"))
    starts = np.bincount([k % 9_000 * 5 + k % 5 for k in range(100_000)], minlength=45_000).reshape(9_000, 5)
    want = sum(int(starts[a, n]) for i in range(2_000) for n in range(5) for a in range(i * 7 % 9_100 - n, i * 7 % 9_100 + 1) if 0 <= a < 9_000)
    assert met.count() == want


def test_asof_of_one_heavy_key(ranges):
    """A key that holds all rows is dealt over the ranges, borders included."""
    left = ranges.range(3_000).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    right = ranges.createDataFrame([("k", DAY + dt.timedelta(n), float(n)) for n in (5, 900, 901, 2_500)], "k string, date date, v double")
    at = lambda way: {(x["date"] - DAY).days: x["v"] for x in events.asof_join(left, right, "date", ["k"], "v", way).collect()}
    back, ahead = at("backward"), at("forward")
    assert [back[n] for n in (0, 5, 899, 900, 2_499, 2_999)] == [None, 5.0, 5.0, 900.0, 901.0, 2500.0]
    assert [ahead[n] for n in (0, 6, 902, 2_500, 2_501)] == [5.0, 900.0, 2500.0, 2500.0, None] and len(back) == len(ahead) == 3_000
    sides = blocks.dealt(left, ["k", "date"], "sides").groupBy(blocks.RANGE).count().collect()
    assert len(sides) >= 8 and max(x["count"] for x in sides) < 1_000


def test_asof_with_repeated_dates_and_none(ranges):
    left = ranges.createDataFrame([(1, DAY), (2, DAY), (3, None)], "id long, date date")
    right = ranges.createDataFrame([(DAY, 1.0), (DAY, 2.0), (None, 9.0)], "date date, v double")
    for way in ("nearest", "backward", "forward"):
        assert {x["id"]: x["v"] for x in events.asof_join(left, right, "date", (), "v", way).collect()} == {1: 2.0, 2: 2.0, 3: None}


def numbers(r):
    groups = {"a": r.normal(0, 1, 700), "b": np.repeat([1.0, 2.0], 150), None: r.integers(0, 9, 41).astype(float), "one": np.array([4.0]), "none": np.array([])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None), ("none", None)]
    return groups, rows


def test_quantiles_over_ranges_equal_numpy(ranges):
    groups, rows = numbers(np.random.default_rng(2))
    points = [0.0, 0.1, 0.5, 0.95, 1.0]
    df = ranges.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: [x[f"q{round(100 * p)}"] for p in points] for x in aggregates.quantiles(df, ["g"], "x", points).collect()}
    assert got == {k: pytest.approx(np.quantile(v, points)) if len(v) else [None] * 5 for k, v in groups.items()}
    assert aggregates.quantiles(df.limit(0), ["g"], "x", points).collect() == []


def test_stacked_medians_over_ranges(ranges):
    groups, rows = numbers(np.random.default_rng(3))
    df = ranges.createDataFrame([(k, i % 2, v) for i, (k, v) in enumerate(rows)], "g string, h int, x double")
    made = aggregates.grouped_medians(df, [["g"], ["g", "h"], []], "x").collect()
    assert len(made) == 5 + len({(k, i % 2) for i, (k, _) in enumerate(rows)}) + 1
    every = [v for _, v in rows if v is not None]
    whole = [x for x in made if x["n"] == len(every)]
    assert len(whole) == 1 and whole[0]["median"] == pytest.approx(np.median(every)) and whole[0]["mean"] == pytest.approx(np.mean(every))
    by = {x["g"]: (x["median"], x["n"]) for x in made if x["h"] is None and x["n"] < len(every)}
    assert by["a"] == (pytest.approx(np.median(groups["a"])), 700) and by["none"] == (None, 0) and by[None][1] == 41


def test_placebo_percentiles_in_one_order(ranges):
    r = np.random.default_rng(4)
    placebos, values = [*r.integers(0, 40, 300).astype(float).tolist(), None], [-1.0, 0.0, 7.0, 7.0, 12.5, 99.0, None]
    made = placebo.placebo_compare(ranges.createDataFrame([(v,) for v in values], "x double"), ranges.createDataFrame([(v,) for v in placebos], "x double"), "x")
    held = [v for v in placebos if v is not None]
    rows = made.collect()
    assert sorted(str(x["x"]) for x in rows) == sorted(map(str, values))
    for x in rows:
        assert x["percentile"] == (None if x["x"] is None else pytest.approx(100 * sum(p <= x["x"] for p in held) / len(held)))
    assert rows[0]["placebo_p95"] == pytest.approx(np.quantile(held, 0.95))
    # nested loops join one row of statistics, without a condition
    assert not re.search("NestedLoopJoin.*<=", plan_of(made)) and "Cartesian" not in plan_of(made)
    none = placebo.placebo_compare(ranges.createDataFrame([(1.0,)], "x double"), ranges.createDataFrame([], "x double"), "x").first()
    assert none["percentile"] is None and none["n_placebo"] == 0 and none["placebo_p95"] is None


def splits(x, penalty, least=2):
    """Binary segmentation by plain recursion: ends of segments with their gains."""
    cost = lambda part: float(((part - part.mean()) ** 2).sum())

    def inside(a, b):
        best = max(((cost(x[a:b]) - cost(x[a:c]) - cost(x[c:b]), -c) for c in range(a + least, b - least + 1)), default=None)
        if best is None or best[0] <= penalty:
            return []
        return [*inside(a, -best[1]), (-best[1], best[0]), *inside(-best[1], b)]

    return inside(0, len(x))


def test_mean_shifts_equal_brute_force(ranges):
    r = np.random.default_rng(8)
    series = {"a": np.concatenate([r.normal(m, 0.5, 60) for m in (0, 5, 5.5, -3, 100)]), "b": r.normal(0, 1, 80), None: np.concatenate([np.zeros(20), np.ones(20)]), "short": np.arange(20.0), "flat": np.full(40, 7.0)}
    rows = [(k, DAY + dt.timedelta(2 * i), float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("b", DAY + dt.timedelta(1), None), ("b", DAY + dt.timedelta(3), float("nan"))]
    from eventscope.operators import changepoint

    made = changepoint.mean_shifts(ranges.createDataFrame(rows, "k string, date date, x double"), ["k"], "date", "x", 3.0).collect()
    for k, x in series.items():
        want = [(DAY + dt.timedelta(2 * (c - 1)), gain) for c, gain in (splits(x, 3.0) if len(x) >= 30 else [])]
        got = sorted((m["date"], m["gain"]) for m in made if m["k"] == k)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert changepoint.mean_shifts(ranges.createDataFrame([], "k string, date date, x double"), ["k"], "date", "x", 3.0).collect() == []


def test_mean_shifts_of_a_long_series(spark):
    """300,000 points without keys, with three shifts."""
    from eventscope.operators import changepoint

    at = F.col("id")
    level = F.when(at < 100_000, 0.0).when(at < 150_000, 3.0).when(at < 290_000, 1.0).otherwise(8.0)
    df = spark.range(300_000).select(at.alias("t"), (level + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"))
    made = changepoint.mean_shifts(df, [], "t", "x", 1_000.0).collect()
    assert sorted(m["t"] for m in made) == [99_999, 149_999, 289_999]
