"""Hand-made series: gaps, ties, short histories, constants; nothing looks ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.functions import timeseries as ts
from eventscope.functions.blocks import dominance

DAY = dt.date(2000, 1, 2)


def frame(spark, values, key="a"):
    rows = [(key, DAY + dt.timedelta(7 * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, date date, x double")


def column(df, expr):
    return [r[0] for r in df.select("date", expr.alias("y")).orderBy("date").select("y").collect()]


def ranked(df):
    return [r["pct_rank"] for r in ts.past_pct_rank(df, "x", ["k"], "date").orderBy("date").collect()]


def test_diff_and_delay(spark):
    df = frame(spark, [1, 2, 4, 7])
    assert column(df, ts.diff("x", ["k"], "date", 1)) == [None, 1, 2, 3]
    assert column(df, ts.diff("x", ["k"], "date", 1, delay=1)) == [None, None, 1, 2]
    assert column(df, ts.pct_change("x", ["k"], "date", 2)) == [None, None, 3.0, 2.5]


def test_pct_change_of_zero_base_is_null(spark):
    assert column(frame(spark, [0, 5]), ts.pct_change("x", ["k"], "date")) == [None, None]


def test_past_z_needs_periods_and_spread(spark):
    assert column(frame(spark, [1] * 60), ts.past_z("x", ["k"], "date"))[-1] is None
    z = column(frame(spark, [*range(53), 100]), ts.past_z("x", ["k"], "date"))
    assert z[51] is None and z[52] is not None


def test_rank_gates_and_nulls(spark):
    values = [float(i) for i in range(60)]
    values[3] = values[10] = None
    ranks = ranked(frame(spark, values))
    assert ranks[53] is None and ranks[54] == 100.0  # 52 earlier values are there from place 54
    assert all(r is None or 0 <= r <= 100 for r in ranks)


def test_rank_equals_brute_force_over_several_series(spark):
    values = {k: [(i * m) % 23 if i % 9 else None for i in range(90)] for k, m in (("a", 37), ("b", 5))}
    df = frame(spark, values["a"]).unionByName(frame(spark, values["b"], "b")).withColumn("other", F.lit("kept")).repartition(3)
    got = ts.past_pct_rank(df, "x", ["k"], "date", 10, "y").orderBy("k", "date").collect()
    assert all(r["other"] == "kept" for r in got)
    for k, series in values.items():
        want = []
        for i, v in enumerate(series):
            seen = [e for e in series[:i] if e is not None]
            want.append(100 * sum(e <= v for e in seen) / len(seen) if v is not None and i >= 10 and len(seen) >= 10 else None)
        assert [r["y"] for r in got if r["k"] == k] == pytest.approx(want)


def test_past_features_do_not_look_ahead(spark):
    base = [float((i * 31) % 17) for i in range(80)]
    other = base[:60] + [999.0] * 20
    for f in (ts.past_z, ts.past_mean):
        assert column(frame(spark, base), f("x", ["k"], "date"))[:60] == column(frame(spark, other), f("x", ["k"], "date"))[:60]
    assert ranked(frame(spark, base))[:60] == ranked(frame(spark, other))[:60]


def test_constant_series_has_no_robust_z(spark):
    out = ts.robust_z(frame(spark, [3] * 40), "x", ["k"], "date").select("robust_z").distinct().collect()
    assert [r[0] for r in out] == [None]


def test_ewma_carries_over_gaps(spark):
    out = ts.ewma(frame(spark, [None, 1, None, 3]), ["k"], "date", "x", 0.5).orderBy("date").select("ewma").collect()
    assert [r[0] for r in out] == [None, 1.0, 1.0, 2.0]


def test_cusum_fires_at_h_and_resets(spark):
    out = ts.cusum(frame(spark, [1.5, 1.5, 1.5, None, 2.5, 0.6]), ["k"], "date", "x", 0.5, 2.0).orderBy("date").select("alert").collect()
    assert [r[0] for r in out] == [0.0, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_yoy_needs_the_adjacent_year(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2003, 4.0)], "k string, year int, x double")
    got = {r["year"]: (r["x_yoy"], r["x_diff"]) for r in ts.yoy(df, ["k"], "year", ["x"], ["x"]).collect()}
    assert got == {2000: (None, None), 2001: (1.0, 1.0), 2003: (None, None)}


def test_week_ends_on_sunday_and_gaps_are_zero(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 1, 2), 1.0), ("a", dt.date(2000, 1, 18), 2.0)], "k string, date date, x double")
    got = ts.resample_week(df, ["k"], "date", {"n": F.count("*")}).orderBy("week").collect()
    assert [(r["week"].isoformat(), r["n"]) for r in got] == [("2000-01-02", 1), ("2000-01-09", 0), ("2000-01-16", 0), ("2000-01-23", 1)]


def test_step_ffill_and_suffix(spark):
    df = frame(spark, [1, 1, 2, None])
    assert column(df, ts.step_change("x", ["k"], "date")) == [False, False, True, False]
    assert column(df, ts.ffill("x", ["k"], "date")) == [1, 1, 2, 2]
    assert column(frame(spark, [3, 1, 2]), ts.suffix_min("x", ["k"], "date")) == [1, 1, 2]


def test_persistence_needs_full_frame(spark):
    df = frame(spark, [1, 1, 0, 1]).withColumn("f", F.col("x") > 0)
    assert column(df, ts.persistence("f", ["k"], "date", 2, 3)) == [False, False, True, True]


def test_folds_side_by_side_over_batches(spark):
    """Several recursions in one pass, with series that go over Arrow batches and partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        values = {k: [None if i % 13 == 4 else float((i * m) % 11) for i in range(60)] for k, m in (("a", 29), ("b", 7), (None, 3))}
        df = None
        for k, v in values.items():
            df = frame(spark, v, k) if df is None else df.unionByName(frame(spark, v, k))
        made = ts.fold_each(df, ["k"], "date", {"e": ("x", ts.Ewma(0.3)), "c": ("x", ts.Cusum(4.0, 9.0))}).orderBy("date").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, series in values.items():
        y, total, want = None, 0.0, []
        for v in series:
            y = y if v is None else v if y is None else 0.3 * v + 0.7 * y
            total = 0.0 if v is None else max(0.0, total + v - 4)
            want.append((y, float(total >= 9)))
            total = 0.0 if total >= 9 else total
        assert [(r["e"], r["c"]) for r in made if r["k"] == k] == [(None if e is None else pytest.approx(e), c) for e, c in want]


def test_folds_without_keys_or_rows(spark):
    df = frame(spark, [1, 3])
    assert [r["ewma"] for r in ts.ewma(df, [], "date", "x", 0.5).orderBy("date").collect()] == [1.0, 2.0]
    assert ts.ewma(df.limit(0), ["k"], "date", "x", 0.5).collect() == []


def long_series(spark):
    """One series over most ranges, two that begin and end inside of them, one of nulls, one without a key."""
    made = {"a": [None if i % 17 in (3, 4) else ((i * 37) % 101) / 10 for i in range(400)], "b": [2.0] * 30, "c": [((i * 7) % 13) / 3 for i in range(90)], "d": [None] * 20, None: [float(i % 5) for i in range(60)]}
    df = None
    for k, v in made.items():
        df = frame(spark, v, k) if df is None else df.unionByName(frame(spark, v, k))
    return made, df


def test_folds_compose_over_ranges(ranges):
    made, df = long_series(ranges)
    got = ts.fold_each(df.withColumn("other", F.lit(1)), ["k"], "date", {"e": ("x", ts.Ewma(0.07)), "c": ("x", ts.Cusum(4.9, 9.0)), "f": ("x", ts.Cusum(4.5, 40.0))})
    rows = sorted(got.collect(), key=lambda r: (str(r["k"]), r["date"]))
    assert got.columns == ["k", "date", "x", "other", "e", "c", "f"] and len(rows) == sum(map(len, made.values()))
    for key, series in made.items():
        y, sums, want = None, [0.0, 0.0], []
        for v in series:
            y = y if v is None else v if y is None else 0.07 * v + 0.93 * y
            sums = [0.0 if v is None else max(0.0, s + v - k) for s, k in zip(sums, (4.9, 4.5), strict=True)]
            want.append((y, *[float(s >= h) for s, h in zip(sums, (9.0, 40.0), strict=True)]))
            sums = [0.0 if s >= h else s for s, h in zip(sums, (9.0, 40.0), strict=True)]
        mine = [(r["e"], r["c"], r["f"]) for r in rows if r["k"] == key]
        assert [m[1:] for m in mine] == [w[1:] for w in want]
        assert [m[0] for m in mine] == [None if w[0] is None else pytest.approx(w[0]) for w in want]


def test_ranks_over_ranges_equal_brute_force(ranges):
    made, df = long_series(ranges)
    got = sorted(ts.past_pct_rank(df, "x", ["k"], "date", 10, "y").collect(), key=lambda r: (str(r["k"]), r["date"]))
    for key, series in made.items():
        want = []
        for i, v in enumerate(series):
            seen = [e for e in series[:i] if e is not None]
            want.append(100 * sum(e <= v for e in seen) / len(seen) if v is not None and i >= 10 and len(seen) >= 10 else None)
        assert [r["y"] for r in got if r["k"] == key] == [None if w is None else pytest.approx(w) for w in want]


def test_one_series_without_keys_is_many_tasks(ranges):
    _, df = long_series(ranges)
    one = df.filter("k = 'a'")
    made = ts.past_pct_rank(ts.ewma(one, [], "date", "x", 0.2), "x", [], "date", 10)
    same = ts.past_pct_rank(ts.ewma(one, ["k"], "date", "x", 0.2), "x", ["k"], "date", 10)
    key = lambda d: [(r["date"], r["pct_rank"], None if r["ewma"] is None else round(r["ewma"], 9)) for r in d.orderBy("date").collect()]
    assert key(made) == key(same)
    from eventscope.functions import ranks

    assert ranks._counts(one, [], "date", "x").select("__range").distinct().count() >= 6


def test_pieces_of_a_cusum():
    r, rule = np.random.default_rng(1), ts.Cusum(0.5, 3.0)
    for _ in range(300):
        values = np.where(r.random(12) < 0.05, np.nan, r.integers(-8, 9, 12) / 4)
        piece = rule.opened()
        for a, b in ((0, 5), (5, 6), (6, 12)):
            piece = rule.extend(piece, values[a:b])
        for start in np.arange(0, 3, 0.25):
            assert rule.follow([start], piece) == rule.run([start], values)[0]


def test_dominance_counts():
    r = np.random.default_rng(0)
    for n in [0, 1, 2, *r.integers(3, 40, 60)]:
        v, w, g = r.integers(0, 9, n).astype(float), r.integers(0, 4, n), r.integers(0, 3, n)
        assert dominance(v, w, g).tolist() == [sum(w[j] for j in range(i) if v[j] <= v[i] and g[j] == g[i]) for i in range(n)]
