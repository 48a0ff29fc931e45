"""Anomaly forests and leave-one-event-out classifiers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.operators import events as ev
from eventscope.operators.aggregates import quantiles
from eventscope.sources.storage import materialize


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """An isolation tree as rows ``[feature, cut, left, right, size]``; feature -1 marks a leaf."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < cut
            nodes[place][:4] = [f, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1)]
        return place

    add(x, 0)
    return nodes


#: A forest as arrays: for each tree ``(feature, cut, left, right, depth left below a leaf)``.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _packed(nodes: list[list[float]]) -> Tree:
    """Small arrays of a tree, made once and sent with the tasks."""
    n = np.array(nodes)
    return n[:, 0].astype(np.int32), n[:, 1], n[:, 2].astype(np.int32), n[:, 3].astype(np.int32), np.array([_average_path(s) for s in n[:, 4]])


def _path_lengths(tree: Tree, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, below = tree
    at, depth, rows = np.zeros(len(x), dtype=np.int32), np.zeros(len(x)), np.arange(len(x))
    while True:
        rows = rows[feature[at[rows]] >= 0]
        if not len(rows):
            break
        n = at[rows]
        at[rows] = np.where(x[rows, feature[n]] < cut[n], left[n], right[n])
        depth[rows] += 1
    return depth + below[at]


def _raw_scores(forest: tuple[list[Tree], int], x: np.ndarray) -> np.ndarray:
    """Anomaly scores in (0, 1]; NaN for rows with a missing feature or without trees."""
    trees, size = forest
    out, sound = np.full(len(x), np.nan), ~np.isnan(x).any(axis=1)
    if trees and sound.any():
        out[sound] = 2.0 ** (-np.mean([_path_lengths(t, x[sound]) for t in trees], axis=0) / _average_path(size))
    return out


def _grown(rows: DataFrame, key: str, features: Sequence[str], seed: int) -> list[dict]:
    """A tree for each ``(event, tree)`` of ``rows``, each grown in a task; ``event`` is null for a forest without one."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        event, t = group["event"].iloc[0], int(group["tree"].iloc[0])
        x = group.sort_values(key)[list(features)].to_numpy(dtype=float)
        made = _grow(x, np.random.default_rng([seed, t]), int(np.ceil(np.log2(max(2, len(x))))))
        return pd.DataFrame({"event": [event], "tree": [t], "nodes": [json.dumps(made)], "size": [len(x)]})

    return rows.groupBy("event", "tree").applyInPandas(grow, "event string, tree int, nodes string, size long").orderBy("event", "tree").collect()


def _forest(grown: Sequence) -> tuple[list[Tree], int]:
    return [_packed(json.loads(r["nodes"])) for r in grown], max(2, round(np.mean([r["size"] for r in grown]))) if grown else 2


def _drawn(key: str, trees: int, share: float, seed: int) -> Column:
    """The trees whose seeded samples hold a row."""
    span = 1 << 62
    return F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(span)) < F.lit(int(share * span)))


def fit_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 400, sample: int = 512, seed: int = 42) -> tuple[list[Tree], int]:
    """Isolation trees, each grown in a task from its own seeded sample of about ``sample`` complete rows."""
    held = df.dropna(subset=list(features)).select(key, *features)
    n = held.count()
    drawn = _drawn(key, trees, min(1.0, sample / n) if n else 0.0, seed)
    return _forest(_grown(held.withColumns({"tree": F.explode(drawn), "event": F.lit(None).cast("string")}), key, features, seed))


def score_forest(df: DataFrame, forest: tuple[list[Tree], int], features: Sequence[str], out: str = "raw_score") -> DataFrame:
    """Add the anomaly score in (0, 1]; null for rows with a missing feature or without trees."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: _raw_scores(forest, batch[list(features)].to_numpy(dtype=float))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    scored = df.mapInPandas(score, f"{schema}, {out} double")
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 400, sample: int = 512, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Add ``raw_score``, ``score`` scaled to [0, 1] and ``anomaly``, true for the share ``contamination`` of highest scores."""
    scored = materialize(score_forest(df, fit_forest(df, key, features, trees, sample, seed), features), "forest-scores")
    stats = scored.agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"), F.percentile("raw_score", F.lit(1 - contamination)).alias("cut"))
    joined = scored.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("score", F.try_divide(F.col("raw_score") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))).withColumn("anomaly", F.coalesce(F.col("raw_score") > F.col("cut"), F.lit(False))).drop("lo", "hi", "cut")


def isolation_backtest(df: DataFrame, events: DataFrame, key: str, date: str, features: Sequence[str], weeks: int = 12, least: int = 100, trees: int = 400, sample: int = 512, seed: int = 42, contamination: float = 0.05) -> DataFrame:
    """Per event: a forest from rows before its last weeks and outside of acute windows scores those weeks, scaled by the training range and clipped.

    Adds ``event_key, raw_score, score`` and ``anomaly``: above the share ``contamination`` of highest scores of
    the training rows.  Events with fewer than ``least`` complete training rows have none.  All forests grow from
    one pass, a task an event and tree, and all rows are scored in one more: the number of jobs does not depend
    on the number of events, of which the driver holds the dates and the trees.
    """
    peaks = {r["event_key"]: r["acute_peak"] for r in events.select("event_key", "acute_peak").orderBy("event_key").collect()}
    starts = {e: F.date_sub(F.lit(p), 7 * weeks) for e, p in peaks.items()}
    sound = reduce(Column.__and__, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])
    calm = materialize(ev.exclude_windows(df, events, date, F.col("acute_start"), F.col("acute_end")).filter(sound).select(key, date, *features), "forest-train")
    before = lambda e: F.col(date) < starts[e]
    counts = calm.agg(*[F.count_if(before(e)).alias(f"n{i}") for i, e in enumerate(peaks)]).first() if peaks else []
    held = {e: n for e, n in zip(peaks, counts, strict=True) if n >= least}
    added = "raw_score double, score double, anomaly boolean, event_key string"
    if not held:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in added.split(", "))]
        return df.limit(0).select("*", *none)
    drawn = F.array(*[F.struct(F.lit(e).alias("event"), F.when(before(e), _drawn(key, trees, min(1.0, sample / n), seed)).alias("trees")) for e, n in held.items()])
    rows = calm.withColumn("d", F.explode(drawn)).select(key, *features, F.col("d.event").alias("event"), F.explode("d.trees").alias("tree"))
    grown = _grown(rows, key, features, seed)
    forests = {e: _forest([g for g in grown if g["event"] == e]) for e in held}

    def scored(of: DataFrame, asked: dict[str, Column]) -> DataFrame:
        """Rows of ``of`` once for each event that asks for them, with the score by its forest."""
        names = F.array_compact(F.array(*[F.when(when, F.lit(e)) for e, when in asked.items()]))
        told = of.withColumn("event_key", F.explode(names))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, event = batch[list(features)].to_numpy(dtype=float), batch["event_key"].to_numpy()
                made = np.full(len(batch), np.nan)
                for e in set(event):
                    made[event == e] = _raw_scores(forests[e], x[event == e])
                yield batch.assign(raw_score=made)

        return told.mapInPandas(score, f"{kinds}, raw_score double").withColumn("raw_score", F.when(~F.isnan("raw_score"), F.col("raw_score")))

    trained = scored(calm.select(date, *features), {e: before(e) for e in held}).select("event_key", "raw_score")
    trained = materialize(trained, "forest-trained")
    cut = quantiles(trained, ["event_key"], "raw_score", [1 - contamination])
    spans = trained.groupBy("event_key").agg(F.min("raw_score").alias("__lo"), F.max("raw_score").alias("__hi")).join(cut.toDF("event_key", "__cut"), "event_key")
    late = scored(df, {e: (F.col(date) >= starts[e]) & (F.col(date) < F.lit(peaks[e])) for e in held})
    scaled = (F.col("raw_score") - F.col("__lo")) / F.coalesce(F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(1.0))
    made = late.join(F.broadcast(spans), "event_key")  # a row an event
    return made.select(*[F.col(f"`{c}`") for c in df.columns], "raw_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("score"), F.coalesce(F.col("raw_score") > F.col("__cut"), F.lit(False)).alias("anomaly"), "event_key")


def anomaly_scores(df: DataFrame, z_columns: Sequence[str], score: str, flag: str, at: float = 3.5) -> DataFrame:
    """Add ``z_flag`` (any robust z at ``at`` or beyond), ``dominant`` series and ``both`` flags."""
    from eventscope.functions.columns import row_argmax, row_max_abs

    top = row_max_abs(*[F.col(c) for c in z_columns])
    made = df.withColumn("max_abs_z", top).withColumn("z_flag", F.coalesce(F.col("max_abs_z") >= at, F.lit(False))).withColumn("dominant", row_argmax({c: F.col(c) for c in z_columns}))
    return made.withColumn("both", F.col("z_flag") & F.col(flag))


def anomaly_overlap(df: DataFrame, events: DataFrame, date: str, score: str, flag: str) -> DataFrame:
    """Per event window: rows, flagged rows, highest score, first and last flag and days from the first to the peak."""
    held = ev.window_join(df, events, date)
    made = held.groupBy("event_key", "acute_peak").agg(
        F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.max(score).alias("max_score"), F.min(F.when(F.col(flag), F.col(date))).alias("first_flag"), F.max(F.when(F.col(flag), F.col(date))).alias("last_flag")
    )
    return made.withColumn("days_to_peak", F.datediff("acute_peak", "first_flag")).drop("acute_peak")


#: Newton steps at most, and the largest change of a coefficient at which they end.
NEWTON, SETTLED = 50, 1e-9


def fit_folds(rows: DataFrame, folds: Sequence[tuple[int, int]], width: int, c: float) -> list[tuple[float, list[float], np.ndarray, np.ndarray] | None]:
    """Logistic models of all folds at once: ``(intercept, coefficients, means, deviations)`` each, None where a class is missing.

    ``rows`` has ``x`` (doubles), ``y`` (a label for each horizon) and ``tested`` (a flag for each event); a fold
    is ``(event, horizon)`` and trains on the rows that its event does not test.  Features are standardised by
    the training rows, classes weigh the same, and half the squared coefficients over ``c`` are added to the
    loss.  Every Newton step is one aggregation: each task adds up loss, slope and curvature of all folds.  The
    driver holds a few numbers a fold.
    """

    def told(kind: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sums over all rows of what ``kind(fold, x, label, trained)`` gives for each fold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, tested = (np.stack(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("x", "y", "tested"))
                made = np.stack([kind(k, x, y[:, h].astype(float), ~tested[:, e].astype(bool)) for k, (e, h) in enumerate(folds)])
                sums = made if sums is None else sums + made
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(folds)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["fold", "v"])

        parts = rows.mapInArrow(run, "fold int, v array<double>").select("fold", F.posexplode("v").alias("place", "v"))
        found = parts.groupBy("fold", "place").agg(F.sum("v").alias("v")).orderBy("fold", "place").collect()
        return np.array([r["v"] for r in found]).reshape(len(folds), -1) if found else np.zeros((len(folds), 0))

    first = told(lambda k, x, y, on: np.concatenate([[on.sum(), y[on].sum()], x[on].sum(axis=0)]))
    if not first.size:
        return [None] * len(folds)
    n, positive = first[:, 0], first[:, 1]
    means = first[:, 2:] / np.maximum(n, 1)[:, None]
    spread = told(lambda k, x, y, on: ((x[on] - means[k]) ** 2).sum(axis=0)) / np.maximum(n, 1)[:, None]
    deviations = np.where(spread > 0, np.sqrt(spread), 1.0)
    sound = (positive > 0) & (positive < n)
    one, zero = n / (2 * np.maximum(positive, 1)), n / (2 * np.maximum(n - positive, 1))
    beta, size = np.zeros((len(folds), width + 1)), width + 1
    ridge = np.append(0.0, np.full(width, 1.0 / c))
    before, step = np.full(len(folds), np.inf), np.zeros_like(beta)
    for _ in range(NEWTON):
        now = beta

        def sums(k: int, x: np.ndarray, y: np.ndarray, on: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            z = np.hstack([np.ones((int(on.sum()), 1)), (x[on] - means[k]) / deviations[k]])
            label, score = y[on], z @ now[k]
            p, weight = 1 / (1 + np.exp(-np.clip(score, -500, 500))), np.where(y[on] > 0, one[k], zero[k])
            loss = (weight * (np.logaddexp(0, score) - label * score)).sum()
            return np.concatenate([[loss], z.T @ (weight * (p - label)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

        got = told(sums)
        loss = got[:, 0] + (ridge * beta**2).sum(axis=1) / 2
        worse = loss > before + 1e-12 * np.abs(before)
        halved = step / 2
        slope, curve = got[:, 1 : 1 + size] + ridge * beta, got[:, 1 + size :].reshape(-1, size, size) + np.diag(ridge)
        fresh = np.stack([np.linalg.lstsq(curve[k], -slope[k], rcond=None)[0] for k in range(len(folds))])
        start = np.where(worse[:, None], beta - step, beta)
        step = np.where(worse[:, None], halved, fresh)
        before = np.where(worse, before, loss)
        beta = start + step
        if np.abs(step[sound]).max(initial=0.0) < SETTLED:
            break
    return [(float(beta[k, 0]), beta[k, 1:].tolist(), means[k], deviations[k]) if sound[k] else None for k in range(len(folds))]


def loeo_logistic(
    df: DataFrame, events: DataFrame, date: str, features: Sequence[str], horizons: Sequence[int] = (8, 12), keep: Sequence[str] = (), weeks: int = 26, post_weeks: int = 12, c: float = 1.0, alerts_per_decade: float = 10.0
) -> tuple[DataFrame, DataFrame]:
    """Leave one event out: ``(scores, coefficients)`` of an L2 logistic model per horizon and held-out event.

    Eligible rows have every feature and lie outside of the spans from each acute start to ``post_weeks`` after
    the peak.  A fold trains on all of them but those of the ``weeks`` before its event's peak, with the label
    that some peak follows within the horizon; features are standardised by the training rows and classes weigh
    the same.  All eligible rows are scored.  The threshold allows ``alerts_per_decade`` over the scored rows
    that precede no peak within the horizon (0.5 without any).  Folds without both classes have no scores.

    ``scores`` is ``(horizon, fold, <keep>, date, label, score, threshold, alert)``, ``coefficients``
    ``(horizon, fold, feature, coefficient)``.  All folds are fitted together (``fit_folds``), so the number of
    jobs does not depend on the numbers of events and horizons.
    """
    spark, others = df.sparkSession, [k for k in keep if k != date]
    eligible = ev.exclude_post(df.dropna(subset=list(features)), events, post_weeks, date).select(*others, date, *features)
    peaks = {r["event_key"]: r["acute_peak"] for r in events.orderBy("event_key").collect()}
    for h in horizons:
        eligible = ev.label_within(eligible, events, h, date, f"label_{h}")
    held = materialize(eligible, "loeo-rows")
    test = {key: F.col(date).between(F.date_sub(F.lit(peak), 7 * weeks), F.date_sub(F.lit(peak), 1)) for key, peak in peaks.items()}
    folds = [(key, h) for key in peaks for h in horizons]
    ready = held.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.array(*[F.col(f"label_{h}") for h in horizons]).alias("y"), F.array(*test.values()).alias("tested"))
    fitted = fit_folds(ready, [(i, j) for i in range(len(peaks)) for j in range(len(horizons))], len(features), c) if peaks else []
    entries, coefficients = [], []
    for (key, h), model in zip(folds, fitted, strict=True):
        if model is None:
            continue
        bias, weights, means, spreads = model
        risk = reduce(Column.__add__, [(F.col(f).cast("double") - m) / d * w for f, w, m, d in zip(features, weights, means, spreads, strict=True)], F.lit(bias))
        entries.append(F.struct(F.lit(h).alias("horizon"), F.lit(key).alias("fold"), F.col(f"label_{h}").alias("label"), (1 / (1 + F.exp(-risk))).alias("score")))
        coefficients += [(h, key, f, w) for f, w in zip(features, weights, strict=True)]
    table = spark.createDataFrame(coefficients, "horizon int, fold string, feature string, coefficient double")
    if not entries:
        return held.limit(0).select(F.lit(0).alias("horizon"), F.lit("").alias("fold"), *others, date, F.lit(False).alias("label"), *[F.lit(0.0).alias(k) for k in ("score", "threshold")], F.lit(False).alias("alert")), table
    every = held.select(*others, date, F.explode(F.array(*entries)).alias("e")).select("e.horizon", "e.fold", *others, date, "e.label", "e.score")
    every = materialize(every, "loeo-scores")
    cuts = quantiles(every.filter("not label"), ["horizon", "fold"], "score", [1 - alerts_per_decade / 520]).toDF("horizon", "fold", "threshold")  # a row precedes a peak if and only if it is labelled
    joined = every.join(ev.small(cuts), ["horizon", "fold"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return joined.withColumn("alert", F.col("score") >= F.col("threshold")), table


def fold_summary(scores: DataFrame, events: DataFrame, date: str, weeks: int = 26) -> DataFrame:
    """Per horizon and fold over the weeks before its event: alerts, first alert, fractional lead in weeks, highest and mean score."""
    held = ev.pre_window(scores, events, weeks, date).filter(F.col("event_key") == F.col("fold"))
    made = held.groupBy("horizon", "fold", "acute_peak").agg(F.count_if("alert").alias("n_alerts"), F.min(F.when(F.col("alert"), F.col(date))).alias("first_alert"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.first("threshold").alias("threshold"))
    quiet = scores.groupBy("horizon", "fold").agg((520 * F.avg(F.when(~F.col("label"), F.col("alert").cast("double")))).alias("false_alarms"))
    return made.join(quiet, ["horizon", "fold"]).withColumn("lead_weeks", F.datediff("acute_peak", "first_alert") / 7.0).withColumn("detected", F.col("n_alerts") > 0).drop("acute_peak")


def coefficient_summary(coefficients: DataFrame) -> DataFrame:
    made = coefficients.groupBy("horizon", "feature").agg(F.avg("coefficient").alias("mean"), F.stddev_samp("coefficient").alias("std"), F.min("coefficient").alias("min"), F.max("coefficient").alias("max"))
    return made.orderBy("horizon", F.abs("mean").desc(), "feature")
