"""Change points: of short series by pruned exact search, of series of any length by splitting at shifts of the mean."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.functions import blocks
from eventscope.operators import events as ev
from eventscope.sources.storage import materialize

#: Splits of one level up to this many are broadcast.
BROADCAST_SPLITS = 10_000


def _block_sums(x: np.ndarray, cost: str) -> np.ndarray:
    """Two-dimensional prefix sums of the kernel matrix (rbf: median bandwidth; l2: products)."""
    gram = np.outer(x, x)
    if cost == "rbf":
        square = (x[:, None] - x[None, :]) ** 2
        above = square[np.triu_indices(len(x), 1)]
        middle = np.median(above) if len(above) else 0.0
        gram = np.exp(-np.clip(square * (1 / middle if middle > 0 else 1.0), 1e-2, 1e2))
        np.fill_diagonal(gram, 1.0)
    out = np.zeros((len(x) + 1, len(x) + 1))
    out[1:, 1:] = gram.cumsum(0).cumsum(1)
    return out


def segment_ends(x: np.ndarray, penalty: float, cost: str = "rbf", least: int = 2, jump: int = 1) -> list[int]:
    """Ends of the segments that minimise cost plus penalty per segment, the series' end included."""
    n = len(x)
    sums = _block_sums(np.asarray(x, dtype=float), cost)
    trace = np.concatenate([[0.0], np.diagonal(np.diff(np.diff(sums, axis=0), axis=1)).cumsum()])
    ends = [t for t in range(0, n, jump) if t >= least or t == 0] + [n]
    best, last, live = {0: -penalty}, {0: 0}, [0]
    for t in ends[1:]:
        totals = {}
        for s in live:
            if t - s >= least:
                block = sums[t, t] - sums[s, t] - sums[t, s] + sums[s, s]
                totals[s] = best[s] + trace[t] - trace[s] - block / (t - s)
        if not totals:
            continue
        start = min(totals, key=lambda s: (totals[s], s))
        best[t], last[t] = totals[start] + penalty, start
        live = [s for s in live if s not in totals or totals[s] <= best[t]] + [t]
    out, t = [], n
    while t > 0:
        out.append(t)
        t = last[t]
    return out[::-1]


def change_points(panel: DataFrame, keys: Sequence[str], time: str, value: str, penalty: float = 5.0, cost: str = "rbf", least_points: int = 30, keep_end: bool = False, jump: int = 1) -> DataFrame:
    """``(keys, time)`` of the last point of every segment, the series' end left out unless asked for.

    One series is one task and needs the square of its length in memory: for series of some thousand points;
    ``mean_shifts`` takes any.  Series with fewer than ``least_points`` values have none.
    """
    from pyspark.sql.types import StructType

    schema = StructType([panel.schema[k] for k in (*keys, time)])

    def find(group: pd.DataFrame) -> pd.DataFrame:
        held = group.dropna(subset=[value]).sort_values(time)
        if len(held) < least_points:
            return held.iloc[:0][[*keys, time]]
        ends = segment_ends(held[value].to_numpy(dtype=float), penalty, cost, jump=jump)
        return held.iloc[[e - 1 for e in ends if keep_end or e < len(held)]][[*keys, time]]

    return panel.select(*keys, time, value).groupBy(*keys).applyInPandas(find, schema)


def mean_shifts(panel: DataFrame, keys: Sequence[str], time: str, value: str, penalty: float, least: int = 2, least_points: int = 30) -> DataFrame:
    """``(keys, time, gain)`` of the last point of every segment but a series' last, by binary segmentation of squared deviations.

    A segment is split where that lowers the sum of squared deviations from the means most (the earliest point
    among equals), as long as it does by more than ``penalty``; both sides have ``least`` points.  Missing values
    are left out, series with fewer than ``least_points`` values have none, and the times of a series are distinct.

    With sums up to every point the gain of a split is an expression of a row.  The sums come from ranges of
    rows, all segments of a level are split at once, and only points of segments that were split go on: a
    series of any length is many tasks, and the work is its length times the depth of its splits.
    """
    found = F.col(value).cast("double")
    held = panel.select(*keys, time, found.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    placed = blocks.dealt(held, [*keys, time], "series-in-order")
    means = blocks.named(placed.groupBy(*keys).agg(F.avg("__v").alias("__mean"), F.count("*").alias("__b")), keys, "__k_")
    centred = materialize(placed.join(means.filter(F.col("__b") >= least_points), blocks.same_keys(keys, "__k_")).select(*keys, time, blocks.RANGE, "__b", (F.col("__v") - F.col("__mean")).alias("__v")), "series-centred")
    summed = blocks.running(centred, keys, [time], {"__i": F.lit(1), "__s": F.col("__v")})
    whole = blocks.named(centred.groupBy(*keys).agg(F.sum("__v").alias("__sb")), keys, "__k_")
    active = summed.join(whole, blocks.same_keys(keys, "__k_")).select(*keys, time, "__i", "__s", F.lit(0).cast("long").alias("__a"), "__b", F.lit(0.0).alias("__sa"), "__sb")
    out, level = None, 0
    while True:
        active = materialize(active, f"segments-{level}")
        i, a, b, s, sa, sb = (F.col(f"__{c}") for c in ("i", "a", "b", "s", "sa", "sb"))
        square = lambda x, n: x * x / n
        gain = square(s - sa, i - a) + square(sb - s, b - i) - square(sb - sa, b - a)
        best = active.filter((i - a >= least) & (b - i >= least)).groupBy(*keys, "__a").agg(F.max(F.struct(gain.alias("gain"), (-i).alias("i"), F.col(time).alias("t"), s.alias("s"))).alias("m"))
        cuts = materialize(best.filter(F.col("m.gain") > penalty), f"splits-{level}")
        n = cuts.count()
        if not n:
            break
        made = cuts.select(*keys, F.col("m.t").alias(time), F.col("m.gain").alias("gain"))
        out = made if out is None else out.unionByName(made)
        known = blocks.named(cuts.select(*keys, "__a", (-F.col("m.i")).alias("__c"), F.col("m.s").alias("__sc")), [*keys, "__a"], "__k_")
        joined = active.join(F.broadcast(known) if n <= BROADCAST_SPLITS else known, blocks.same_keys([*keys, "__a"], "__k_"))
        left, c, sc = F.col("__i") <= F.col("__c"), F.col("__c"), F.col("__sc")
        parts = {"__a": F.when(left, a).otherwise(c), "__b": F.when(left, c).otherwise(b), "__sa": F.when(left, sa).otherwise(sc), "__sb": F.when(left, sc).otherwise(sb)}
        active = joined.select(*keys, time, "__i", "__s", *[x.alias(name) for name, x in parts.items()])
        level += 1
    return cuts.select(*keys, F.col("m.t").alias(time), F.col("m.gain").alias("gain")) if out is None else out


def events_near(points: DataFrame, events: DataFrame, keys: Sequence[str], date: str, days: int = 90) -> DataFrame:
    """Number of change points per series and nearest event within so many days."""
    near = ev.nearest_event(points, events, date).filter(F.abs("gap_days") <= days)
    return near.groupBy(*keys, F.col("nearest_event").alias("event_key")).agg(F.count("*").alias("n"))
