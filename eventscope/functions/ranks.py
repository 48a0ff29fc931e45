"""Ranks among earlier values, by dominance counts over ranges of time and of value.

A row asks how many rows of its series are earlier and at or below its value.  Inside a range of time sorted
halves are merged.  For a series over several ranges, rows of earlier ranges are counted by ranges of value:
whole ranges below from a table of counts by both, and those in the row's own range of value by merging again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from eventscope.functions.blocks import RANGE, dealt, dominance, named, same_keys
from eventscope.functions.recursions import doubles, segments
from eventscope.sources.storage import materialize

_PLACE, _SEEN, _BELOW, _KIND, _VALUE = "__place", "__seen", "__below", "__kind", "__value"


def _earlier(value: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """How many values of the sorted runs are at or below each value."""
    total = np.zeros(len(value), dtype=np.int64)
    for run in runs:
        total += np.searchsorted(run, value, "right")
    return total


def _added(runs: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    """The runs with one more; those of like size are merged, so there are few."""
    runs = [*runs, np.sort(values)]
    while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
        runs[-2:] = [np.sort(np.concatenate(runs[-2:]), kind="stable")]
    return runs


def _counts(df: DataFrame, keys: Sequence[str], time: str, x: str) -> DataFrame:
    """``df``, written, with what each row finds in its own range of its series: place, values seen, values at or below.

    Rows of kind 1 tell of the first and the last series of each range how many rows and values it has there.
    """
    fields = [StructField(f.name, f.dataType, True) for f in df.schema.fields]
    more = [StructField(c, LongType()) for c in (_PLACE, _SEEN, _BELOW)] + [StructField(RANGE, IntegerType()), StructField(_KIND, IntegerType())]
    names = [f.name for f in [*fields, *more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        runs, rows, seen, first, row = [], 0, 0, None, None
        for batch in batches:
            found = segments(batch, keys)
            if not found:
                continue
            value = doubles(batch, x)
            known, of = ~np.isnan(value), np.repeat(np.arange(len(found)), [b - a for _, a, b in found])
            below = np.zeros(len(value), dtype=np.int64)
            below[known] = dominance(value[known], group=of[known])
            starts = np.array([a for _, a, _ in found])
            place, upto = np.arange(len(value)) - starts[of], np.cumsum(known) - known
            before = upto - upto[starts][of]
            key, a, b = found[0]
            if count and key == last:
                below[a:b] += _earlier(value[a:b], runs)
                place[a:b] += rows
                before[a:b] += seen
            else:
                runs, rows, seen = [], 0, 0
            for i, (key, a, b) in enumerate(found):
                if not count or key != last:
                    if count == 1:
                        first = row, rows, seen
                    last, count = key, count + 1
                    runs, rows, seen = [], 0, 0
                row, rows, seen = batch.slice(a, 1), rows + b - a, seen + int(known[a:b].sum())
                if i + 1 == len(found):
                    runs = _added(runs, value[a:b][known[a:b]])
            below[~known] = 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *[pa.array(c, pa.int64()) for c in (place, before, below)], pa.array(np.full(n, part), pa.int32()), pa.array(np.zeros(n), pa.int32())], names)
        if count:
            for told, rows_of, seen_of in [(row, rows, seen)] if count == 1 else [first, (row, rows, seen)]:
                blank = [told.column(f.name) if f.name in keys else pa.nulls(1, told.column(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays([*blank, *[pa.array([v], pa.int64()) for v in (rows_of, seen_of, None)], pa.array([part], pa.int32()), pa.array([1], pa.int32())], names)

    placed = df.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
    return materialize(placed.mapInArrow(run, StructType([*fields, *more])), "ranked")


def _inside(table: pa.Table) -> pa.Table:
    """Of one range of values: for each of its values and each range of time, how many earlier ranges hold there at or below."""
    value, part, n = (table.column(c).to_numpy() for c in (_VALUE, RANGE, "__n"))
    at = np.lexsort((-value, part))  # greater values first, so that a range of time does not count itself
    below = np.empty(len(at), dtype=np.int64)
    below[at] = dominance(value[at], n[at])
    return table.append_column("__in", pa.array(below))


def _whole(table: pa.Table) -> pa.Table:
    """For each range of values and of time, how many rows earlier ranges of time hold in lower ranges of values."""
    part, band, n = (table.column(c).to_numpy() for c in (RANGE, "__band", "__n"))
    zero = np.zeros(len(n), dtype=np.int64)
    times, bands, weights, kind = np.concatenate([part, part]), np.concatenate([2 * band, 2 * band + 1]), np.concatenate([zero, n]), np.concatenate([zero, zero + 1])
    at = np.lexsort((kind, times))  # a range of time asks before it is counted
    below = np.empty(len(at), dtype=np.int64)
    below[at] = dominance(bands[at], weights[at])
    return table.append_column("__lower", pa.array(below[: len(n)]))


def _over_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, range, value, __more)``: rows of earlier ranges of the series at or below each value that a range holds."""
    held = rows.filter(F.col(_VALUE).isNotNull()).groupBy(*keys, RANGE, _VALUE).agg(F.count("*").alias("__n"))
    placed = dealt(held.withColumnRenamed(RANGE, "__time"), [*keys, _VALUE], "ranked-values").withColumnRenamed(RANGE, "__band").withColumnRenamed("__time", RANGE)
    like = lambda *more: StructType([*[StructField(f.name, f.dataType, True) for f in placed.schema.fields if f.name in (*keys, RANGE, "__band", _VALUE, "__n")], *[StructField(m, LongType()) for m in more]])
    inside = placed.groupBy(*keys, "__band").applyInArrow(_inside, like("__in"))
    sums = placed.groupBy(*keys, RANGE, "__band").agg(F.sum("__n").alias("__n"))
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in sums.schema.fields], StructField("__lower", LongType())])
    lower = named(materialize(sums.groupBy(*keys).applyInArrow(_whole, schema), "ranked-bands").drop("__n"), [*keys, RANGE, "__band"], "__k_")
    joined = inside.join(lower, same_keys([*keys, RANGE, "__band"], "__k_"))
    return joined.select(*keys, RANGE, _VALUE, (F.col("__in") + F.col("__lower")).alias("__more"))


def past_pct_rank(df: DataFrame, x: str, keys: Sequence[str], time: str, min_periods: int = 52, out: str = "pct_rank") -> DataFrame:
    """Add the share (in %) of strictly earlier values at or below the current one.

    Needs ``min_periods`` earlier rows and as many earlier non-null values; NaN counts as missing.  A task holds
    the values of a range of time or of values; a series of any length is many tasks.
    """
    kept = [c for c in df.columns if c != out]
    whole = _counts(df.select(*kept), keys, time, x)
    rows, told = whole.filter(F.col(_KIND) == 0), whole.filter(F.col(_KIND) == 1)
    place, seen, below = F.col(_PLACE), F.col(_SEEN), F.col(_BELOW)

    def rank(of: DataFrame) -> DataFrame:
        value = F.col(x).cast("double")
        enough = value.isNotNull() & ~F.isnan(value) & (place >= min_periods) & (seen >= min_periods)
        return of.select(*kept, F.when(enough, 100.0 * F.try_divide(below.cast("double"), seen)).alias(out))

    long = told.groupBy(*keys).agg(F.count("*").alias("__c")).filter("__c > 1")
    if long.isEmpty():
        return rank(rows)
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # two rows a range at most
    borders = told.join(named(long, keys, "__k_"), same_keys(keys, "__k_"), "left_semi")
    borders = borders.select(*keys, RANGE, F.coalesce(F.sum(_PLACE).over(earlier), F.lit(0)).alias("__rows"), F.coalesce(F.sum(_SEEN).over(earlier), F.lit(0)).alias("__values"))
    borders = F.broadcast(materialize(named(borders, [*keys, RANGE], "__k_"), "ranked-borders"))
    same = same_keys([*keys, RANGE], "__k_")
    value = F.col(x).cast("double")
    value = F.when(~F.isnan(value), value + F.lit(0.0))
    spread = rows.join(borders, same).withColumn(_VALUE, value).drop(*[f"__k_{c}" for c in [*keys, RANGE]])
    more = named(_over_ranges(spread.select(*keys, RANGE, _VALUE), keys), [*keys, RANGE, _VALUE], "__m_")
    joined = spread.join(more, same_keys([*keys, RANGE, _VALUE], "__m_"), "left")
    joined = joined.withColumns({_PLACE: place + F.col("__rows"), _SEEN: seen + F.col("__values"), _BELOW: below + F.coalesce("__more", F.lit(0))})
    return rank(rows.join(borders, same, "left_anti")).unionByName(rank(joined))
