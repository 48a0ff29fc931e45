"""Ordered recursions over series of any length: pieces of a series are folded by themselves and then composed.

Rows are dealt to ranges of key and time and go through in Arrow batches.  What a range does to the state
of the series that reaches into it is summed up in a few numbers (``extend``), so the states at the borders
follow from one row a range, and only ranges that start inside a series are gone through once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from eventscope.functions.blocks import RANGE
from eventscope.sources.storage import materialize

#: A state, and what a piece does to states: short lists of numbers.
State = list[float]


@dataclass(frozen=True)
class Ewma:
    """The exponentially weighted mean without adjustment; a missing value carries it on.

    Every value maps the mean ``y`` to ``a * y + b``, and such maps compose to one of their kind.
    """

    alpha: float

    def begin(self) -> State:
        return []  # no value yet

    def _maps(self, values: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """``a`` and ``b`` of the composed maps up to each value; with ``first`` the first value is taken as it is."""
        known = ~np.isnan(values)
        a, b = np.where(known, 1 - self.alpha, 1.0), np.where(known, self.alpha * np.where(known, values, 0.0), 0.0)
        if first and known.any():
            at = int(known.argmax())
            a[at], b[at] = 0.0, values[at]
        step = 1
        while step < len(values):  # maps over 1, 2, 4, ... values
            b[step:] = a[step:] * b[:-step] + b[step:]
            a[step:] = a[step:] * a[:-step]
            step *= 2
        return a, b

    def run(self, state: State, values: np.ndarray) -> tuple[State, np.ndarray]:
        if not len(values):
            return state, values
        a, b = self._maps(values, not state)
        if state:
            out = a * state[0] + b
        else:
            known = ~np.isnan(values)
            out = np.where(np.arange(len(values)) >= (int(known.argmax()) if known.any() else len(values)), b, np.nan)
        return (state if np.isnan(out[-1]) else [float(out[-1])]), out

    def opened(self) -> State:
        return [1.0, 0.0]

    def extend(self, piece: State, values: np.ndarray) -> State:
        """``[a, b]``, and after a first value also where the recursion ends that begins with it."""
        if not len(values):
            return piece
        a, b = (float(m[-1]) for m in self._maps(values, False))
        alone, _ = self.run(piece[2:], values)
        return [a * piece[0], a * piece[1] + b, *alone]

    def follow(self, state: State, piece: State) -> State:
        return [piece[0] * state[0] + piece[1]] if state else piece[2:]


@dataclass(frozen=True)
class Cusum:
    """The upper CUSUM: 1.0 where the sum reaches ``h``, then it starts anew, as it does after a missing value.

    A state lies in [0, h).  A piece moves an interval of states alike, and sends each of the other states to
    the one state that follows from starting anew; it is kept as ``[upto, moved, value]`` for each interval.
    """

    k: float
    h: float

    def begin(self) -> State:
        return [0.0]

    def run(self, state: State, values: np.ndarray) -> tuple[State, np.ndarray]:
        total, k, h, out = state[0], self.k, self.h, []
        for v in values.tolist():
            if v != v:
                total = 0.0
                out.append(0.0)
                continue
            total += v - k
            if total < 0.0:
                total = 0.0
            if total >= h:
                total = 0.0
                out.append(1.0)
            else:
                out.append(0.0)
        return [total], np.array(out)

    def opened(self) -> State:
        return [self.h, 1.0, 0.0]

    def extend(self, piece: State, values: np.ndarray) -> State:
        parts = [tuple(piece[i : i + 3]) for i in range(0, len(piece), 3)]
        for at, v in enumerate(values.tolist()):
            if v != v:
                parts = [(self.h, 0.0, 0.0)]
            if len(parts) == 1 and not parts[0][1]:  # all states have met
                (end,), _ = self.run([parts[0][2]], values[at:])
                return [self.h, 0.0, end]
            step, made, low = v - self.k, [], 0.0
            for upto, moved, value in parts:
                if not moved:
                    now = max(0.0, value + step)
                    made.append((upto, 0.0, 0.0 if now >= self.h else now))
                else:
                    shift = value + step
                    down, up = min(upto, max(low, -shift)), max(low, min(upto, self.h - shift))
                    made += [(down, 0.0, 0.0)] * (down > low) + [(up, 1.0, shift)] * (up > down) + [(upto, 0.0, 0.0)] * (upto > max(up, down))
                low = upto
            parts = [p for i, p in enumerate(made) if i + 1 == len(made) or p[1:] != made[i + 1][1:]]
        return [x for p in parts for x in p]

    def follow(self, state: State, piece: State) -> State:
        for i in range(0, len(piece), 3):
            if state[0] < piece[i] or i + 3 == len(piece):
                return [state[0] + piece[i + 2] if piece[i + 1] else piece[i + 2]]
        return state


Recursion = Ewma | Cusum


def segments(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple[tuple, int, int]]:
    """Runs of rows with equal keys as ``(key, start, stop)``; null equals null."""
    if not batch.num_rows:
        return []
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        codes, _ = pd.factorize(batch.column(k).to_pandas(), use_na_sentinel=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new).tolist()
    ends = [*starts[1:], batch.num_rows]
    return [(tuple(batch.column(k)[a].as_py() for k in keys), a, b) for a, b in zip(starts, ends, strict=True)]


def doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, missing ones as NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _nullable(fields: Sequence[StructField]) -> list[StructField]:
    return [StructField(f.name, f.dataType, True) for f in fields]


_STATES = ArrayType(ArrayType(DoubleType()))
_KIND, _PIECES, _ENDS, _CARRIED = "__kind", "__pieces", "__ends", "__carried"


def fold_each(df: DataFrame, keys: Sequence[str], time: str, made: dict[str, tuple[str, Recursion]]) -> DataFrame:
    """``df`` with one column per entry ``out: (input, recursion)``, all in one pass over the series in order of time.

    Missing values, NaN too, count as missing.  A series of any length, or one series without keys, is as
    many tasks as its rows fill ranges; a task holds a batch.  Columns of the added names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in made]
    fields = _nullable([*kept, *[StructField(o, DoubleType()) for o in made]])
    names, folds = [f.name for f in fields], list(made.values())

    def through(batches: Iterator[pa.RecordBatch], start: bool) -> Iterator[pa.RecordBatch]:
        """Results of a range; with ``start`` states come with the rows, else rows on the range's first and last series follow."""
        from pyspark import TaskContext

        last, states, count, pieces, row = None, [], 0, None, None
        for batch in batches:
            inputs, results = [doubles(batch, x) for x, _ in folds], [[] for _ in folds]
            for key, a, b in segments(batch, [RANGE, *keys] if start else keys):
                if not count or key != last:
                    last, count = key, count + 1
                    states = batch.column(_CARRIED)[a].as_py() if start else [r.begin() for _, r in folds]
                    pieces = [r.opened() for _, r in folds] if count == 1 and not start else pieces
                for i, (_, r) in enumerate(folds):
                    if count == 1 and not start:
                        pieces[i] = r.extend(pieces[i], inputs[i][a:b])
                    states[i], out = r.run(states[i], inputs[i][a:b])
                    results[i].append(out)
                if count == 1 or row is None:
                    first_row = batch.slice(a, 1)
                row = batch.slice(a, 1)
            columns = [pa.array(np.concatenate(r) if r else np.array([]), pa.float64(), from_pandas=True) for r in results]
            part = pa.array(np.full(batch.num_rows, TaskContext.get().partitionId()), pa.int32())
            more = [] if start else [part, pa.array(np.zeros(batch.num_rows), pa.int32()), *[pa.nulls(batch.num_rows, pa.list_(pa.list_(pa.float64())))] * 2]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns, *more], names if start else [*names, RANGE, _KIND, _PIECES, _ENDS])
        if not start and count:
            for told, of, ends in [(first_row, pieces, None)] + ([(row, None, states)] if count > 1 else []):
                blank = [told.column(f.name) if f.name in keys else pa.nulls(1, told.column(f.name).type) for f in kept]
                more = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([1], pa.int32()), *[pa.array([v], pa.list_(pa.list_(pa.float64()))) for v in (of, ends)]]
                yield pa.RecordBatch.from_arrays([*blank, *[pa.nulls(1, pa.float64())] * len(folds), *more], [*names, RANGE, _KIND, _PIECES, _ENDS])

    told = StructType([*fields, StructField(RANGE, IntegerType()), StructField(_KIND, IntegerType()), StructField(_PIECES, _STATES), StructField(_ENDS, _STATES)])
    placed = df.select(*[f.name for f in kept]).repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
    whole = materialize(placed.mapInArrow(lambda it: through(it, False), told), "folded")
    borders, rows = whole.filter(F.col(_KIND) == 1), whole.filter(F.col(_KIND) == 0)
    if borders.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows.select(*names)

    def carry(table: pa.Table) -> pa.Table:
        """The states with which each range after the first of a series begins."""
        table = table.sort_by(RANGE)
        states, out = [r.begin() for _, r in folds], []
        for pieces, ends in zip(table.column(_PIECES).to_pylist(), table.column(_ENDS).to_pylist(), strict=True):
            out.append(states)
            states = ends if pieces is None else [r.follow(s, p) for (_, r), s, p in zip(folds, states, pieces, strict=True)]
        carried = table.select([*keys, RANGE]).append_column(_CARRIED, pa.array(out, pa.list_(pa.list_(pa.float64()))))
        return carried.slice(1)

    by = StructType([*_nullable([df.schema[k] for k in keys]), StructField(RANGE, IntegerType()), StructField(_CARRIED, _STATES)])
    carried = materialize(borders.select(*keys, RANGE, _PIECES, _ENDS).groupBy(*keys).applyInArrow(carry, by), "carried")
    carried = F.broadcast(carried.withColumnsRenamed({c: f"__k_{c}" for c in [*keys, RANGE]}))  # two rows a range at most
    same = F.col(RANGE) == F.col(f"__k_{RANGE}")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    settled = rows.join(carried, same, "left_anti").select(*names)
    again = rows.join(carried, same).select(*[f.name for f in kept], RANGE, _CARRIED)
    again = again.repartition(RANGE).sortWithinPartitions(RANGE, *keys, time)
    return settled.unionByName(again.mapInArrow(lambda it: through(it, True), StructType(fields)))
