"""Streaming counterparts: windowed aggregates, and scores and alerts with state per key.

Each gives on a stream what its batch twin gives on the whole table.  Scores and alerts are made at once,
provided that rows of a key arrive in order across micro-batches (``replay`` makes such a stream of a table; a
row that arrives after later ones is taken after them), or, with ``late``, in order of time: rows are then held
until the watermark has passed them, and only rows that are later still are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventscope.sources.storage import scratch


def weekly_counts(stream: DataFrame, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Rows and sum per key and week from Monday, with rows later than the watermark dropped."""
    week = F.window(ts, "7 days", startTime="4 days")
    return stream.withWatermark(ts, late).groupBy(key, week.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("week_start"), "n", "total")


#: ``step(state, value) -> (state, result)``.
Step = Callable[[tuple, float | None], tuple[tuple, float | None]]


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


#: Buckets that keys are dealt to by hash: a call and a row of state each, so a micro-batch costs no call a key.
BUCKETS = 1024


def _per_row(stream: DataFrame, key: str, ts: str, value: str, start: tuple, state: str, step: Step, out: str, late: str | None = None, idle_days: int | None = None) -> DataFrame:
    """Add to every row what ``step(state, value) -> (state, result)`` gives in order of time.

    Keys are dealt to ``BUCKETS`` buckets; the state of a bucket holds the states of its keys, the keys as text.
    With ``late`` (a delay of the watermark) rows are held in the state of their bucket until the watermark passes
    them, which an event-time timer tells; a bucket's state holds the rows of that delay.  With ``idle_days`` a row
    that much later than the one before it starts anew; with both, a key that is idle for longer is let go.
    """
    kind, idle = stream.schema[key].dataType, None if idle_days is None else idle_days * 86_400_000_000
    made, width = f"{key} string, {ts} timestamp, {value} double, {out} double", len(start)

    def known(held: GroupState) -> tuple[list, list, list, list]:
        """Keys, their states and last times, and what else the state holds."""
        if not held.exists:
            return [], [], [], []
        names, *rest = held.get
        columns = [list(c) for c in rest[:width]]
        return list(names), list(zip(*columns, strict=True)), list(rest[width]), rest[width + 1 :]

    def coded(names: list, states: list, lasts: list, rows: pd.Series) -> np.ndarray:
        """The places of the rows' keys among ``names``, to which new ones are added."""
        codes, found = pd.factorize(rows, use_na_sentinel=False)
        at, places = {name: k for k, name in enumerate(names)}, []
        for name in found.tolist():
            name = name if isinstance(name, str) else None
            if name not in at:
                at[name] = len(names)
                names.append(name)
                states.append(start)
                lasts.append(0)
            places.append(at[name])
        return np.array(places, dtype=np.int64)[codes]

    def through(names: list, states: list, lasts: list, codes: np.ndarray, times: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        """Results of rows that are sorted by key and time; states and last times move on."""
        results, before, now, last = [], -1, start, 0
        for c, t, v in zip(codes.tolist(), times.tolist(), values.tolist(), strict=True):
            if c != before:
                if before >= 0:
                    states[before], lasts[before] = now, last
                before, now, last = c, states[c], lasts[c]
            now, last = start if last and idle is not None and t - last > idle else now, t
            now, y = step(now, None if v != v else v)
            results.append(y)
        if before >= 0:
            states[before], lasts[before] = now, last
        return pd.DataFrame({key: pd.Series(np.array(names, dtype=object)[codes], dtype=object), ts: pd.to_datetime(times, unit="us"), value: values, out: pd.Series(results, dtype="float64")})

    def sorted_rows(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By key and time, rows that are equal in both as they came, missing times last."""
        return np.lexsort((np.where(times == np.iinfo(np.int64).min, np.iinfo(np.int64).max, times), codes))

    def columns_of(states: list) -> list[list]:
        return [list(c) for c in zip(*states, strict=True)] if states else [[] for _ in range(width)]

    def at_once(_: tuple, groups: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names, states, lasts, _ = known(held)
        rows = pd.concat(list(groups))
        codes, times, values = coded(names, states, lasts, rows[key]), _micros(rows[ts]), rows[value].to_numpy(dtype=float)
        order = sorted_rows(codes, times)
        told = through(names, states, lasts, codes[order], times[order], values[order])
        held.update((names, *columns_of(states), lasts))
        yield told

    def in_order(_: tuple, groups: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        passed = held.getCurrentWatermarkMs() * 1000
        names, states, lasts, waiting = known(held)
        kinds = (np.int32, np.int64, np.float64)
        codes, times, values = (np.frombuffer(w, t) for w, t in zip(waiting, kinds, strict=True)) if waiting else (np.array([], t) for t in kinds)
        parts = [(codes, times, values)]
        for rows in groups:
            fresh = _micros(rows[ts])
            due = fresh > passed
            if due.any():
                parts.append((coded(names, states, lasts, rows[key][due]), fresh[due], rows[value].to_numpy(dtype=float)[due]))
        codes, times, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = sorted_rows(codes, times)
        codes, times, values = codes[order], times[order], values[order]
        ready = times <= passed
        told = through(names, states, lasts, codes[ready], times[ready], values[ready])
        codes, times, values = codes[~ready], times[~ready], values[~ready]
        if idle is not None:  # idle keys without rows that wait
            busy = np.zeros(len(names), dtype=bool)
            busy[codes] = True
            stay = busy | (np.array(lasts, dtype=np.int64) + idle >= passed)
            codes = (np.cumsum(stay) - 1)[codes]
            names, states, lasts = ([x for x, s in zip(xs, stay.tolist(), strict=True) if s] for xs in (names, states, lasts))
        if names:
            held.update((names, *columns_of(states), lasts, *[c.astype(t).tobytes() for c, t in zip((codes, times, values), kinds, strict=True)]))
            timers = [-(-int(times.min()) // 1000)] if len(times) else []
            if idle is not None:
                timers.append(max(-(-(min(lasts) + idle) // 1000), passed // 1000 + 1))
            if timers:
                held.setTimeoutTimestamp(min(timers))
        elif held.exists:
            held.remove()
        if len(told):
            yield told

    fields = [f.strip().rsplit(" ", 1) for f in state.split(",")]
    states_of = ", ".join(["keys array<string>", *[f"{n} array<{t}>" for n, t in fields], "last array<bigint>"])
    picked = stream.select(F.col(key).cast("string").alias(key), ts, value, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__bucket"))
    if late is None:
        told = picked.groupBy("__bucket").applyInPandasWithState(at_once, made, states_of, "append", GroupStateTimeout.NoTimeout)
    else:
        waiting = f"{states_of}, held_keys binary, held_ts binary, held_values binary"
        told = picked.withWatermark(ts, late).groupBy("__bucket").applyInPandasWithState(in_order, made, waiting, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col(key).cast(kind).alias(key), ts, value, out)


def past_z(stream: DataFrame, key: str, ts: str, value: str, min_periods: int = 52, late: str | None = None, idle_days: int | None = None) -> DataFrame:
    """Strictly-past z-score with count, mean and squared deviations as state."""

    def step(s: tuple, v: float | None) -> tuple[tuple, float | None]:
        n, mean, m2 = s
        z = None
        if v is not None:
            spread = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            z = (v - mean) / spread if n >= min_periods and spread > 0 else None
            n, gap = n + 1, v - mean
            mean += gap / n
            m2 += gap * (v - mean)
        return (n, mean, m2), z

    return _per_row(stream, key, ts, value, (0, 0.0, 0.0), "n long, mean double, m2 double", step, "z", late, idle_days)


def ewma(stream: DataFrame, key: str, ts: str, value: str, alpha: float, late: str | None = None, idle_days: int | None = None) -> DataFrame:
    def step(s: tuple, v: float | None) -> tuple[tuple, float | None]:
        (y,) = s
        if v is not None:
            y = v if y is None else alpha * v + (1 - alpha) * y
        return (y,), y

    return _per_row(stream, key, ts, value, (None,), "y double", step, "ewma", late, idle_days)


def cusum(stream: DataFrame, key: str, ts: str, value: str, k: float, h: float, late: str | None = None, idle_days: int | None = None) -> DataFrame:
    """1.0 where the sum reaches ``h``; the sum starts anew then and after a missing value."""

    def step(s: tuple, v: float | None) -> tuple[tuple, float | None]:
        total = 0.0 if v is None else max(0.0, s[0] + v - k)
        fires = v is not None and total >= h
        return (0.0 if fires else total,), float(fires)

    return _per_row(stream, key, ts, value, (0.0,), "total double", step, "alert", late, idle_days)


def persistence(stream: DataFrame, key: str, ts: str, value: str, at: float, k: int, n: int, late: str | None = None, idle_days: int | None = None) -> DataFrame:
    """1.0 where ``k`` of the last ``n`` values reach ``at``; the last flags are kept as bits."""

    def step(s: tuple, v: float | None) -> tuple[tuple, float | None]:
        seen, bits = min(n, s[0] + 1), ((s[1] << 1) | (v is not None and v >= at)) & ((1 << n) - 1)
        return (seen, bits), float(seen == n and bits.bit_count() >= k)

    return _per_row(stream, key, ts, value, (0, 0), "seen int, bits long", step, "alert", late, idle_days)


def first_mentions(stream: DataFrame, gate: Column, hit: Column, marker: str, ts: str, tie: str, late: str = "2 days") -> DataFrame:
    """``(marker, ts, tie)`` of each marker's earliest document that passes the gate and matches, the smallest ``tie`` among equals.

    The earliest so far is kept in the state and given out once the watermark has passed it, as nothing earlier
    can come then; documents later than that are dropped.  A marker is given out once, its state stays.  A row
    without a marker only moves the watermark (Spark filters before it looks at times).
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (marker, tie)}

    def run(k: tuple, groups: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        passed = held.getCurrentWatermarkMs() * 1000
        done, first, of = held.get if held.exists else (False, None, None)
        for rows in groups:
            found = [(t, x) for t, x in zip(_micros(rows[ts]).tolist(), rows[tie].tolist(), strict=True) if t > passed]
            if found and not done and k[0] is not None:
                first, of = min(found if first is None else [*found, (first, of)])
        told = []
        if first is not None and not done:
            if first <= passed:
                done, told = True, [(k[0], pd.Timestamp(first, unit="us"), of)]
            else:
                held.setTimeoutTimestamp(-(-first // 1000))
        if first is not None:
            held.update((done, first, of))
        if told:
            yield pd.DataFrame(told, columns=[marker, ts, tie])

    wanted = F.coalesce(gate & hit, F.lit(False)) | F.col(marker).isNull()
    picked = stream.withWatermark(ts, late).filter(wanted).select(marker, ts, tie)
    state = f"done boolean, first bigint, of {kinds[tie]}"
    return picked.groupBy(marker).applyInPandasWithState(run, f"{marker} {kinds[marker]}, {ts} timestamp, {tie} {kinds[tie]}", state, "append", GroupStateTimeout.EventTimeTimeout)


def closing_row(df: DataFrame, ts: str, days: int) -> DataFrame:
    """One row so many days after the last of ``df``, null but for its time: as the last part of a replay it moves the watermark past all others."""
    last = df.agg((F.max(ts) + F.make_interval(days=F.lit(days))).cast("timestamp").alias(ts))
    return last.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def replay_parts(parts: Sequence[DataFrame], name: str, files: int = 4) -> DataFrame:
    """A stream of the rows of ``parts``, one micro-batch each, from files in the shared folder.

    A micro-batch is so many files, so a part of fewer rows than that is made up with empty ones.
    """
    spark = parts[0].sparkSession
    path = scratch(spark, name)
    for k, part in enumerate(parts):
        into = f"{path}/part={k}"
        part.repartition(files).write.parquet(into)
        if k + 1 < len(parts):
            for _ in range(files - len(spark.read.schema(part.schema).parquet(into).inputFiles())):
                spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(into)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return source.parquet(path)


def files_for(rows: int, batches: int) -> int:
    """Files of a micro-batch: four, or as many as keep a file, which one task reads, near a quarter of a million rows."""
    return max(4, rows // batches // 250_000)


def replay(df: DataFrame, ts: str, name: str, batches: int = 4, files: int | None = None) -> DataFrame:
    """A stream of a table in order of time: spans that hold about as many rows each, one micro-batch each.

    Rows without a time come with the last span.
    With enough batches no micro-batch holds more of a key than a task can take.
    """
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches)])
    cuts, rows = df.agg(F.percentile_approx(F.unix_micros(ts), shares, F.lit(1000)), F.count("*")).first()
    cuts, files = cuts or [], files or files_for(rows, batches)
    bounds, at = [None, *sorted(set(cuts)), None], F.unix_micros(ts)
    inside = [reduce(Column.__and__, [at > lo if lo is not None else F.lit(True), at <= hi if hi is not None else F.lit(True)]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    inside[-1] = inside[-1] | at.isNull()
    return replay_parts([df.filter(c) for c in inside], name, files)


def state_partitions(spark: SparkSession) -> int:
    """Two partitions of state a core, 16 at least, and no more than the session's shuffle partitions.

    Each loads, commits and starts a Python runner in every micro-batch, whatever it holds, and adaptive execution
    does not join those of a stream.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 2 * spark.sparkContext.defaultParallelism))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Process everything that is there now and return the result as a table in the shared folder.

    In complete mode the last batch is the result, in append mode all batches together.  A query takes the
    session's settings as it starts, so ``state_partitions`` hold for it alone.
    """
    spark = stream.sparkSession
    base = scratch(spark, name)
    if mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    else:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions(spark))
    try:
        started = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def dropped_late(query) -> int:
    """Rows that the watermark dropped, over the progress reports that the query still holds."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])
