"""Time-series expressions over panels of many series.

Every function takes the columns that identify a series (``keys``) and the one that orders it
(``time``) and returns a Column.  Features named *past* use strictly earlier rows only.  Missing
values are nulls; a spread of zero gives null, never infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventscope.functions.ranks import past_pct_rank  # noqa: F401
from eventscope.functions.recursions import Cusum, Ewma, fold_each

Name = str | Column


def series(keys: Sequence[str], time: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def past(keys: Sequence[str], time: str, rows: int | None = None) -> WindowSpec:
    """Frame of all (or the last ``rows``) strictly earlier rows."""
    return series(keys, time).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def diff(x: Name, keys: Sequence[str], time: str, k: int = 1, delay: int = 0) -> Column:
    """Change over ``k`` rows, observed ``delay`` rows late."""
    w = series(keys, time)
    return F.lag(_col(x), delay).over(w) - F.lag(_col(x), k + delay).over(w)


def pct_change(x: Name, keys: Sequence[str], time: str, k: int = 1, delay: int = 0) -> Column:
    """Relative change over ``k`` rows, observed ``delay`` rows late; null on a zero base."""
    w = series(keys, time)
    return F.try_divide(F.lag(_col(x), delay).over(w), F.lag(_col(x), k + delay).over(w)) - 1


def level(x: Name, keys: Sequence[str], time: str, delay: int = 1) -> Column:
    return F.lag(_col(x), delay).over(series(keys, time))


def past_z(x: Name, keys: Sequence[str], time: str, min_periods: int = 52) -> Column:
    """Distance from the mean of all earlier values in their sample deviations."""
    w, v = past(keys, time), _col(x)
    z = F.try_divide(v - F.avg(v).over(w), F.nullif(F.stddev_samp(v).over(w), F.lit(0.0)))
    return F.when(F.count(v).over(w) >= min_periods, z)


def past_mean(x: Name, keys: Sequence[str], time: str, rows: int = 52, min_periods: int = 26) -> Column:
    w, v = past(keys, time, rows), _col(x)
    return F.when(F.count(v).over(w) >= min_periods, F.avg(v).over(w))


def past_seasonal_z(x: Name, keys: Sequence[str], time: str, min_periods: int = 5) -> Column:
    """Like ``past_z`` within one calendar month of earlier years and with the population deviation."""
    w, v = Window.partitionBy(*keys, F.month(time)).orderBy(time).rowsBetween(Window.unboundedPreceding, -1), _col(x)
    z = F.try_divide(v - F.avg(v).over(w), F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)))
    return F.when(F.count(v).over(w) >= min_periods, z)


def robust_z(df: DataFrame, x: str, keys: Sequence[str], time: str, rows: int = 52, min_periods: int = 26, out: str = "robust_z") -> DataFrame:
    """Distance from the rolling median in rolling MADs (times 1.4826), where each row's deviation is from its own median."""
    w = series(keys, time).rowsBetween(-(rows - 1), 0)
    enough = F.count(x).over(w) >= min_periods
    staged = df.withColumn("__med", F.when(enough, F.percentile(x, F.lit(0.5)).over(w))).withColumn("__dev", F.abs(F.col(x) - F.col("__med")))
    mad = F.when(F.count("__dev").over(w) >= min_periods, F.percentile("__dev", F.lit(0.5)).over(w))
    return staged.withColumn(out, F.try_divide(F.col(x) - F.col("__med"), F.nullif(1.4826 * mad, F.lit(0.0)))).drop("__med", "__dev")


def persistence(flag: Name, keys: Sequence[str], time: str, k: int, n: int) -> Column:
    """True when at least ``k`` of the last ``n`` rows are flagged and there are ``n`` rows."""
    w = series(keys, time).rowsBetween(-(n - 1), 0)
    hits = F.sum(F.coalesce(_col(flag), F.lit(False)).cast("int")).over(w)
    return (F.count(F.lit(1)).over(w) == n) & (hits >= k)


def cum_index(r: Name, keys: Sequence[str], time: str) -> Column:
    """Cumulated returns as an index that starts from 100; a missing return counts as none."""
    return F.exp(F.sum(F.log1p(F.coalesce(_col(r), F.lit(0.0)))).over(series(keys, time).rowsBetween(Window.unboundedPreceding, 0))) * 100


def drawdown(x: Name, keys: Sequence[str], time: str) -> Column:
    top = F.max(_col(x)).over(series(keys, time).rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(_col(x), top) - 1


def ffill(x: Name, keys: Sequence[str], time: str) -> Column:
    return F.last(_col(x), ignorenulls=True).over(series(keys, time).rowsBetween(Window.unboundedPreceding, 0))


def simple_return(price: Name, keys: Sequence[str], time: str) -> Column:
    return pct_change(price, keys, time, 1)


def step_change(x: Name, keys: Sequence[str], time: str) -> Column:
    """True where the value differs from the row before; false on the first row."""
    return F.coalesce(_col(x) != F.lag(_col(x)).over(series(keys, time)), F.lit(False))


def suffix_min(x: Name, keys: Sequence[str], time: str) -> Column:
    """Smallest value from the row on: a running minimum over the series read backwards."""
    return F.min(_col(x)).over(Window.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0))


def gap_days(keys: Sequence[str], time: str) -> Column:
    """Days since the row before."""
    return F.datediff(time, F.lag(time).over(series(keys, time)))


def week_ending_sunday(date: Name) -> Column:
    return F.next_day(F.date_sub(_col(date), 1), "Sun")


def ewma(df: DataFrame, keys: Sequence[str], time: str, x: str, alpha: float, out: str = "ewma") -> DataFrame:
    """Add the exponentially weighted mean without adjustment; a missing value carries the state on."""
    return fold_each(df, keys, time, {out: (x, Ewma(alpha))})


def cusum(df: DataFrame, keys: Sequence[str], time: str, z: str, k: float, h: float, out: str = "alert") -> DataFrame:
    """Add the upper CUSUM of a score: fires (1.0) when the sum reaches ``h`` and starts anew; a missing score starts it anew too."""
    return fold_each(df, keys, time, {out: (z, Cusum(k, h))})


def yoy(df: DataFrame, keys: Sequence[str], year: str, columns: Sequence[str], diffs: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_yoy`` ratios and ``<c>_diff`` differences to the adjacent year before, null across gaps."""
    every = list(dict.fromkeys([*columns, *diffs]))
    before = df.select(*keys, (F.col(year) + 1).alias(year), *[F.col(c).alias(f"__{c}") for c in every])
    joined = df.join(before, [*keys, year], "left")
    made = {f"{c}_yoy": F.try_divide(F.col(c), F.col(f"__{c}")) - 1 for c in columns} | {f"{c}_diff": F.col(c) - F.col(f"__{c}") for c in diffs}
    return joined.withColumns(made).drop(*[f"__{c}" for c in every])


def date_spine(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, step: str = "month", out: str = "date") -> DataFrame:
    """One row per key and step from ``lo`` to ``hi``; months are given by their last day."""
    days = F.sequence(F.trunc(lo, "month") if step == "month" else F.col(lo), F.col(hi), F.expr(f"interval 1 {step}"))
    point = F.explode(days)
    made = bounds.select(*keys, point.alias(out))
    return made.withColumn(out, F.last_day(out)) if step == "month" else made


def resample_week(df: DataFrame, keys: Sequence[str], date: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per key and calendar week ending on Sunday, with zeros for weeks without rows between the first and the last."""
    weekly = df.groupBy(*keys, week_ending_sunday(date).alias("week")).agg(*[c.alias(n) for n, c in aggregates.items()])
    spine = date_spine(weekly.groupBy(*keys).agg(F.min("week").alias("lo"), F.max("week").alias("hi")), keys, "lo", "hi", "week", "week")
    return spine.join(weekly, [*keys, "week"], "left").fillna(0, list(aggregates))


def resample_month(df: DataFrame, keys: Sequence[str], date: str, aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, F.date_format(date, "yyyy-MM").alias("month")).agg(*[c.alias(n) for n, c in aggregates.items()])


def top_k(df: DataFrame, by: Column, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows of each key in the given order, with their ``place``; without keys a plain ordered limit."""
    if not keys:
        return df.orderBy(by).limit(k)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter(F.col("place") <= k)
