"""Rows in order, dealt to ranges: work along an order of any length in tasks of bounded size.

``dealt`` sorts a table into range partitions and writes it with their numbers, which rise with the order.
What a row needs to know of all rows before it then comes in two parts: from the rows of its own range, and
from one row a range that sums up what lies before.  No task holds more than a range, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.sources.storage import materialize

#: The number of a row's range.
RANGE = "__range"


def same_keys(keys: Sequence[str], other: str) -> Column:
    """Equality of key columns with those of a table whose key columns begin with ``other``; null meets null."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys], F.lit(True))


def named(df: DataFrame, keys: Sequence[str], other: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{other}{k}" for k in keys})


def dealt(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df``, written, with the number of its range in the given order; rows that are equal in it share a range."""
    return materialize(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), name)


def before(placed: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per key and range of a dealt table: sums over all earlier ranges of the key (0 if there are none), and ``__n_<name>`` over its own.

    A window over one row a key and range; joined by ``__<key>`` and range, so to speak, with ``with_before``.
    """
    own = placed.groupBy(*keys, RANGE).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__n_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumns({n: F.coalesce(F.sum(f"__n_{n}").over(earlier), F.lit(0)) for n in sums})


def running(placed: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``placed`` with sums over all rows of the key up to each row and those equal to it in the order.

    ``order`` is that in which the table was dealt, after the keys.
    """
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    earlier = named(before(placed, keys, sums).select(*keys, RANGE, *[F.col(n).alias(f"__b_{n}") for n in sums]), [*keys, RANGE], "__k_")
    joined = summed.join(earlier, same_keys([*keys, RANGE], "__k_"))
    return joined.select(*placed.columns, *[(F.coalesce(n, F.lit(0)) + F.col(f"__b_{n}")).alias(n) for n in sums])


def dominance(values: np.ndarray, weights: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """For each place the weight of the earlier places with a value at or below its own (and of its group).

    Sorted halves are merged from single places up: the values of a right half are sought in its left half,
    all pairs of halves at once.
    """
    n = len(values)
    count = np.zeros(n, dtype=np.int64)
    if n < 2:
        return count
    weights = np.ones(n, dtype=np.int64) if weights is None else np.asarray(weights, dtype=np.int64)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    group = np.zeros(n, dtype=np.int64) if group is None else np.unique(group, return_inverse=True)[1].astype(np.int64)
    size, groups = int(rank.max()) + 1, int(group.max()) + 1
    key, order, width = group * size + rank, np.arange(n), 1
    span = size * groups
    while width < n:
        half = order // width
        paired = (half // 2) * span
        at = np.argsort(paired + key[order], kind="stable")  # equal keys stay in their order
        order, half, paired = order[at], half[at], paired[at]
        left = half % 2 == 0
        # sums over left halves in order of pair, group and value
        total = np.concatenate([[0], np.cumsum(np.where(left, weights[order], 0))])
        sought = paired + key[order]
        upto = total[np.searchsorted(sought, sought[~left], "right")]
        start = total[np.searchsorted(sought, paired[~left] + group[order[~left]] * size, "left")]
        count[order[~left]] += upto - start
        width *= 2
    return count
