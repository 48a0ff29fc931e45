"""Scalar expressions: tolerant casts, row-wise measures, guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(column: Column) -> Column:
    """Number, or null where the text is none; thousands separators are dropped."""
    return F.regexp_replace(F.trim(column.cast("string")), ",", "").try_cast("double")


def to_date_lenient(column: Column, formats: Sequence[str] = ("d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy")) -> Column:
    """First format that fits, day before month; ``Sept`` is read as ``Sep``."""
    text = F.regexp_replace(F.trim(column.cast("string")), r"(?i)\bsept\b", "Sep")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def sum_nullable(*columns: Column) -> Column:
    """Sum of what is there; null if nothing is."""
    total = reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.when(F.coalesce(*columns).isNotNull(), total)


def row_mean(*columns: Column) -> Column:
    """Mean of the non-null columns; null without any."""
    count = reduce(Column.__add__, [c.isNotNull().cast("int") for c in columns])
    return sum_nullable(*columns) / F.nullif(count, F.lit(0))


def row_argmax(columns: dict[str, Column]) -> Column:
    """Name of the largest absolute value, the first in alphabetical order on ties; null without values."""
    held = F.filter(F.array(*[F.struct(F.abs(c).alias("v"), F.lit(n).alias("n")) for n, c in columns.items()]), lambda s: s["v"].isNotNull())
    best = F.aggregate(
        held, F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("n")),
        lambda a, s: F.when(a["v"].isNull() | (s["v"] > a["v"]) | ((s["v"] == a["v"]) & (s["n"] < a["n"])), F.struct(s["v"].cast("double").alias("v"), s["n"].alias("n"))).otherwise(a),
    )
    return best["n"]


def row_max_abs(*columns: Column) -> Column:
    return F.array_max(F.array(*[F.abs(c) for c in columns]))


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def null_outside(column: Column, low: float, high: float) -> Column:
    return F.when(column.between(low, high), column)


def finite(column: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)


def complete(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def transaction_type(discount: Column, advance: Column) -> Column:
    d, a = F.coalesce(discount, F.lit(0.0)) > 0, F.coalesce(advance, F.lit(0.0)) > 0
    return F.when(d & a, "discount+advance").when(d, "discount").when(a, "advance").otherwise("other")


def flag_contains(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


def on_weekday(date: Column, weekday: str) -> Column:
    return F.date_format(date, "EEEE") == weekday


def business_day(date: Column) -> Column:
    """Any day but Sunday."""
    return F.weekday(date) != 6


def quality_gate(quality: Column, words: Column, least_quality: float = 0.70, least_words: int = 40) -> Column:
    return F.coalesce((quality >= least_quality) & (words >= least_words), F.lit(False))
