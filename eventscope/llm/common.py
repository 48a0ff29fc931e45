"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.sources.storage import materialize, shared_dir

__all__ = ["SPACE", "WORD", "free_name", "grouped", "join_classes", "join_small_or_large", "let", "materialize", "packed", "read_table", "running", "shared_dir", "unpacked", "whole_text", "words"]

#: White space as the contracts define it, and a word: a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline a projected column into a lambda, where it would be evaluated for every
    element; a one-element ``transform`` binds it instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that ``running`` folds at a time.
RUN = 64


def running(values: Column, plus: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The results of ``plus`` over the first 1, 2, ... elements of an array, with ``zero`` neutral.

    Blocks of ``RUN`` elements are folded by themselves and then moved by what lies before them, as a fold
    over a whole array would copy its growing result at every element.
    """

    def fold(array: Column) -> Column:
        start = F.filter(F.array(zero), lambda _: F.lit(False))
        return F.aggregate(array, start, lambda acc, x: F.concat(acc, F.array(plus(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x))))

    def move(blocks: Column) -> Column:
        tops = F.concat(F.array(zero), fold(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return let(tops, lambda before: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: plus(F.get(before, k), x)))))

    starts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
    cut = lambda v: F.transform(starts(v), lambda k: fold(F.slice(v, k * RUN + 1, F.lit(RUN))))
    return F.when(F.size(values) > 0, let(values, lambda v: let(cut(v), move))).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitively): ``stem`` or ``stem_k``."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def join_small_or_large(big: DataFrame, keys: DataFrame, on: str, how: str, bound: int) -> DataFrame:
    """Join ``keys``, a written table, to ``big``: broadcast while it has at most ``bound`` rows.

    The row count is read from the files; a larger table takes part in a shuffled join, whose
    skewed partitions Spark's adaptive execution splits.  Null keys meet null keys.
    """
    other = free_name(big, f"{on}_other")
    side = keys.withColumnRenamed(on, other)
    if keys.count() <= bound:
        side = F.broadcast(side)
    joined = big.join(side, big[on].eqNullSafe(side[other]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(side[other])


#: Classes with more members are frequent, and so many of them at most are broadcast.
FREQUENT, FREQUENT_CLASSES = 256, 10_000


def join_classes(members: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of ``members`` to their ``classes`` (a written table with the number of members in ``size``) on keys that are not null.

    The most frequent classes, a bounded number, are broadcast; the rest is shuffled.  So a class with a third of
    all members is no task of its own.
    """
    often = materialize(classes.filter(F.col(size) > FREQUENT).orderBy(F.col(size).desc(), *keys).limit(FREQUENT_CLASSES), "frequent-classes")
    marks = F.broadcast(often.select(*keys))
    rest = members.join(marks, keys, "left_anti").join(classes.join(marks, keys, "left_anti"), keys, "left")
    return members.join(F.broadcast(often), keys).unionByName(rest)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows that follow each other with equal keys, each as one table."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        for k in range(batch.num_rows):
            if at[k] != key:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held, start = at[k], [], k
        held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the whole row as one more: other columns cannot clash with what an operator adds.

    ``unpacked`` gives the original columns back.
    """
    return docs.select(*needed, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"))


def unpacked(made: DataFrame, **added: Column) -> DataFrame:
    """The rows that ``packed`` packed, with columns added or replaced."""
    row = F.col("__row")
    fields = [f.name for f in made.schema["__row"].dataType.fields]
    replaced = {name.lower() for name in added}
    kept = [row.getField(f).alias(f) for f in fields if f.lower() not in replaced]
    return made.select(*kept, *[c.alias(name) for name, c in added.items()])
