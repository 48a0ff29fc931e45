"""Readers and writers, and the shaping of raw tables on the way in."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions.columns import finite


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN read as null in all floating columns."""
    df = spark.read.parquet(path)
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}) if any(t in ("double", "float") for _, t in df.dtypes) else df


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """CSV with a stated schema (so keys stay strings), plain or gzipped, and optionally some columns only."""
    df = spark.read.csv(path, schema=schema, header=header)
    return df.select(*columns) if columns else df


def read_csv_with_preamble(spark: SparkSession, path: str, marker: str, schema: str) -> DataFrame:
    """CSV rows after the header line that starts with ``marker``; what stands above is dropped, file by file.

    The table of headers has a row per file; Spark broadcasts it while it is small.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    heads = lines.filter(F.col("value").startswith(marker)).groupBy("file").agg(F.min("at").alias("head"))
    body = lines.join(heads, "file").filter((F.col("at") > F.col("head")) & (F.trim("value") != ""))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def scan_windows(spark: SparkSession, path: str, windows: Sequence[tuple[str, str]], columns: Sequence[str], date: str = "date") -> DataFrame:
    """Some columns of a sharded Parquet table within any of several date ranges; the ranges reach the scan.

    Spark skips corrupt shards and logs each in the executor's log (``Skipped the rest of the content in the corrupted file``).
    """
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    kind = df.schema[date].dataType
    inside = reduce(Column.__or__, [F.col(date).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)) for lo, hi in windows])
    return df.filter(inside).select(*columns)


def project_by_position(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Columns by ordinal under new names."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for i, n in names.items()])


def keep_dated_rows(df: DataFrame, column: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Rows whose cell is a date; headings and notes go."""
    return df.filter(F.try_to_timestamp(F.col(column).cast("string"), F.lit(pattern)).isNotNull())


def select_by_header_keyword(df: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """First column whose header holds each keyword (any case), under the given name; absent ones are left out."""
    found = {name: next((c for c in df.columns if word.lower() in c.lower()), None) for name, word in keywords.items()}
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items() if c])


def add_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one quotient per entry ``name: (above, below)``; null over zero or without a value."""
    return df.withColumns({n: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0))) for n, (a, b) in ratios.items()})


UNITS = {"us": F.timestamp_micros, "ms": F.timestamp_millis, "s": F.timestamp_seconds}


def infer_epoch_unit(df: DataFrame, column: str, years: tuple[int, int] = (1750, 1950)) -> tuple[str | None, DataFrame]:
    """Unit (us, ms, s or ns) that puts most values into a range of years, and ``df`` with the column as timestamp.

    One aggregation tries all units.  Without a share above one half the unit is None and the column stays.
    """
    raw = F.col(column).cast("long")
    safe = {n: F.when(F.abs(raw) < 9 * 10**15, raw) for n in ("ms", "s")} | {"us": raw, "ns": F.floor(raw / 1000).cast("long")}
    limit = {"ms": 10**14, "s": 10**11}
    as_ts = {n: (UNITS.get(n, F.timestamp_micros))(F.when(F.abs(v) < limit[n], v) if n in limit else F.when(F.abs(v) < 10**17, v)) for n, v in safe.items()}
    order = ("us", "ms", "s", "ns")
    shares = df.agg(*[F.avg(F.coalesce(F.year(as_ts[n]).between(*years), F.lit(False)).cast("double")).alias(n) for n in order]).first()
    best = max(order, key=lambda n: (shares[n] or 0.0, -order.index(n)))
    if (shares[best] or 0.0) <= 0.5:
        return None, df
    return best, df.withColumn(column, as_ts[best])


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def filter_country(df: DataFrame, name: str, code: str, by_name: str = "country", by_code: str = "iso", order: str = "year") -> DataFrame:
    """Rows of one country by name, or by code where the table has no such name."""
    named = F.upper(by_name) == name.upper()
    if by_name in df.columns and not df.filter(named).isEmpty():
        return df.filter(named).orderBy(order)
    return df.filter(F.upper(by_code) == code.upper()).orderBy(order)


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """``(column, type, filled, distinct, low, high)`` in one pass; distinct counts are approximate unless ``exact``, which shuffles every column."""
    simple = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counts = df.agg(*[a.alias(f"{n}{k}") for k, (c, _) in enumerate(simple) for n, a in (("f", F.count(F.col(f"`{c}`"))), ("d", distinct(F.col(f"`{c}`"))), ("l", F.min(F.col(f"`{c}`")).cast("string")), ("h", F.max(F.col(f"`{c}`")).cast("string")))])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), *[F.col(f"{n}{k}").alias(name) for n, name in (("f", "filled"), ("d", "distinct"), ("l", "low"), ("h", "high"))]) for k, (c, t) in enumerate(simple)]
    return counts.select(F.inline(F.array(*rows)))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, modified, sha256)`` of every file; each file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a table; arrays become ``;``-joined text in CSV."""
    if kind == "csv":
        flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)
