"""URL filters with a temporal list join.

A block list is a log of dated events: an entry (a domain) is added or removed on a day.  The log
becomes validity intervals, and every capture is judged by the entries active on the day it was
fetched: an as-of join on domain suffix and day.

Captures are reduced to distinct (host, day), and distinct hosts to those of their suffixes that the list
names, before days are looked at; intervals are dealt to buckets of days.  So neither a host with a third of
all captures, nor an ending that all hosts share, nor an entry with a long history makes one large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import free_name, join_small_or_large, materialize

BUCKET_DAYS = 32
#: The list's distinct entries are broadcast up to this many, else joined by shuffle.
BROADCAST_ENTRIES = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port or final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"\.$", "")
    return F.when(host != "", host)


def list_intervals(events: DataFrame) -> DataFrame:
    """``(entry, valid_from, valid_to)`` from ``(entry, day, action)`` with action ``add`` or ``remove``.

    ``valid_to`` is exclusive and null while the entry is still listed.  Of several events of an entry
    on one day a removal prevails.  Repeated events count once; rows with a null in any column are ignored.
    """
    states = (
        events.filter(F.col("entry").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
        .groupBy(F.lower("entry").alias("entry"), "day")
        .agg(F.bool_and(F.col("action") == "add").alias("listed"))
    )
    order = Window.partitionBy("entry").orderBy("day")  # a row per entry and day at most
    return states.withColumn("valid_to", F.lead("day").over(order)).filter("listed").select("entry", F.col("day").alias("valid_from"), "valid_to")


def labels_of(name: Column) -> Column:
    return F.split(name, r"\.")


def suffixes(host: Column, lengths: Column) -> Column:
    """Of a host and its parent domains those with one of so many labels; a long host is cut nowhere else."""
    names = labels_of(host)
    held = F.filter(lengths, lambda n: n <= F.size(names))
    return F.transform(held, lambda n: F.array_join(F.slice(names, -n, n), "."))


def verdicts(captures: DataFrame, events: DataFrame) -> DataFrame:
    """For distinct ``(host, day)`` of ``captures``: the longest active entry and since when, where there is one."""
    probes = materialize(captures.select("host", "day").filter("host is not null and day is not null").distinct(), "list-probes")
    intervals = materialize(list_intervals(events), "list-intervals")
    entries = materialize(intervals.select(F.col("entry").alias("suffix")).distinct(), "list-entries")
    lengths = entries.agg(F.collect_set(F.size(labels_of(F.col("suffix")))).alias("lengths"))
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(BUCKET_DAYS)).cast("int")
    last = probes.agg(F.max("day").alias("last"))
    spans = (
        intervals.crossJoin(F.broadcast(last))  # one row
        .filter(F.col("valid_from") <= F.col("last"))
        .withColumn("__to", F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last")))
        .withColumn("bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.col("__to")))))
        .select("entry", "bucket", "valid_from", "valid_to")
    )
    hosts = probes.select("host").distinct().crossJoin(F.broadcast(lengths))  # one row
    named = hosts.select("host", F.explode(suffixes(F.col("host"), F.col("lengths"))).alias("suffix"))
    listed = join_small_or_large(named, entries, "suffix", "left_semi", BROADCAST_ENTRIES)
    asked = probes.join(listed, "host").withColumn("__bucket", bucket(F.col("day")))
    active = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = asked.join(spans, (F.col("suffix") == F.col("entry")) & (F.col("__bucket") == F.col("bucket")) & active)
    best = hits.groupBy("host", "day").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "valid_from")).alias("m"))
    return best.select("host", "day", F.col("m.entry").alias("entry"), F.col("m.valid_from").alias("listed_on"))


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """All rows and columns of ``captures`` (``url``, ``day``, any others) with ``host``, ``blocked``, ``entry``, ``listed_on``.

    A capture is blocked if an entry equal to its host or to a parent domain is active on its day.
    Captures without a host or a day are not blocked.  Repeated rows are each judged; columns of the
    added names are replaced.  A host of any length is cut into as many endings as the list has lengths of entries.
    """
    made = captures.drop("host", "blocked", "entry", "listed_on").withColumn("host", host_of(F.col("url")))
    host, day = free_name(made, "other_host"), free_name(made, "other_day")
    found = verdicts(made, events).withColumnsRenamed({"host": host, "day": day})
    joined = made.join(found, (made["host"] == found[host]) & (made["day"] == found[day]), "left")
    return joined.drop(host, day).withColumn("blocked", F.col("entry").isNotNull())
