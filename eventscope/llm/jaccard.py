"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, hashed to 64 bits and sorted by hash.  If two
sets reach the similarity, any two prefixes of l tokens beyond the least (the first ``n - o + l`` of
n tokens, o being the least overlap) share at least l tokens.  Tokens of many documents make
candidates dear, so each document takes the shortest prefix whose tokens outside of long posting
lists still must match:

* A list is long if more than ``LONG_LIST`` documents hold its token.
* With l extra tokens and h of its prefix tokens in long lists, every partner of a document shares
  l - h tokens or more in short lists.  If that is 1 at least, the document is settled: its partners
  are found in short lists alone, and only pairs that share the required number are kept.
* The others go on to the next level: among themselves, with a longer prefix and more required matches.
* What no level settles (near copies in large families, and texts that are mostly passages of many
  others) orders its whole set by rising frequency.  Any order of tokens will do for the least prefix,
  so only documents that share one of their rarest tokens are tied together, by one star per list.

Candidates make families, and each family is compared exactly in blocks of bounded size; a block
returns a spanning forest of its links, never all pairs.  Documents meet only where their sizes allow a
link.  In a large family each document is first compared with a few centres; those that link with one
are of its component already and need no comparison with each other, so that a family of near copies
costs its size, not its square.  Exact copies are one set from the start.

Tokens that a sample shows to be very frequent are dealt out by document, not by token alone, and count as
long lists.  Which tokens these are changes the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import join_classes, join_small_or_large, let, materialize, whole_text, words
from eventscope.operators.components import connected_components

#: Lists of more documents are not searched for pairs.
LONG_LIST = 64
#: Extra prefix tokens by level, as a share of the set; the last level takes whole sets.
LEVELS = (0.05, 0.3, 1.0)
#: Documents and tokens of one side of a block on average, and columns of its matrix at a time.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 1_000_000, 16_384
#: Families of more documents or tokens are split and have centres, so many for each class of sizes.
LARGE_FAMILY, LARGE_TOKENS, CENTRES = 512, 2_000_000, 16
#: Sets in the sample that shows very frequent tokens, sets of it that hold one at least, such tokens at most, and parts they are dealt to.
HOT_SAMPLE, HOT_LEAST, HOT_TOKENS, HOT_PARTS = 50_000, 50, 100_000, 64
#: Keys are broadcast up to this many rows (about 16 MB), else joined by shuffle.
BROADCAST_ROWS = 250_000

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: Column, size: int) -> Column:
    """Sorted distinct hashes of the word shingles; fewer words than ``size`` are one shingle, none are none."""
    lower = F.when(text.rlike("[A-Z]"), F.translate(text, *_ASCII)).otherwise(text)

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
        some = F.when(F.size(w) >= size, F.sort_array(F.array_distinct(grams))).otherwise(F.array(F.xxhash64(w)))
        return F.when(F.size(w) > 0, some).otherwise(F.array().cast("array<bigint>"))

    return let(words(lower), of)


def _least_overlap(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("int")


def _extra(n: Column, percent: int, share: float) -> Column:
    """Extra prefix tokens l: 1 and a share of the set, at most the least overlap."""
    return F.least(F.lit(1) + F.floor(n * share).cast("int"), _least_overlap(n, percent))


def _prefix_size(n: Column, percent: int, share: float) -> Column:
    return n - _least_overlap(n, percent) + _extra(n, percent, share)


def _hot_tokens(sets: DataFrame, key: str) -> DataFrame:
    """``(token, hot)`` of the most frequent prefix tokens in a sample of sets, dealt by their ``key``; a bounded table."""
    share = min(1.0, HOT_SAMPLE / max(1, sets.count()))
    sample = sets.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).dropDuplicates([key])
    counted = sample.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT_LEAST)
    return materialize(counted.orderBy(F.col("c").desc(), "token").limit(HOT_TOKENS).select("token", F.lit(True).alias("hot")), "jaccard-hot")


def _level(prefixes: DataFrame, hot: DataFrame, percent: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level over ``(rep, n, prefix)``: candidate pairs, unsettled ``rep``s, and postings of shared tokens."""
    held = prefixes.select("rep", "n", F.explode("prefix").alias("token")).join(F.broadcast(hot), "token", "left")  # HOT_TOKENS rows at most
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    held = held.withColumn("part", part).repartition("token", "part")
    counted = held.groupBy("token", "part").agg(F.count("*").alias("df"), F.max("hot").alias("any_hot")).filter("df > 1 or any_hot").drop("any_hot")
    joined = held.join(counted.hint("shuffle_hash"), ["token", "part"])
    shared = materialize(joined.select("token", "rep", "n", F.when(F.col("hot"), F.lit(2**62)).otherwise(F.col("df")).alias("df")), "jaccard-postings")
    long = shared.groupBy("rep", "n").agg(F.count_if(F.col("df") > LONG_LIST).cast("int").alias("h"))
    # a partner has percent % of the tokens at least; its l counts if it is smaller
    sure = _extra(_least_overlap(F.col("n"), percent), percent, share)
    state = materialize(long.withColumn("l", _extra(F.col("n"), percent, share)).withColumn("settled", sure > F.col("h")), "jaccard-state")
    short = shared.filter(F.col("df") <= LONG_LIST).select("token", "rep", "n")
    x = short.select("token", F.col("rep").alias("x"), F.col("n").alias("nx"))
    y = short.select("token", F.col("rep").alias("y"), F.col("n").alias("ny"))
    near = (F.col("x") < F.col("y")) & (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("ny") * 100 >= F.col("nx") * percent)
    pairs = x.join(y, "token").filter(near).groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"))
    for side in ("x", "y"):
        of = state.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("h").alias(f"h{side}"), F.col("l").alias(f"l{side}"), F.col("settled").alias(f"s{side}"))
        pairs = pairs.join(of, [side, f"n{side}"])
    pairs = pairs.filter((F.col("sx") | F.col("sy")) & (F.col("c") >= F.least("lx", "ly") - F.least("hx", "hy")))
    # with tokens of long lists, the whole requirement
    for side in ("x", "y"):
        of = prefixes.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("prefix").alias(f"p{side}"))
        pairs = pairs.join(of, [side, f"n{side}"])
    least = F.least("lx", "ly")
    first = lambda side: F.slice(f"p{side}", 1, F.col(f"n{side}") - _least_overlap(F.col(f"n{side}"), percent) + least)
    pairs = pairs.filter(F.size(F.array_intersect(first("x"), first("y"))) >= least)
    return materialize(pairs.select("x", "y"), "jaccard-pairs"), state.filter(~F.col("settled")).select("rep", "n"), shared


def _stars(shared: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Edges from the first to the other unsettled documents of each list, over the least prefixes by rising frequency.

    ``shared`` has the whole sets but for tokens of one document, which are the rarest of all.
    """
    held = shared.join(left, ["rep", "n"], "left_semi")
    of = Window.partitionBy("rep", "n")  # a document's own tokens
    placed = held.withColumns({"place": F.row_number().over(of.orderBy("df", "token")), "m": F.count("*").over(of)})
    alone = F.col("n") - F.col("m")
    prefix = placed.filter(F.col("place") + alone <= F.col("n") - _least_overlap(F.col("n"), percent) + 1).select("token", "rep")
    first = prefix.groupBy("token").agg(F.min("rep").alias("x"))
    return prefix.join(first, "token").filter("x < rep").select("x", F.col("rep").alias("y")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links in each block pair; rows of a pair follow each other."""
    key, rows = None, []
    for batch in batches:
        sets = batch.column("tokens")
        values, offsets = np.asarray(sets.values), np.asarray(sets.offsets)
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("family", "left", "right")], strict=True))
        for k, (rep, side) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("mine").to_pylist(), strict=True)):
            if keys[k] != key:
                if rows:
                    yield _links(key, rows, percent)
                key, rows = keys[k], []
            rows.append((rep, side, values[offsets[k] : offsets[k + 1]].copy()))
    if rows:
        yield _links(key, rows, percent)


def _links(key: tuple, rows: list, percent: int) -> pa.RecordBatch:
    reps = [r for r, _, _ in rows]
    sizes = np.array([len(t) for _, _, t in rows])
    side = np.array([b for _, b, _ in rows])
    a, b = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
    tokens, where = np.unique(np.concatenate([t for _, _, t in rows]), return_inverse=True)
    often = np.bincount(where, minlength=len(tokens)) > 1
    column = np.cumsum(often) - 1
    doc, keep = np.repeat(np.arange(len(rows)), sizes), often[where]
    doc, column = doc[keep], column[where[keep]]
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for start in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(rows), min(COLUMNS, int(often.sum()) - start)), dtype=np.float32)
        held[doc[lo:hi], column[lo:hi] - start] = 1
        common += held[a] @ held[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero((common > 0) & (100 * common.astype(np.int64) >= percent * union.astype(np.int64))), strict=True):
        i, j = int(a[i]), int(b[j])
        if root(i) != root(j):
            parent[root(i)] = root(j)
            out.append((reps[i], reps[j]))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["src", "dst"])


def link_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, k1, k2)`` of every row, and ``(n, k1, k2, copies, component)`` of every set that is not empty."""
    text = docs.select("doc_id", whole_text().alias("text"))
    hashed = text.select("doc_id", shingle_hashes(F.col("text"), size).alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(size), F.reverse("s")).alias("k2"),
        F.slice("s", 1, _prefix_size(F.size("s"), percent, LEVELS[0])).alias("prefix"),
    )
    members = materialize(hashed, "jaccard-sets")
    classes = members.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    prefixes, hot = classes.select("rep", "n", "prefix"), _hot_tokens(members.filter("n > 0"), "k1")
    edges = None
    for k, share in enumerate(LEVELS):
        pairs, left, shared = _level(prefixes, hot, percent, share)
        edges = pairs if edges is None else edges.unionByName(pairs)
        last = k + 1 == len(LEVELS)
        if last or left.isEmpty():
            break
        prefixes = materialize(_sets_of(text, left, size).withColumn("prefix", F.slice("tokens", 1, _prefix_size(F.col("n"), percent, LEVELS[k + 1]))).drop("tokens"), "jaccard-prefixes")
        hot = _hot_tokens(prefixes, "rep")
    if last:
        edges = edges.unionByName(_stars(shared, left, percent))
    family = connected_components(edges, "x", "y").withColumnsRenamed({"node": "rep", "component": "family"})
    family = materialize(_sets_of(text, family, size), "jaccard-families")
    component = connected_components(_compare(family, percent)).withColumnsRenamed({"node": "rep"})
    found = members.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = found.join(component, "rep", "left").select("n", "k1", "k2", "copies", F.coalesce("component", "rep").alias("component"))
    return members.drop("prefix"), materialize(classes, "jaccard-classes")


def _sets_of(text: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """``(rep, n, tokens)`` for the documents named by ``reps``, with the other columns of ``reps``.

    Empty sets are not filtered here: such a filter would move below the join and hash every text.
    """
    named = materialize(reps.drop("n").distinct(), "jaccard-reps").withColumnRenamed("rep", "doc_id")
    wide = join_small_or_large(text, named, "doc_id", "inner", BROADCAST_ROWS).withColumn("tokens", shingle_hashes(F.col("text"), size))
    return wide.drop("text").withColumnRenamed("doc_id", "rep").withColumn("n", F.size("tokens"))


def _dealt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``family, bucket, grp, ...``) with a ``block`` each, and the number of blocks of each ``family, bucket, grp``."""
    keys = ["family", "bucket", "grp"]
    enough = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)
    sizes = materialize(docs.groupBy(*keys).agg(F.ceil(enough).cast("int").alias("blocks")), "jaccard-blocks")
    dealt = docs.join(sizes, keys)  # blocks are dealt by hash and hold BLOCK documents on average
    return dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks"), sizes


_NAME = ("bucket", "grp", "block")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside each ``family, left, right`` of ``rows`` between documents whose block ``mine`` is the one or the other."""
    keys = ["family", "left", "right"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _blocks(it, percent), "src bigint, dst bigint")


def _centre_links(docs: DataFrame, percent: int) -> DataFrame:
    """Links of each document with the centres of its family and bucket: the ``CENTRES`` first by hash."""
    dealt, sizes = _dealt(docs)
    order = Window.partitionBy("family", "bucket").orderBy(F.xxhash64("rep"), "rep")
    centres = docs.select("family", "bucket", "rep").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CENTRES).select("rep")
    named = materialize(centres, "jaccard-centres")
    sent = join_small_or_large(docs, named, "rep", "left_semi", BROADCAST_ROWS).join(sizes, ["family", "bucket", "grp"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.concat_ws(":", "bucket", "block")
    rows = [side.select("family", "rep", "tokens", block.alias("left"), F.lit("centres").alias("right"), mine.alias("mine")) for side, mine in ((dealt, block), (sent, F.lit("centres")))]
    return _met(rows[0].unionByName(rows[1]), percent)


def _split(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links with centres in large families ``(rep, family, n, tokens)``, and the rows to compare block against block.

    Two sets link only in the same or the next ``bucket`` of sizes.  Documents of one ``grp`` are of one
    component through links with centres; -1 stands for none.
    """
    width = math.log(100 / percent) * 1.001 if percent < 100 else 1e-3
    docs = docs.withColumn("bucket", F.floor(F.log("n") / width).cast("int"))
    centred = materialize(_centre_links(docs.withColumn("grp", F.lit(-1).cast("long")), percent), "jaccard-centred")
    grouped = connected_components(centred).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    docs = docs.join(grouped, "rep", "left").withColumn("grp", F.coalesce("grp", F.lit(-1).cast("long")))
    dealt, sizes = _dealt(docs)
    others = sizes.select("family", *[F.col(c).alias(f"other_{c}") for c in ("bucket", "grp", "blocks")])
    known = (F.col("grp") == F.col("other_grp")) & (F.col("grp") >= 0)
    pairs = sizes.drop("blocks").join(others, "family").filter((F.abs(F.col("bucket") - F.col("other_bucket")) <= 1) & ~known)
    wide = dealt.join(pairs, ["family", "bucket", "grp"]).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    mine, other = F.concat_ws(":", *_NAME), F.concat_ws(":", *[f"other_{c}" for c in _NAME])
    return centred, wide.select("family", "rep", "tokens", F.least(mine, other).alias("left"), F.greatest(mine, other).alias("right"), mine.alias("mine"))


def _compare(family: DataFrame, percent: int) -> DataFrame:
    """Spanning links of the families in ``(rep, family, n, tokens)``: each small one in one block, large ones split."""
    held = family.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    large = materialize(held.filter((F.col("m") > LARGE_FAMILY) | (F.col("all") > LARGE_TOKENS)).select("family", F.lit(True).alias("large")), "jaccard-large")
    marked = join_small_or_large(family, large, "family", "left", BROADCAST_ROWS)
    whole = F.lit("")
    rows = marked.filter("large is null").select("family", "rep", "tokens", whole.alias("left"), whole.alias("right"), whole.alias("mine"))
    if large.isEmpty():
        return materialize(_met(rows, percent), "jaccard-links")
    centred, split = _split(marked.filter("large").drop("large"), percent)
    return centred.unionByName(materialize(_met(rows.unionByName(split), percent), "jaccard-links"))


def components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs`` (``doc_id, text``).

    Two documents link when 100 * intersection >= percent * union of their shingle sets; the component
    is the smallest ``doc_id`` reachable by links.  Rows without words have no shingles and link with
    nothing.  Rows of one ``doc_id`` are one document whose texts all count for links.  A null ``doc_id``
    has no component and links with nothing.
    """
    members, classes = link_classes(docs, size, percent)
    joined = join_classes(members.filter("n > 0"), classes, ["n", "k1", "k2"], "copies").drop("copies")
    joined = joined.unionByName(members.filter("n = 0").withColumn("component", F.col("doc_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` without near copies: the smallest ``doc_id`` of each component stays.

    Of several rows of that ``doc_id`` one stays; rows with a null ``doc_id`` all stay.
    """
    found = materialize(components(docs, size, percent), "jaccard-components")
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    kept = join_small_or_large(docs, gone, "doc_id", "left_anti", BROADCAST_ROWS)
    twice = materialize(found.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id"), "jaccard-twice")
    if twice.isEmpty():
        return kept
    once = join_small_or_large(kept, twice, "doc_id", "left_anti", BROADCAST_ROWS)
    return once.unionByName(join_small_or_large(kept, twice, "doc_id", "left_semi", BROADCAST_ROWS).dropDuplicates(["doc_id"]))
