"""Near-duplicate embeddings by NN-descent.

A neighbour graph is started from random-projection buckets and refined by joining neighbours of
neighbours: around every vector its neighbours, forward and reverse, meet and improve each other's
lists.  A list whose last neighbour still passes the threshold is saturated and is enlarged.  Rounds
end when few lists gain a neighbour at the threshold.  Edges at or above the threshold give
components.

Recall is audited against exact search for a bounded set of queries, others in every pass; links that an audit
finds and the graph missed are kept from then on.  While recall is short, more buckets and rounds are added,
and where that does not help, all vectors are compared exactly.

A list that is saturated at its greatest length may lack links to other groups.  Such vectors are
covered by cells of a bounded angle, and cells of different components are compared exactly wherever
the triangle inequality leaves a link possible.

Links join members of one component only, so the number of links is counted exactly by comparing
each component block against block; no list of pairs is made.  Equal vectors are one node.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import grouped, join_classes, materialize
from eventscope.operators.components import connected_components

logger = logging.getLogger(__name__)

#: Neighbours of a list at the start, and at most after enlargement (``bridge`` finds what longer lists would).
NEIGHBOURS, MOST_NEIGHBOURS = 8, 64
#: Random-projection trees of a start, vectors of a bucket on average, and vectors compared at a time.
TREES, BUCKET, BLOCK = 16, 64, 256
#: Vectors that are covered by cells or counted block against block at a time, and the slack of angles against rounding.
COVER, COUNTED, SLACK = 2048, 1024, 1e-6
#: Rounds of a pass end when at most this share of the lists gains a neighbour at the threshold; passes
#: before all vectors are compared; the recall that the audit asks for.
SETTLED, PASSES, RECALL = 0.005, 4, 0.995
#: Queries of the audit: from all vectors, and from those outside large components; bytes of their vectors at most.
AUDIT_QUERIES, AUDIT_OUTSIDE, AUDIT_BYTES = 512, 16_384, 16 << 20
#: Trees are added to a start until a pair at the threshold has met in a bucket with this chance.
MEET = 0.95


def _matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    """The vectors scaled to length 1, by their greatest component first, so that no square leaves the range of doubles."""
    lists = table.column(name).combine_chunks()
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, k1, k2, dim)`` of every row (keys null for unusable vectors), and the distinct vectors ``(rep, dim, k1, k2, copies, vec)``."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keys = [F.when(sound, F.xxhash64(v)).alias("k1"), F.when(sound, F.xxhash64(F.lit(5), F.reverse(v))).alias("k2"), F.size(v).alias("dim")]
    keyed = embeddings.select("vec_id", *keys, F.when(sound, v).alias("vec"))
    usable = keyed.filter("k1 is not null and vec_id is not null")
    made = usable.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("vec").alias("vec"))
    return materialize(keyed.drop("vec"), "vec-members"), materialize(made, "vec-nodes")


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """The nearest neighbours of each list: ``(src, dst, sim, place, k, floor, full)``.

    A list has ``NEIGHBOURS`` places, and a saturated one, whose neighbours are all at the threshold or above,
    up to ``MOST_NEIGHBOURS``.  ``k`` and ``floor`` say for the next round how many neighbours a comparison may
    give it and above what similarity they improve it; ``full`` that it is saturated at its greatest length.
    """
    unique = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    of, order = Window.partitionBy("src"), Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    most = unique.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST_NEIGHBOURS)
    held = most.filter((F.col("place") <= NEIGHBOURS) | (F.col("sim") >= threshold))
    held = held.withColumns({"n": F.count("*").over(of), "last": F.min("sim").over(of)})
    n, last = F.col("n"), F.col("last")
    grown = (n >= NEIGHBOURS) & (last >= threshold)
    full = grown & (n >= MOST_NEIGHBOURS)
    floor = F.when(n < NEIGHBOURS, -2.0).when(grown & ~full, float(np.nextafter(threshold, -2))).otherwise(last)
    return held.select("src", "dst", "sim", "place", F.when(grown, MOST_NEIGHBOURS).otherwise(NEIGHBOURS).alias("k"), floor.alias("floor"), full.alias("full"))


def _nearest(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Within each group every vector's nearest ones that can improve its list (``floor``: its last similarity)."""
    for _, table in grouped(batches, keys):
        rep, x = table.column("rep").to_numpy(), _matrix(table)
        floor, k = table.column("floor").to_numpy(), table.column("k").to_numpy()
        rep, first = np.unique(rep, return_index=True)
        if len(rep) < 2:
            continue
        x, floor, k = x[first], floor[first], k[first]
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        most = min(int(k.max()), len(rep) - 1)
        near = np.argpartition(-sim, most - 1, axis=1)[:, :most]
        rows = np.arange(len(rep))[:, None]
        value = sim[rows, near]
        rank = np.argsort(np.argsort(-value, axis=1), axis=1)
        good = (value > floor[:, None]) & (rank < k[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, good.sum(1))), pa.array(rep[near[good]]), pa.array(value[good])], ["src", "dst", "sim"])


def _group_and_compare(rows: DataFrame, keys: list[str]) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda it: _nearest(it, keys), "src bigint, dst bigint, sim double")


def _bits(count: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, count) / BUCKET))))


def starts(count: int, threshold: float) -> int:
    """Forests of ``TREES`` trees that a pass needs: a plane parts a pair at the threshold with its angle's share of pi."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** _bits(count)
    return 1 if together >= MEET else math.ceil(math.log(1 - MEET) / math.log(1 - together) / TREES)


def forest_edges(vectors: DataFrame, count: int, seed: int) -> DataFrame:
    """Neighbours inside the buckets of random-projection trees.  Large buckets are dealt out by hash, differently in each tree."""
    bits = _bits(count)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks()
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((TREES, max(1, bits), int(dim)))
                x = _matrix(part)
                code = np.stack([((x @ planes[t].T > 0) @ (1 << np.arange(max(1, bits)))) if bits else np.zeros(len(x), dtype=np.int64) for t in range(TREES)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TREES, pa.int32()), pa.array(code.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c).combine_chunks() for c in ("rep", "dim", "vec")], lists], ["rep", "dim", "vec", "codes"])

    signed = vectors.select("rep", "dim", "vec").mapInArrow(signatures, "rep bigint, dim int, vec array<double>, codes array<bigint>")
    signed = materialize(signed, "vec-signed")
    spread = signed.select("rep", "dim", "vec", F.posexplode("codes").alias("tree", "code"))
    sizes = spread.groupBy("tree", "dim", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = spread.join(sizes, ["tree", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.col("parts")).cast("int"))
    rows = placed.withColumns({"floor": F.lit(-2.0), "k": F.lit(NEIGHBOURS)}).drop("parts")
    return _group_and_compare(rows, ["tree", "dim", "code", "part"])


def descend(vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: the neighbours of each vector, forward and reverse, are compared with each other.

    Around a vector with many reverse neighbours they meet in parts dealt by hash.
    """
    near = lists.select(F.col("src").alias("pivot"), F.col("dst").alias("rep"))
    both = near.unionByName(near.select(F.col("rep").alias("pivot"), F.col("pivot").alias("rep")))  # what comes twice counts once when compared
    sizes = both.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = both.join(sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("rep", "pivot"), F.col("parts")).cast("int")).drop("parts")
    limits = lists.filter("place = 1").select(F.col("src").alias("rep"), "k", "floor")
    own = vectors.select("rep", "vec").join(limits, "rep", "left")
    own = own.withColumns({"k": F.coalesce("k", F.lit(NEIGHBOURS)), "floor": F.coalesce("floor", F.lit(-2.0))})
    return _group_and_compare(placed.join(own, "rep"), ["pivot", "part"])


def _gained(lists: DataFrame, before: DataFrame, threshold: float) -> int:
    """Lists with a new neighbour at the threshold, but for those that were full before: ``bridge`` is exact for these."""
    near = lists.filter(F.col("sim") >= threshold).select("src", "dst")
    new = near.join(before.filter(F.col("sim") >= threshold).select("src", "dst"), ["src", "dst"], "left_anti").select(F.col("src").alias("rep")).distinct()
    return new.join(saturated(before), "rep", "left_anti").count()


def saturated(lists: DataFrame) -> DataFrame:
    """``rep`` of the vectors whose lists have their greatest length and lie at the threshold or above throughout."""
    return lists.filter("place = 1 and full").select(F.col("src").alias("rep"))


def _cells(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Every vector with the centre (``cell``, a vector itself) that covers it and its angle to the centre."""
    for _, table in grouped(batches, ["component", "dim", "part"]):
        rep, x = table.column("rep").to_numpy(), _matrix(table)
        cell, angle, rest = np.empty(len(rep), dtype=np.int64), np.zeros(len(rep)), np.arange(len(rep))
        while len(rest):
            sim = x[rest] @ x[rest[0]]
            near = sim >= cosine
            near[0] = True
            cell[rest[near]] = rep[rest[0]]
            angle[rest[near]] = np.arccos(np.clip(sim[near], -1, 1))
            angle[rest[0]] = 0.0
            rest = rest[~near]
        kept = [table.column(c).combine_chunks() for c in ("component", "dim", "rep", "vec")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(cell), pa.array(angle)], ["component", "dim", "rep", "vec", "cell", "angle"])


def _cell_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of cells of different components that may hold a link; ``direct`` where the centres have one (once for two components)."""
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    for (_, left, right), table in grouped(batches, ["dim", "left", "right"]):
        cell, block, component = (table.column(c).to_numpy() for c in ("cell", "block", "component"))
        radius, x = table.column("radius").to_numpy(), _matrix(table)
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        if not len(a) or not len(b):
            continue
        for at in range(0, len(a), BLOCK):
            some = a[at : at + BLOCK]
            sim = x[some] @ x[b].T
            widest = np.minimum(np.pi, reach + radius[some] + radius[b].max())
            i, j = np.nonzero((sim >= np.cos(widest)[:, None]) & (component[some][:, None] != component[b][None, :]))
            value, i, j = sim[i, j], some[i], b[j]
            good = value >= np.cos(np.minimum(np.pi, reach + radius[i] + radius[j]))
            if left == right:
                good &= cell[i] < cell[j]
            value, i, j = value[good], i[good], j[good]
            direct = value >= threshold
            _, once = np.unique(np.stack([component[i], component[j]], axis=1)[direct], axis=0, return_index=True)
            pick = np.concatenate([np.flatnonzero(direct)[once], np.flatnonzero(~direct)])
            out = [cell[i], cell[j], component[i], component[j], direct]
            yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in out], ["a", "b", "src", "dst", "direct"])


def _member_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The components of two cells, where a member of the one has a link with a member of the other."""
    for (a, _), table in grouped(batches, ["a", "b"]):
        first, x = table.column("cell").to_numpy() == a, _matrix(table)
        mine, others = x[first], x[~first]
        if any((mine[at : at + BLOCK] @ others.T >= threshold).any() for at in range(0, len(mine), BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("src", "dst")], ["src", "dst"])


def bridge(vectors: DataFrame, component: DataFrame, among: DataFrame, threshold: float) -> DataFrame:
    """``component`` (``rep, component``) after every link between two vectors of ``among`` (``rep``) has joined their components.

    Exact: each component's vectors are covered by cells of half the threshold's angle.  Centres meet
    block against block, and members meet where centres have no link but members may have one.
    """
    inside = component.unionByName(among.join(component, "rep", "left_anti").select("rep", F.col("rep").alias("component")))
    held = materialize(vectors.select("rep", "dim", "vec").join(among, "rep").join(inside, "rep"), "vec-bridge")
    if held.select("component").distinct().limit(2).count() < 2:
        return component
    sizes = held.groupBy("component").agg(F.ceil(F.count("*") / COVER).cast("int").alias("parts"))
    dealt = held.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    keys, cosine = ["component", "dim", "part"], math.cos(math.acos(max(-1.0, min(1.0, threshold))) / 2)
    made = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _cells(it, cosine), "component bigint, dim int, rep bigint, vec array<double>, cell bigint, angle double")
    covered = materialize(made, "vec-cells")
    radii = covered.groupBy("cell").agg(F.max("angle").alias("radius"))
    centres = covered.filter("rep = cell").select("component", "dim", "cell", "vec").join(radii, "cell")
    blocks = covered.filter("rep = cell").groupBy("dim").agg(F.ceil(F.count("*") / COVER).cast("int").alias("blocks"))
    placed = centres.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", "dim", "cell", "radius", "block", "vec", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    keys = ["dim", "left", "right"]
    met = paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _cell_pairs(it, threshold), "a bigint, b bigint, src bigint, dst bigint, direct boolean")
    pairs = materialize(met, "vec-cell-pairs")
    direct = pairs.filter("direct").select("src", "dst")
    joined = connected_components(direct)
    ends = [joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_now")) for end in ("src", "dst")]
    open_pairs = pairs.filter("not direct").join(ends[0], "src", "left").join(ends[1], "dst", "left")
    open_pairs = open_pairs.filter(F.coalesce("src_now", "src") != F.coalesce("dst_now", "dst")).select("a", "b", "src", "dst")
    sides = open_pairs.withColumn("cell", F.explode(F.array("a", "b"))).join(covered.select("cell", "vec"), "cell")
    keys = ["a", "b"]
    found = materialize(sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _member_links(it, threshold), "src bigint, dst bigint"), "vec-member-links")
    merged = connected_components(direct.unionByName(found)).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return materialize(inside.join(merged, "component", "left").select("rep", F.coalesce("now", "component").alias("component")), "vec-components")


def audit(vectors: DataFrame, component: DataFrame, threshold: float, seed: int = 0) -> tuple[float, DataFrame, int]:
    """The mean share of a query's true links inside its component, over the queries that have links; the links missed; the number of queries.

    Every query weighs the same, whatever its number of links.  Queries are drawn by a seeded hash from all
    vectors and, separately and many more, from components no larger than a list, lest large groups hide the
    loss of small ones; the lower of the two means counts.  Missed links come as pairs of vectors
    ``(src, dst, sim)``, one for each query and component in a block of rows.
    """
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    labelled = vectors.select("rep", "dim", "vec").join(component.join(sizes, "component"), "rep", "left")
    labelled = materialize(labelled.withColumns({"component": F.coalesce("component", "rep"), "size": F.coalesce("size", F.lit(1))}), "vec-labelled")
    widest = labelled.agg(F.max("dim")).first()[0] or 1
    outside = min(AUDIT_OUTSIDE, max(AUDIT_QUERIES, AUDIT_BYTES // (8 * widest)))
    samples = [
        labelled.orderBy(F.xxhash64(F.lit(2 * seed), "rep"), "rep").limit(AUDIT_QUERIES).toArrow(),
        labelled.filter(F.col("size") <= MOST_NEIGHBOURS).orderBy(F.xxhash64(F.lit(2 * seed + 1), "rep"), "rep").limit(outside).toArrow(),
    ]
    first, asked = samples[0].num_rows, pa.concat_tables(samples)
    by_dim, dims = {}, asked.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        part = asked.take(pa.array(at))
        by_dim[int(dim)] = at, part.column("rep").to_numpy(), part.column("component").to_numpy(), _matrix(part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true, found = np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                table = pa.Table.from_batches([batch.slice(start, BLOCK)])
                held = table.column("dim").to_numpy()
                for dim, (at, reps, components, q) in by_dim.items():
                    part = table.filter(pa.array(held == dim))
                    if not part.num_rows:
                        continue
                    sim, mine_reps = _matrix(part) @ q.T, part.column("rep").to_numpy()
                    i, j = np.nonzero(sim >= threshold)
                    other = mine_reps[i] != reps[j]
                    i, j = i[other], j[other]
                    mine = part.column("component").to_numpy()[i]
                    same = mine == components[j]
                    true += np.bincount(at[j], minlength=len(dims))
                    found += np.bincount(at[j[same]], minlength=len(dims))
                    _, lost = np.unique(np.stack([mine[~same], j[~same]], axis=1), axis=0, return_index=True)
                    if len(lost):
                        i, j = i[~same][lost], j[~same][lost]
                        blank = pa.array([None] * len(lost), pa.int64())
                        yield pa.RecordBatch.from_arrays([blank, blank, blank, pa.array(mine_reps[i]), pa.array(reps[j]), pa.array(sim[i, j])], ["query", "t", "f", "src", "dst", "sim"])
        some = np.flatnonzero(true)
        blank = pa.array([None] * len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(true[some]), pa.array(found[some]), blank, blank, blank.cast(pa.float64())], ["query", "t", "f", "src", "dst", "sim"])

    told = materialize(labelled.select("rep", "dim", "vec", "component").mapInArrow(compare, "query bigint, t bigint, f bigint, src bigint, dst bigint, sim double"), "vec-audit")
    rows = told.filter("query is not null").groupBy("query").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).toArrow()
    share, query = rows.column("f").to_numpy() / rows.column("t").to_numpy(), rows.column("query").to_numpy()
    means = [float(np.mean(part)) for part in (share[query < first], share[query >= first]) if len(part)]
    logger.info("audit: %d of %d queries have links, mean shares %s", len(share), len(dims), means)
    return min(means, default=1.0), told.filter("src is not null").select("src", "dst", "sim").distinct(), len(np.unique(asked.column("rep").to_numpy()))


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` (``rep, component``) after each link (``src, dst``) has made one of its ends' components; lone vectors are their own."""
    ends = links
    for end in ("src", "dst"):
        known = component.select(F.col("rep").alias(end), F.col("component").alias(f"{end}_c"))
        ends = ends.join(known, end, "left").withColumn(f"{end}_c", F.coalesce(f"{end}_c", end))
    joined = connected_components(ends.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"))).select(F.col("node").alias("component"), F.col("component").alias("now"))
    alone = joined.join(component.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("rep"), F.col("now").alias("component"))
    moved = component.join(joined, "component", "left").select("rep", F.coalesce("now", "component").alias("component"))
    return materialize(moved.unionByName(alone), "vec-components")


def _count_links(vectors: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """``(rep, links)``: vectors (copies included) at or above the threshold inside the component, exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, left, right), table in grouped(batches, ["component", "dim", "left", "right"]):
            rep, block, copies, x = table.column("rep").to_numpy(), table.column("block").to_numpy(), table.column("copies").to_numpy(), _matrix(table)
            a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
            hit = x[a] @ x[b].T >= threshold
            hit &= rep[a][:, None] != rep[b][None, :]
            out = [(rep[a], hit @ copies[b])] + ([(rep[b], hit.T @ copies[a])] if left != right else [])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r for r, _ in out])), pa.array(np.concatenate([c for _, c in out]))], ["rep", "links"])

    sizes = component.groupBy("component").agg(F.ceil(F.count("*") / COUNTED).cast("int").alias("blocks"))
    dealt = component.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = vectors.select("rep", "dim", "copies", "vec").join(dealt, "rep")
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", "dim", "rep", "block", "copies", "vec", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    keys = ["component", "dim", "left", "right"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))


def link(embeddings: DataFrame, threshold: float = 0.9, keep_missed: bool = True) -> tuple[DataFrame, dict[str, float | int]]:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings`` (``vec_id, embedding``), and what the last audit said.

    That is ``recall``, the share of true links that the graph had found by itself, ``n_queries``, the vectors
    whose links were sought among all others, and ``passes``.  While the recall is below ``RECALL``, up to
    ``PASSES`` passes add buckets and rounds; then all vectors are compared, and ``n_queries`` is their number.
    Links that audits find stay in the graph, unless ``keep_missed`` is false (to look at the graph alone).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths with each other.  Repeated rows of one ``vec_id`` and vector count once
    as a partner; a null ``vec_id`` has no component and is not kept.  Other columns are not looked at.
    """
    members, vectors = nodes(embeddings)
    count = vectors.count()
    lists, extra, forests = None, None, starts(count, threshold)
    for turn in range(PASSES):
        for forest in range(forests):
            known = [x.select("src", "dst", "sim") for x in (lists, extra) if x is not None]
            fresh = forest_edges(vectors, count, seed=turn * forests + forest)
            lists = materialize(_best(reduce(DataFrame.unionByName, known, fresh), threshold), "vec-lists")
        gained = count
        while gained > SETTLED * count:
            better = descend(vectors, lists)
            before, lists = lists, materialize(_best(lists.select("src", "dst", "sim").unionByName(better), threshold), "vec-lists")
            gained = _gained(lists, before, threshold)
        near = lists.filter(F.col("sim") >= threshold).select("src", "dst")
        near = near if extra is None else near.unionByName(extra.select("src", "dst"))
        component = connected_components(near).withColumnRenamed("node", "rep")
        component = bridge(vectors, component, materialize(saturated(lists), "vec-saturated"), threshold)
        recall, missed, queries = audit(vectors, component, threshold, turn)
        logger.info("near copies of %d vectors: audited recall %.4f over %d queries in pass %d", count, recall, queries, turn + 1)
        if keep_missed and not missed.isEmpty():
            component = _merged(component, missed)
            both = missed.unionByName(missed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
            extra = materialize(both if extra is None else both.unionByName(extra), "vec-missed")
        if recall >= RECALL or queries == count or not keep_missed and turn + 1 == PASSES:  # with all asked, all links are known
            break
    else:
        logger.warning("near copies of %d vectors: recall %.4f is short of %.4f, comparing all vectors", count, recall, RECALL)
        component, queries = bridge(vectors, component, vectors.select("rep"), threshold), count
    told = {"recall": recall, "n_queries": queries, "passes": turn + 1}
    links = _count_links(vectors, component, threshold)
    own = materialize(vectors.select("k1", "k2", "dim", "rep", "copies").join(component, "rep", "left").join(links, "rep", "left"), "vec-own")
    found = join_classes(members.filter("k1 is not null"), own, ["k1", "k2", "dim"], "copies")
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)))
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    made = found.select("vec_id", n_links.cast("long").alias("n_links"), component_id.alias("component_id"))
    unusable = members.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return made.unionByName(unusable).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), told
