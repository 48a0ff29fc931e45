"""Operators on pairs, and the pipeline, against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
import pytest

import corpus_pipeline
from eventscope.llm import jaccard, near_dedup, queries, secrets
from eventscope.llm.common import read_table

DOCS = "doc_id long, text string"


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- Jaccard ---------------------------------------------------------------------------------


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, size))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return closure(ids, links), sets


def family_rows(seed=1, families=12, unique=60):
    """Families of near copies around the threshold, a passage shared by many, and unique texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(2, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for _ in range(unique):
        rows.append(" ".join([word() for _ in range(rng.randint(0, 60))] + passage * (rng.random() < 0.7)))
    big = [word() for _ in range(120)]
    for _ in range(50):
        copy = list(big)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("long_list", "size", "percent", "large", "hot"), [(64, 4, 85, 1024, 50), (4, 4, 85, 8, 10), (1, 5, 80, 4, 2)])
def test_components_equal_brute_force(spark, monkeypatch, long_list, size, percent, large, hot):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LARGE_FAMILY", large)
    monkeypatch.setattr(jaccard, "CENTRES", 2)
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    rows = family_rows() + [(5000, None), (5001, ""), (5002, "One two"), (5003, "one TWO"), (5004, "one"), (5005, " ")]
    want, sets = brute_components(rows, size, percent)
    got = jaccard.components(spark.createDataFrame(rows, DOCS), size, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s[0]) for i, s in sets.items()}


def test_common_passages_tie_nothing_together(spark, monkeypatch):
    """Texts that are mostly one passage of all, but differ in the rest, are candidates of few others."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(120)]
    rows = [(k, " ".join(passage + [word() for _ in range(30)])) for k in range(1500)]
    rows += [(2000 + k, rows[k][1] + " one") for k in range(5)]
    seen = []
    compare = jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda family, percent: seen.append(family.count()) or compare(family, percent))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: k - 2000 if k >= 2000 else k for k, _ in rows}
    assert seen == [10]


def test_long_texts(spark):
    rng = random.Random(7)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    other = list(long)
    for k in range(0, 60_000, 500):
        other[k] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:40_000])), (4, "x" * 500_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1][0] == len(shingles(rows[0][1], 4))


def test_frequent_copies_are_not_shuffled_together(spark, monkeypatch):
    from eventscope.llm import common

    monkeypatch.setattr(common, "FREQUENT", 3)
    rows = [(k, "the same words in every one of these rows" if k % 2 else "") for k in range(40)] + [(50 + k, "others that two rows have") for k in range(2)] + [(None, "the same words in every one of these rows")]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.components(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(i, None if i is None else 50 if i >= 50 else 1 if i % 2 else i) for i, _ in rows], key=str)
    vectors = [(k, [1.0, 0.0] if k % 2 else [float(k), 1.0 + k]) for k in range(20)] + [(30, None)]
    want, count = brute_vectors(vectors)
    got = {r["vec_id"]: r for r in near_dedup.link(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))[0].collect()}
    assert {i: (r["component_id"], r["n_links"]) for i, r in got.items()} == {i: (want[i], count[i]) for i in want}


def test_repeated_ids_null_ids_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (2, "other words that are not the same at all"), (2, text), (None, text), (3, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.components(spark.createDataFrame(rows, DOCS)).collect())
    assert [g[2] for g in got if g[0] in "12" and g[1] == 7] == ["1", "1", "1"] and ("None", 7, "None") in got and ("3", 0, "3") in got
    assert jaccard.components(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h i j", "x"), (1, "a b c d e f g h i j", "x"), (2, "A b c d e f g h i j", "y"), (3, "quite another text with many words", "z"), (None, "a b c d e f g h i j", "w"), (4, None, "v")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS + ", component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((str(r[0]), r[2]) for r in kept.collect()) == [("1", "x"), ("3", "z"), ("4", "v"), ("None", "w")]


# ---- embeddings ------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.9):
    sound = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted({i for i, _ in rows})
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    count = dict.fromkeys(ids, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return closure(ids, links), count


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (40, 16))
    rows = []
    for k, b in enumerate(base):
        for _ in range(120 if k == 0 else k % 4 + 1):
            rows.append((b + rng.normal(0, 0.12, 16)).tolist())
    rows += [rows[0]] * 30 + [[2 * x for x in rows[0]], [0.0] * 16, [], None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8, [1.0] * 8]
    rows = list(enumerate(rows))
    want, count = brute_vectors(rows)
    made, told = near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r for r in made.collect()}
    assert told["recall"] >= 0.99 and len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == count
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def tight_groups(cosines, size, dim=16, noise=0.004, seed=5):
    """Groups of near copies around directions of one plane; neighbouring groups have the given cosines."""
    rng, angle, rows = np.random.default_rng(seed), 0.0, []
    for cosine in [1.0, *cosines]:
        angle += np.arccos(cosine)
        centre = np.zeros(dim)
        centre[:2] = np.cos(angle), np.sin(angle)
        rows += [(centre + rng.normal(0, noise, dim)).tolist() for _ in range(size)]
    return list(enumerate(rows))


def test_links_between_saturated_groups(spark):
    # links inside a group fill every list; the last group has links with its neighbour for some members only
    rows = tight_groups([0.93, 0.92, 0.80, 0.9], 150)
    want, count = brute_vectors(rows)
    got = {r["vec_id"]: r for r in near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()}
    assert set(want.values()) == {0, 450}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == count


def test_audit_sees_small_groups(spark):
    # one group of 400 holds nearly all links; each of 30 pairs is lost
    rng = np.random.default_rng(9)
    hot = [(np.eye(16)[0] + rng.normal(0, 0.002, 16)).tolist() for _ in range(400)]
    pairs = [v.tolist() for x in rng.normal(0, 1, (30, 16)) for v in (x, x + rng.normal(0, 0.02, 16))]
    rows = [(k, 16, v) for k, v in enumerate(hot + pairs)]
    component = spark.createDataFrame([(k, 0) for k in range(400)], "rep long, component long")
    recall, missed, _ = near_dedup.audit(spark.createDataFrame(rows, "rep long, dim int, vec array<double>"), component, 0.9)
    assert recall < 0.1 and missed.count() >= 30


def test_trees_grow_with_the_table():
    met = lambda n: 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** near_dedup._bits(n)) ** (near_dedup.starts(n, 0.9) * near_dedup.TREES)
    assert all(met(n) >= 0.95 for n in (10, 5_000, 1_000_000, 10_000_000))
    assert near_dedup.starts(1000, 0.9) == near_dedup.starts(1000, 1.0) == 1


def test_short_recall_ends_in_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = list(enumerate(v.tolist() for x in rng.normal(0, 1, (60, 16)) for v in (x, x + rng.normal(0, 0.2, 16))))
    # a search that finds next to nothing: each bucket is dealt into parts of two, and no pass follows
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "TREES", 1)
    monkeypatch.setattr(near_dedup, "PASSES", 1)
    monkeypatch.setattr(near_dedup, "AUDIT_QUERIES", 16)
    monkeypatch.setattr(near_dedup, "AUDIT_OUTSIDE", 16)
    monkeypatch.setattr(near_dedup, "descend", lambda vectors, lists: lists.select("src", "dst", "sim").limit(0))
    want, count = brute_vectors(rows)
    made, told = near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r for r in made.collect()}
    assert told["recall"] < near_dedup.RECALL and told["n_queries"] == 120 and len(set(want.values())) < 120
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == count


def test_links_among_many_unlinked_vectors(spark):
    # few vectors have a link, so that a small audit would meet none
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (8_000, 14))
    x[:40] = x[40:80] + rng.normal(0, 0.1, (40, 14))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    count = (unit @ unit.T >= 0.9).sum(1) - 1
    made, told = near_dedup.link(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r["n_links"] for r in made.collect()}
    assert told["recall"] >= near_dedup.RECALL and sum(count > 0) > 80
    assert sum(got[k] > 0 for k in got) == sum(count > 0)


def test_passes_follow_a_short_first_pass(spark, monkeypatch, caplog):
    rng = np.random.default_rng(6)
    rows = list(enumerate(v.tolist() for x in rng.normal(0, 1, (300, 24)) for v in (x, x + rng.normal(0, 0.25, 24))))
    for name, value in {"BLOCK": 4, "BUCKET": 4, "TREES": 1, "MEET": 0.05, "NEIGHBOURS": 2, "AUDIT_QUERIES": 64, "AUDIT_OUTSIDE": 128}.items():
        monkeypatch.setattr(near_dedup, name, value)
    want, count = brute_vectors(rows)
    with caplog.at_level("INFO", logger=near_dedup.logger.name):
        made, told = near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # other queries in every pass: either the last of them finds the graph whole, or all vectors are compared in the end
    assert "in pass 2" in caplog.text and told["passes"] >= 2 and (told["recall"] >= near_dedup.RECALL or told["n_queries"] == len(rows))
    got = {r["vec_id"]: r for r in made.collect()}
    assert np.mean([got[i]["n_links"] == n for i, n in count.items() if n]) >= 0.9


def test_the_graph_without_the_links_of_its_audit(spark):
    rng = np.random.default_rng(11)
    rows = list(enumerate(v.tolist() for x in rng.normal(0, 1, (700, 24)) for v in (x, x + rng.normal(0, 0.2, 24), *([x + rng.normal(0, 0.15, 24)] if x[0] > 0 else []))))
    want, count = brute_vectors(rows)
    made, told = near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), keep_missed=False)
    got = {r["vec_id"]: r["n_links"] for r in made.collect()}
    share = np.mean([got[i] / n for i, n in count.items() if n])
    assert told["recall"] >= near_dedup.RECALL and told["n_queries"] == len(rows) and share >= 0.99


def test_missed_links_stay_and_queries_change(spark, monkeypatch):
    asked, audit = [], near_dedup.audit

    def watched(vectors, component, threshold, seed=0):
        recall, missed, queries = audit(vectors, component, threshold, seed)
        asked.append((seed, {tuple(sorted((r["src"], r["dst"]))) for r in missed.collect()}))
        return (0.5 if len(asked) < 3 else 1.0), missed, queries

    rng = np.random.default_rng(6)
    rows = list(enumerate(v.tolist() for x in rng.normal(0, 1, (200, 24)) for v in (x, x + rng.normal(0, 0.2, 24))))
    for name, value in {"BLOCK": 2, "TREES": 1, "MEET": 0.01, "NEIGHBOURS": 2, "AUDIT_QUERIES": 32, "AUDIT_OUTSIDE": 64, "audit": watched}.items():
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "descend", lambda vectors, lists: lists.select("src", "dst", "sim").limit(0))
    made, told = near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    component = {r["vec_id"]: r["component_id"] for r in made.collect()}
    assert [seed for seed, _ in asked] == [0, 1, 2] and told["passes"] == 3
    assert all(missed for _, missed in asked[:2]) and asked[0][1] != asked[1][1]
    assert all(component[a] == component[b] for _, missed in asked for a, b in missed)


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [float(k % 3), 1.0, float(k // 3)]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.withColumns({c: F.lit("x") for c in ("rep", "k1", "dim", "copies", "component", "n_links", "vec", "block")})
    assert sorted(near_dedup.link(clash)[0].collect()) == sorted(near_dedup.link(df)[0].collect())


def test_very_long_and_very_short_vectors(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1e-200, -2e-200]), (4, [1e308, 1e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_vectors_edges(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in near_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect())
    assert got == [("1", 0, True), ("1", 0, True), ("2", 0, True), ("None", 0, False)]
    assert near_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0].count() == 0


# ---- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "SentencePiece encoding"]
    stage = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}

    good = stage["quality classifier"](spark, docs, sf).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95

    one = stage["n-gram Jaccard join"](spark, good, sf).cache()
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted({c for c in want.values()})

    safe = stage["secret scans"](spark, one, sf).cache()
    before, after = {r["doc_id"]: r for r in one.collect()}, {r["doc_id"]: r for r in safe.collect()}
    assert safe.columns == docs.columns and before.keys() == after.keys()
    hit = {r["doc_id"] for r in secrets.scan(one.select("doc_id", "text")).filter("size(secrets) > 0").collect()}
    assert all((before[i]["text"] != after[i]["text"]) == (i in hit) for i in before)
    assert secrets.scan(safe.select("doc_id", "text")).filter("size(secrets) > 0").count() == 0

    mixed = stage["mixing sources to target weights"](spark, safe, sf).cache()
    copies = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in queries.mixing.digest(safe).collect()}
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert all(got.get(i, 0) == n for i, n in copies.items())

    coded = stage["SentencePiece encoding"](spark, mixed, sf)
    assert coded.count() == mixed.count() and coded.columns[0] == "doc_id"


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, a very long text, repeated rows and further columns with clashing names."""
    sf = "/root/testdata/sf0.001"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    for name, rows in {"empty": docs.limit(0), "odd": None}.items():
        folder = tmp_path / name
        if rows is None:
            long = docs.limit(1).withColumn("text", F.repeat(F.lit("some words of a long text "), 60_000))
            none = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
            rows = docs.limit(60).unionByName(docs.limit(5)).unionByName(long).unionByName(none)
            rows = rows.withColumns({c: F.lit("mine") for c in ("host", "path", "accepted", "component_id", "secrets", "copies", "__row", "n_tokens")})
        rows.write.parquet(str(folder / "documents.parquet"))
        (labels.limit(0) if name == "empty" else labels).write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert (out.count() > 0) == (name == "odd") and "ids" in out.columns


def test_last_stage_of_the_pipeline_equals_the_library(spark):
    import sentencepiece

    docs = read_table(spark, "/root/testdata/sf0.001", "documents").limit(40)
    processor = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer_model())
    want = {r["doc_id"]: (r["text"] or "", processor.encode(r["text"] or "")) for r in docs.collect()}
    for r in corpus_pipeline.tokens(spark, docs, "").collect():
        text, ids = want[r["doc_id"]]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) == len(r["begins"])
        assert not ids or (r["begins"][0] == 0 and r["ends"][-1] == len(text.encode()) and r["begins"][1:] == r["ends"][:-1])
