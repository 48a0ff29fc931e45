"""Fitted operators and codecs: toxicity, language, quality, SentencePiece."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from eventscope.llm import language_id, queries, sentencepiece_codec, site_quality, toxicity
from eventscope.llm.common import read_table

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled invented documents, a table of its own size."""
    sf = "/root/testdata/sf0.01"
    return read_table(spark, sf, "documents"), read_table(spark, sf, "labels")


# ---- toxicity --------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "flag").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 and 0 <= r["grade"] < toxicity.GRADES for r in rows)
    hit, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["flag"] for r in hit]) > 0.6 and np.mean([r["flag"] for r in clean]) < 0.05
    assert np.mean([r["severity"] for r in hit]) > 5 * np.mean([r["severity"] for r in clean])


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, toxicity.GRADES, 400)
    x = (grades + rng.normal(0, 0.3, 400))[:, None]
    weights, thresholds = toxicity.fit([[] for _ in grades], x[:, 0], grades, 0)
    assert weights[0] > 0 and (np.diff(thresholds) > 0).all()
    model = toxicity.Model({}, frozenset(), weights, thresholds)
    assert np.mean(model.above((x @ weights)).round().sum(1) == grades) > 0.8


def test_sparse_fit_equals_dense_likelihood():
    """No small move of the fitted parameters raises the penalised likelihood, taken over dense rows one by one."""
    rng = np.random.default_rng(8)
    held = [sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()) for _ in range(120)]
    density, grades = rng.random(120), rng.integers(0, toxicity.GRADES, 120)
    weights, thresholds = toxicity.fit(held, density, grades, 6, steps=3000, settled=0)

    def likelihood(w, t):
        total = 0.0
        for h, d, g in zip(held, density, grades, strict=True):
            score = sum(w[k] for k in h) + d * w[-1]
            edges = [0.0, *[1 / (1 + np.exp(score - x)) for x in t], 1.0]
            total += np.log(edges[g + 1] - edges[g])
        return total / len(held) - 1e-3 * (w @ w) / 2

    best = likelihood(weights, thresholds)
    for k in range(len(weights)):
        for step in (-0.02, 0.02):
            assert likelihood(weights + step * np.eye(len(weights))[k], thresholds) <= best + 1e-6
    for k in range(len(thresholds)):
        for step in (-0.02, 0.02):
            assert likelihood(weights, thresholds + step * np.eye(len(thresholds))[k]) <= best + 1e-6


def brute_severity(model, text):
    """Expected grade and P(grade > 0), word by word."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    score, told = 0.0, 0
    for word in set(words):
        forms = [word] + [word[:k] + "*" for k in range(3, 8) if k < len(word)]
        told += words.count(word) * any(f in model.telling for f in forms)
    for feature in {f for w in words for f in [w] + [w[:k] + "*" for k in range(3, 8) if k < len(w)] if f in model.words}:
        score += model.weights[model.words[feature]]
    score += model.weights[-1] * (math.log1p(1000 * told / len(words)) if told else 0.0)
    above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    return sum(above), above[0]


def test_scores_equal_brute_force(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    some = docs.filter("doc_id % 7 = 0").select("doc_id", "text")
    got = {r["doc_id"]: r for r in toxicity.score(some, model).collect()}
    for r in some.collect():
        severity, first = brute_severity(model, r["text"])
        assert got[r["doc_id"]]["severity"] == pytest.approx(severity) and got[r["doc_id"]]["p_toxic"] == pytest.approx(first)


def test_repeated_and_reordered_rows_give_the_same_model(spark, corpus):
    docs, labels = corpus
    labels = labels.filter("doc_id % 5 = 0")
    once = toxicity.train(docs, labels, rows=60)
    again = toxicity.train(docs.unionByName(docs).repartition(7), labels.unionByName(labels).repartition(3), rows=60)
    assert once.words == again.words and (once.weights == again.weights).all() and (once.thresholds == again.thresholds).all()
    hot = docs.filter("doc_id = 5").crossJoin(spark.range(500)).select(*docs.columns)  # one id, many times the bound
    more = toxicity.train(docs.unionByName(hot), labels, rows=60)
    assert more.words == once.words and (more.weights == once.weights).all()


def test_toxicity_of_long_texts_and_other_columns(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    long = "word " * 200_000
    rows = spark.createDataFrame([(1, long + sorted(model.telling)[0].strip("*"), "mine", 5)], DOCS + ", severity string, grade int")
    (r,) = toxicity.score(rows, model).collect()
    assert r["severity"] == pytest.approx(brute_severity(model, long + sorted(model.telling)[0].strip("*"))[0]) and isinstance(r["severity"], float)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (None, "x"), (3, "plain words")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model is None and [r["toxic"] for r in toxicity.score(docs, model).collect()] == [False] * 5
    one = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, one).count() == 5
    assert toxicity.score(docs.limit(0), one).count() == 0


# ---- languages -------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark, corpus):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).join(corpus[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_used(spark, corpus):
    docs = corpus[0]
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    lied = docs.withColumn("lang", F.when(held_out, "xx").otherwise(F.col("lang")))
    model = language_id.train(lied.filter(~held_out))
    assert "xx" not in model.languages


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("hello there world", "en"), ("bonjour le monde", "fr"), (None, "en"), ("123 !!", "en"), ("", "fr"), ("abc", None)] * 5)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4)) and got[0]["lang_pred"] == "en" and got[1]["lang_pred"] == "fr"
    assert language_id.train(docs.filter("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    only = language_id.train(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(docs, only).collect()} == {"en", "und"}


def test_languages_with_clashing_columns(spark, corpus):
    docs = corpus[0].select("doc_id", "text", "lang")
    clash = docs.withColumns({c: F.lit("mine") for c in ("order", "near", "first", "held_out", "lang_pred", "score", "ambiguous", "source")})
    plain, odd = (language_id.predict(d.filter("doc_id % 2 = 0"), language_id.train(d)).select("doc_id", "lang_pred", "score") for d in (docs, clash))
    assert sorted(map(tuple, odd.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_letters_by_unicode_category(spark):
    rows = [("²½", False), ("Ⅷ", False), ("\u0301\u0308", False), ("_9٣", False), ("ª", True), ("ʰ", True), ("日", True), ("\u0301a", True), ("𝒳", True)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], DOCS)
    model = language_id.train(spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour monde", "fr"), (3, "²½", "xx"), (4, "Ⅷ", "yy")], DOCS + ", lang string"))
    assert model.languages == ("en", "fr")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert all((got[k] != "und") == letter for k, (_, letter) in enumerate(rows))
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_decoding_equals_brute_force(spark, corpus):
    docs = corpus[0].filter("doc_id % 11 = 0")
    model = language_id.train(corpus[0])
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        x = language_id.features(r["text"])
        losses = []
        for i, _ in enumerate(model.languages):
            loss = 0.0
            for j in range(model.code.shape[1]):
                loss += model.trust[i, j] * math.log1p(math.exp(-model.code[i, j] * (sum(x[k] * model.weights[k, j] for k in np.flatnonzero(x)) + model.bias[j])))
            losses.append(loss)
        best = min(range(len(losses)), key=lambda i: (losses[i], i))
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(-4 * (v - losses[best])) for v in losses))


def test_equal_losses_take_the_first_language():
    code = language_id.codewords(3)
    model = language_id.Model(("a", "b", "c"), code, np.zeros((language_id.BUCKETS, code.shape[1])), np.zeros(code.shape[1]), np.ones_like(code) / code.shape[1])
    assert model.predict(language_id.features("text")) == (0, pytest.approx(1 / 3), True)


def test_language_model_of_repeated_rows(spark, corpus):
    docs = corpus[0].select("doc_id", "text", "lang")
    once = language_id.train(docs, rows=80)
    hot = docs.filter("doc_id = 3").crossJoin(spark.range(400)).select(*docs.columns)
    again = language_id.train(docs.unionByName(docs).unionByName(hot).repartition(6), rows=80)
    assert once.languages == again.languages and (once.weights == again.weights).all()
    clash = corpus[0].limit(5).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit("x"))
    assert "mine" not in {r["lang_pred"] for r in language_id.predict(clash, once).collect()}


def test_windows_do_not_change_features(monkeypatch):
    text = "Été! " + "abc déf gh" * 50
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "WINDOW", 37)
    assert language_id.features(text) == pytest.approx(whole)


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 30):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and min(apart) >= 1
        if n > 2:
            assert min(apart) >= 2


# ---- quality ---------------------------------------------------------------------------------


def test_quality_on_labelled_rows(spark, corpus):
    docs, labels = corpus
    judged = site_quality.classify(queries.sites_of(docs), labels.filter("doc_id % 3 <> 0"))
    rows = judged.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["accepted"] == bool(r["quality"]) for r in rows]) > 0.97
    assert judged.count() == docs.count()


def test_quality_model_of_repeated_rows(spark, corpus):
    docs, labels = corpus
    some = docs.join(labels.filter("quality is not null").orderBy("doc_id").limit(60).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    first = some.orderBy("doc_id").limit(1)
    often = some.unionByName(first.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k")).repartition(7)
    plain, repeated = site_quality.train(some, labels), site_quality.train(often, labels.unionByName(labels))
    assert repeated[0] == pytest.approx(plain[0], rel=1e-6) and repeated[1] == pytest.approx(plain[1], rel=1e-6)
    assert site_quality.train(some.withColumn("text", F.lit(None).cast("string")), labels) is not None


def test_sites_decide_where_evidence_is_weak(spark, monkeypatch):
    """A middling document goes with its site; a page alone on a site goes by itself."""
    text = lambda p: " ".join(["w"] * int(100 * p))
    rows = [(k, text(0.95), "good", "good/a") for k in range(60)] + [(100 + k, text(0.05), "bad", "bad/a") for k in range(60)]
    rows += [(1000, text(0.45), "good", "good/a"), (1001, text(0.55), "bad", "bad/a"), (1002, text(0.45), "lone", "lone/a"), (1003, text(0.55), "only", "only/a"), (1004, text(0.45), "good", "good/new"), (1005, text(0.55), "bad", "bad/new")]
    monkeypatch.setattr(site_quality, "FEATURES", ("share",))
    monkeypatch.setattr(site_quality, "features", lambda docs: docs.withColumn("f_share", F.size(F.split("text", " ")) / 100.0 - 0.5))
    monkeypatch.setattr(site_quality, "train", lambda docs, labels: ([6.0], 0.0))
    docs = spark.createDataFrame(rows, DOCS + ", host string, path string")
    judged = {r["doc_id"]: (r["p_document"] >= 0.5, r["accepted"]) for r in site_quality.classify(docs, docs.limit(0)).collect()}
    assert judged[1000] == (False, True) and judged[1001] == (True, False)  # moved by their sites
    assert judged[1002] == (False, False) and judged[1003] == (True, True)  # alone: their own evidence
    assert judged[1004] == (False, True) and judged[1005] == (True, False)  # a sparse path falls back on its host


def test_priors_shrink_sparse_sites(spark):
    rows = [("big", "big/a", 0.9)] * 200 + [("big", "big/b", 0.8)] * 200 + [("bad", "bad/a", 0.1)] * 200 + [("one", "one/a", 0.0)] + [(None, None, 0.5)] * 3
    rows = [(h, p, v + 0.05 * (-1) ** i if 0 < v < 1 else v) for i, (h, p, v) in enumerate(rows)]
    sums, priors = site_quality.site_sums(spark.createDataFrame(rows, "host string, path string, p double"))
    row = F.struct("n", "s", "hn", "hs")
    got = {r["path"]: r["prior"] for r in sums.withColumn("row", row).withColumn("prior", site_quality.path_prior(F.col("s") / F.col("n"), F.col("row"), priors)).collect()}
    assert abs(got["big/a"] - 0.9) < 0.02 and abs(got["bad/a"] - 0.1) < 0.02 and len(got) == 5
    assert got["one/a"] == pytest.approx(priors["mean"])  # alone on its site: its own evidence is no prior


def test_classification_equals_brute_force(spark, corpus):
    docs, labels = corpus
    docs = queries.sites_of(docs).filter("doc_id % 4 = 1").withColumn("site_prior", F.lit("mine")).withColumn("row", F.lit(7)).withColumn("logit", F.lit(None))
    rows = site_quality.classify(docs.unionByName(docs.limit(3)), labels).collect()
    evidence = {}
    for r in rows:
        evidence.setdefault(r["host"], {}).setdefault(r["path"], []).append(r["p_document"])
    every = [p for paths in evidence.values() for ps in paths.values() for p in ps]
    n, mean = len(every), sum(every) / len(every)
    hosts = {h: [p for ps in paths.values() for p in ps] for h, paths in evidence.items()}
    paths = [ps for held in evidence.values() for ps in held.values()]
    inside = max(1e-6, sum(sum(p * p for p in ps) - sum(ps) ** 2 / len(ps) for ps in paths) / max(1, n - len(paths)))

    def worth(between, groups, over):
        spread = (between / max(1, groups - over) - inside) / max(1, n / groups)
        return min(1e6, max(1.0, inside / spread)) if spread > 0 else 1e6

    squares = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups)
    host_worth = worth(squares(hosts.values()) - n * mean**2, len(hosts), 1)
    path_worth = worth(squares(paths) - squares(hosts.values()), len(paths), len(hosts))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in rows:
        p, host, path = r["p_document"], hosts[r["host"]], evidence[r["host"]][r["path"]]
        above = (sum(host) - p + host_worth * mean) / (len(host) - 1 + host_worth)
        prior = (sum(path) - p + path_worth * above) / (len(path) - 1 + path_worth)
        assert r["site_prior"] == pytest.approx(prior, rel=1e-6)
        moved = logit(p) + logit(prior) - logit(mean)
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-moved)), rel=1e-3, abs=1e-6) and r["accepted"] == (r["posterior"] >= 0.5)
    assert all(r["row"] == 7 and r["logit"] is None for r in rows) and len(rows) == docs.count() + 3


def test_quality_of_long_texts(spark, corpus):
    docs, labels = corpus
    long = spark.createDataFrame([(-1, "some words of a long text " * 40_000, "h", "h/p"), (-1, "x" * 1_000_000, None, None)], DOCS + ", host string, path string")
    judged = site_quality.classify(queries.sites_of(docs).select("doc_id", "text", "host", "path").unionByName(long), labels, keep=["doc_id", "host"])
    assert judged.columns[:2] == ["doc_id", "host"] and judged.filter("doc_id = -1 and accepted is not null").count() == 2


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "h", "p"), (3, "some words here", "h", "p")], DOCS + ", host string, path string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["accepted"] for r in site_quality.classify(docs, none).collect()] == [True] * 3
    labels = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int")
    assert site_quality.classify(docs, labels).count() == 3 and site_quality.classify(docs.limit(0), labels).count() == 0


# ---- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_model()


ODD = ["", " ", "  a  b ", "▁a ▁", "a\nb\tc", "日本語 text", "\U0001f600é\u0000x", "a" * 5000, "word " * 4000, "　 "]


def test_round_trip_and_spans(spark, model):
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])] + [(0, "a b"), (None, "c")], DOCS)
    for r, t in zip(sentencepiece_codec.encode(docs.coalesce(1), model).collect(), [*ODD, "", "a b", "c"], strict=True):
        assert r["ids"] == plain.encode(t) and r["decoded"] == plain.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
        raw = t.encode()
        if raw:
            assert r["begins"][0] == 0 and r["ends"][-1] == len(raw) and r["begins"][1:] == r["ends"][:-1]
        for i, b, e in zip(r["ids"], r["begins"], r["ends"], strict=True):
            piece = plain.id_to_piece(i)
            if not plain.is_byte(i):
                assert raw[b:e].decode().replace(" ", "▁") == (piece[1:] if b == 0 and piece.startswith("▁") and raw[b:e].decode().replace(" ", "▁") != piece else piece)


def test_encoding_keeps_other_columns(spark, model):
    docs = spark.createDataFrame([(1, "a b c", "mine"), (1, "a b c", "mine")], DOCS + ", ids string")
    assert [r["n_tokens"] for r in sentencepiece_codec.digest(docs, model).collect()] == [len(sentencepiece.SentencePieceProcessor(model_proto=model).encode("a b c"))] * 2
    assert [r["n_tokens"] for r in sentencepiece_codec.encode(docs, model).collect()] == [len(sentencepiece.SentencePieceProcessor(model_proto=model).encode("a b c"))] * 2


def test_digest_equals_encode(spark, model):
    import hashlib

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], DOCS)
    full = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs, model).collect()}
    for r in sentencepiece_codec.digest(docs, model).collect():
        f = full[r["doc_id"]]
        assert r["tiled"] and r["n_tokens"] == f["n_tokens"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, f["ids"])).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(f["decoded"].encode()).hexdigest()
    assert sentencepiece_codec.digest(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    parts = {n: dict(sentencepiece_codec._fields(v)) for n, v in sentencepiece_codec._fields(library.serialized_model_proto()) if n in (2, 3)}
    own = sentencepiece_codec.Normaliser(parts[3])
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("aAbé\u0301ﬁ①ｶﾞ  Ⅷ½Ω한각\u200b\u3000x") for _ in range(rng.randint(0, 12)))
        made, align = own.normalise(text)
        assert made.decode() == library.normalize(text)
        assert len(align) == len(made) + 1 and (np.diff(align) >= 0).all() and 0 <= align[0] and align[-1] <= len(text.encode())
