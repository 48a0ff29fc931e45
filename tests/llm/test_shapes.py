"""Whitening and fill-in-the-middle against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import fill_middle as fm
from eventscope.llm import whitening as wh

VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "equal", "zero", "cluster", "rank one", "blocks"])
def test_eigenpairs(size, kind):
    r = np.random.default_rng(size)
    a, v = r.standard_normal((size + 5, size)), r.standard_normal(size)
    turned, _ = np.linalg.qr(r.standard_normal((size, size)))
    spread = np.concatenate([[5.0] * min(size, 3), np.linspace(1, 2, max(0, size - 3))])
    matrix = {
        "full": a.T @ a, "equal": np.eye(size) * 3, "zero": np.zeros((size, size)), "cluster": turned @ np.diag(spread * (1 + 1e-9 * np.arange(size))) @ turned.T,
        "rank one": np.outer(v, v) * 1e8, "blocks": np.diag(np.arange(size) % 3 + 1.0),
    }[kind]
    matrix, k = (matrix + matrix.T) / 2, min(4, size)
    values, vectors = wh.eigenpairs(matrix, k)
    scale = np.abs(matrix).max() or 1
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=0, atol=1e-13 * size * scale)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * size * scale and np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def check(rows, got, k):
    sound = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in sound)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (size - len(v)) for _, v in sound])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(sound) * k and {r["n"] for r in got} == {n}
    want = sorted((i, sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for (i, _), row in zip(sound, x.tolist(), strict=True))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    for c in range(k):
        white = (x - sums / n) @ vectors[:, c] / np.sqrt(values[c])
        mine = sorted((r["vec_id"], round(abs(r["whitened"]), 6)) for r in got if r["component"] == c + 1)
        assert mine == sorted((i, round(abs(float(w)), 6)) for (i, _), w in zip(sound, white, strict=True))
        assert {round(r["explained"], 9) for r in got if r["component"] == c + 1} == {round(float(values[c] / values.sum()), 9)}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(7)
    rows = [(k, (r.standard_normal(6) * [5, 4, 3, 2, 1, 1]).tolist()) for k in range(300)]
    rows += [rows[3], (3, rows[4][1]), (1000, rows[5][1]), (1001, None), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6)]
    rows += [(2000 + k, rows[9][1]) for k in range(150)]  # a third of all rows is one vector
    check(rows, wh.whiten(spark.createDataFrame(rows, VECTORS)).collect(), 4)
    short = [*rows, (3000, [1.0]), (3001, [1.0, 0.0]), (3002, [])]
    check(short, wh.whiten(spark.createDataFrame(short, VECTORS)).collect(), 4)


def test_whitening_of_little(spark):
    assert wh.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).collect() == []
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], VECTORS)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2)] * 2
    line = wh.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], VECTORS)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)} and max(r["identity_error"] for r in line) < 1e-9
    huge = wh.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0])], VECTORS)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None} and all(r["whitened"] is not None for r in huge if r["component"] == 1)


def test_whitening_reads_no_other_column(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(35)], VECTORS)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("x", "n", "component", "dim", "part", "whitened")])
    key = lambda rows: sorted((r["vec_id"], r["component"], round(r["whitened"], 9)) for r in rows)
    assert key(wh.whiten(clash).collect()) == key(wh.whiten(df).collect())


TEXTS = [
    None, "", "a", "ab", "ab c", "日本語 text", "é", "éa", "aé b", "x<P>y", "a<S>", "<M>", "hello world, foo. bar\n\nbaz" * 5, "😀😀ab😀", "ABCabc", "123", "a" * 100 + "é" * 7, "@[`{AZaz",
    "<", "<<S", "<S <M P> S> M>", "\u0000a\u007f", "éa", "x" * 63 + "y z" * 70, "ÿþ" * 9, " " * 64, "z" * 64,
]


def brute(i, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n, d = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    made = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return str((i, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(made), sha(t)))


@pytest.mark.parametrize("piece", [1 << 22, 1])
def test_middles_equal_the_stated_rules(spark, monkeypatch, piece):
    monkeypatch.setattr(fm, "PIECE", piece)
    rows = [(None if k == 13 else k, TEXTS[k % len(TEXTS)]) for k in range(12 * len(TEXTS))] + [(5, TEXTS[12])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fm.digest(fm.transform(docs)).collect()
    assert sorted(str(tuple(r)) for r in made) == sorted(brute(i, t) for i, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_middles_of_long_and_no_texts(spark):
    rows = [(1, "word été, " * 300_000), (2, "x" * 3_000_000), (3, "é" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "output", "__text", "__h1")})
    assert sorted(str(tuple(r)) for r in fm.digest(fm.transform(docs)).collect()) == sorted(brute(*r) for r in rows)
    assert fm.transform(docs.filter("false")).collect() == []
