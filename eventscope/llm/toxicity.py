"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k): one weight vector serves all ordered thresholds t_1 < t_2 < ...
The features are sparse: which words and word beginnings of a learned vocabulary a text holds, and
the density of tell-tale words.  The
result is a distribution over grades, its expectation (the severity) and a flag.

Labels only say toxic or not, so the grades of toxic training rows are thirds of the density of
tell-tale words; grade 0 is not toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import materialize

#: Labelled rows that are learned from at most, and words of the vocabulary at most.
TRAIN_ROWS, VOCABULARY = 8_000, 2_000
GRADES = 4
#: A word enters if it is in so many sample rows and its log-odds are so far above 0 that of all such
#: words one at most would be by chance.
LEAST_ROWS = 5
_WORD = re.compile(r"[^\W\d_]+")


#: Word beginnings that are features beside whole words, by length; inflected words share them.
STEMS = range(3, 8)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *[f"{word[:k]}*" for k in STEMS if k < len(word)]]


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    telling: frozenset[str]  # words that speak for toxicity
    weights: np.ndarray  # by word, then the density's
    thresholds: np.ndarray  # ascending

    def row(self, text: str | None) -> tuple[list[int], float]:
        """Indices of the words held, and the density feature."""
        counts = Counter(tokens(text))
        found: set[int] = set()
        told = 0
        for word, n in counts.items():
            hits = [p for p in parts(word) if p in self.words]
            found.update(self.words[p] for p in hits)
            told += n * any(p in self.telling for p in hits)
        return sorted(found), float(np.log1p(1000 * told / counts.total())) if told else 0.0

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(score)[..., None], -50, 50)))

    def predict(self, text: str | None) -> np.ndarray:
        held, density = self.row(text)
        return self.above(self.weights[held].sum() + density * self.weights[-1])


def fit(held: list[list[int]], density: np.ndarray, grades: np.ndarray, features: int, steps: int = 400, ridge: float = 1e-3, settled: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (``features`` words, then the density's) and thresholds that maximise the penalised ordinal likelihood, by Adam.

    ``held`` has the words of each row.  The gaps between thresholds are exponentials of free parameters,
    which keeps them in order.  Steps end early once the penalised likelihood moves by less than ``settled``
    over ten of them.
    """
    k, n, size = GRADES - 1, len(held), features + 1
    column, row = np.array([c for h in held for c in h], dtype=np.int64), np.repeat(np.arange(n), [len(h) for h in held])
    times = lambda w: np.bincount(row, weights=w[column], minlength=n) + density * w[-1]
    back = lambda r: np.append(np.bincount(column, weights=r[row], minlength=features), density @ r)
    free = np.concatenate([np.zeros(size), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    sigmoid = lambda z: 1 / (1 + np.exp(np.clip(-z, -50, 50)))
    rows, before = np.arange(n), -np.inf
    for step in range(1, steps + 1):
        w, gaps = free[:size], np.exp(free[size + 1 :])
        t = free[size] + np.concatenate([[0], np.cumsum(gaps)])
        below = np.concatenate([np.zeros((n, 1)), sigmoid(t - times(w)[:, None]), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        chance = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-9)
        if step % 10 == 0:
            now = np.log(chance).mean() - ridge * (w @ w) / 2
            if abs(now - before) < settled:
                break
            before = now
        up, down = slope[rows, grades + 1] / chance, slope[rows, grades] / chance
        dt = np.zeros((n, k + 2))
        dt[rows, grades + 1] += up
        dt[rows, grades] -= down
        dt = dt[:, 1:-1].mean(0)
        g = np.concatenate([-back(up - down) / n, [dt.sum()], [dt[i + 1 :].sum() * gaps[i] for i in range(k - 1)]])
        g[:size] -= ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        free = free + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return free[:size], free[size] + np.concatenate([[0], np.cumsum(np.exp(free[size + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic`` 0 or 1); None without labelled rows.

    At most ``rows`` labels are used, those whose ids come first by hash; of several labels of an id the
    toxic one, of several texts of an id the first by hash, so that repeated rows and their order change
    nothing.  Null labels, ids and texts are left out.  Only words that speak for toxicity become features.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = materialize(chosen, "toxic-labels")
    named = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # ``rows`` keys at most
    once = named.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(once, "toxic-sample")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({p for w in set(tokens(text.as_py())) for p in parts(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["word", "toxic"])

    toxic = F.col("toxic").cast("int").alias("toxic")
    counted = sample.select("text", toxic).mapInArrow(distinct_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    totals = chosen.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not totals["n"]:
        return None
    t, n, at, an = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5, (totals["t"] or 0) + 1.0, totals["n"] - (totals["t"] or 0) + 1.0
    z = F.log(t / (F.lit(at) - t + 1) / (n / (F.lit(an) - n + 1))) / F.sqrt(1 / t + 1 / n)
    tried = materialize(counted.filter(F.col("n") >= LEAST_ROWS).withColumn("z", z), "toxic-words")
    telling = tried.filter(F.col("z") >= NormalDist().inv_cdf(1 - 1 / max(2, tried.count())))
    chosen_words = telling.orderBy(F.col("z").desc(), "word").limit(VOCABULARY).select("word", "z").collect()
    words = {r["word"]: k for k, r in enumerate(chosen_words)}
    blank = Model(words, frozenset(r["word"] for r in chosen_words if r["z"] > 0), np.zeros(len(words) + 1), np.zeros(GRADES - 1))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [blank.row(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([h for h, _ in made], pa.list_(pa.int32())), pa.array([d for _, d in made], pa.float64())],
                ["doc_id", "toxic", "held", "density"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "text", toxic).mapInArrow(rows_of, f"doc_id {kind}, toxic int, held array<int>, density double").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    if not got:
        return None
    density, bad = np.array([r["density"] for r in got]), np.array([bool(r["toxic"]) for r in got])
    cuts = np.quantile(density[bad], [1 / 3, 2 / 3]) if bad.any() else [0, 0]
    weights, thresholds = fit([r["held"] for r in got], density, np.where(bad, 1 + np.searchsorted(cuts, density), 0), len(words))
    return Model(words, blank.telling, weights, thresholds)


def score(docs: DataFrame, model: Model | None, flag_at: float = 0.6) -> DataFrame:
    """``doc_id, grade, severity, p_toxic, toxic`` for every row of ``docs`` (``doc_id, text``).

    ``severity`` is the expected grade, ``toxic`` says that P(grade > 0) reaches ``flag_at``.  A null or
    empty text holds no words and gets the chances of such a text.  Of grades with equal chances the lowest
    counts.  Without a model all is 0 and false.  Repeated rows are each scored, null ids too; other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([np.zeros(GRADES - 1) if model is None else model.predict(t.as_py()) for t in batch.column("text")]).reshape(-1, GRADES - 1)
            chance = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chance.argmax(1), pa.int32()), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= flag_at)],
                ["doc_id", "grade", "severity", "p_toxic", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, grade int, severity double, p_toxic double, toxic boolean")
