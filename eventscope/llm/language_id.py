"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  Binary logistic classifiers over hashed character n-grams
predict the bits; a text gets the language whose codeword loses least, each bit weighted by how well
its classifier does on that language.  A small lead over the second language marks a text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows; prediction runs in Arrow batches
over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import materialize

#: Labelled rows that are learned from at most, and buckets that n-grams are hashed to.
TRAIN_ROWS, BUCKETS = 3_000, 2_048
#: Characters that are looked at in one step.
WINDOW = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L* occurs; digits, numerals such as ``Ⅷ`` and ``²``, and marks are none."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of square-root counts of character 1-, 2- and 3-grams; case and non-letters are folded."""
    counts = np.zeros(BUCKETS)
    lower = re.sub(r"[\W\d_]+", " ", text.lower())
    for at in range(0, max(1, len(lower)), WINDOW):
        part = lower[max(0, at - 2) : at + WINDOW]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        new = at - max(0, at - 2)  # the first characters were counted before
        for n, factors in ((1, (2654435761,)), (2, (2654435761, 2246822519)), (3, (2654435761, 2246822519, 3266489917))):
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n * 668265263, dtype=np.uint64)
                for k, f in enumerate(factors):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(f) & np.uint64(0xFFFFFFFF)
                    h ^= h >> np.uint64(15)
                counts += np.bincount((h[max(0, new - n + 1) :] % BUCKETS).astype(np.int64), minlength=BUCKETS)
    root = np.sqrt(counts)
    norm = np.sqrt(root @ root)
    return root / norm if norm else root


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language: all different splits for few languages, else the best of some seeded draws."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        splits = range(1, 2 ** (languages - 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(languages)], dtype=float)
    rng, bits, best = np.random.default_rng(9), int(np.ceil(10 * np.log2(languages))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = ((code[:, None] != code[None]).sum(2) + np.eye(languages, dtype=int) * bits).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits; rows sum to 1
    margin: float = 0.1

    def predict(self, x: np.ndarray) -> tuple[int, float, bool]:
        """Index of the language, its score from 0 to 1, and whether it is ambiguous."""
        if len(self.languages) == 1:
            return 0, 1.0, False
        loss = (self.trust * np.logaddexp(0, -self.code * (x @ self.weights + self.bias))).sum(1)
        chance = np.exp(-4 * (loss - loss.min()))
        chance /= chance.sum()
        order = np.argsort(loss, kind="stable")
        return int(order[0]), float(chance[order[0]]), bool(loss[order[1]] - loss[order[0]] < self.margin)


def fit(x: np.ndarray, labels: list[str], steps: int = 200) -> Model:
    """Fit all bits at once by full-batch Adam on the logistic loss."""
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 1)), np.zeros(1), np.ones((len(languages), 1)))
    index = np.array([languages.index(v) for v in labels])
    y = code[index]
    balance = (len(index) / len(languages) / np.bincount(index))[index][:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        g = -y * balance / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        for k, (p, grad) in enumerate(((w, x.T @ g + 1e-5 * w), (b, g.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            p -= 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    right = np.sign(x @ w + b) == y
    trust = np.array([right[index == i].mean(0) for i in range(len(languages))]) + 1e-6
    return Model(languages, code, w, b, trust / trust.sum(1, keepdims=True))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from ``(doc_id, text, lang)``; None if there is nothing to learn from.

    Rows with a null id, text or language, or without a letter, are not learned from.  At most ``rows``
    documents are used: those whose ids come first by hash.  Of several rows of one id, the one whose text
    comes first by hash counts, so that repeated rows and their order change nothing.
    """
    usable = labelled.filter("doc_id is not null and text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("order"))
    # the ids of the lowest hashes lie in a share of the hashes' range, several times as wide as ``rows`` ids need
    share = min(1.0, 4 * rows / max(1, labelled.filter("lang is not null").count()))
    while True:
        near = usable.filter(F.col("order") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else usable
        if share >= 1 or near.select("order").distinct().count() >= rows:
            break
        share = min(1.0, 4 * share)  # rows repeat
    once = near.groupBy("order", "doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), F.col("text"), F.col("lang"))).alias("first"))
    sample = materialize(once.select("order", "doc_id", "first.text", "first.lang"), "language-sample")
    last = sample.select("order", "doc_id").orderBy("order", "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(made, pa.binary())], ["lang", "order", "x"])

    chosen = sample.join(F.broadcast(last), ["order", "doc_id"], "left_semi")  # ``rows`` keys at most
    got = sorted(map(tuple, chosen.select("text", "lang", "order").mapInArrow(run, "lang string, order bigint, x binary").collect()), key=lambda r: (r[1], r[0], r[2]))
    return fit(np.array([np.frombuffer(r[2], np.float32) for r in got], dtype=np.float64), [r[0] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row of ``docs`` (``doc_id, text``).

    A text that is null or has no letter gets ``und`` with score 0, and so does every text if there is no model.
    Of languages with equal losses the first by name is chosen, and the text is ambiguous.  Repeated rows are
    each predicted, null ids too; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in (t.as_py() for t in batch.column("text")):
                if model is None or text is None or not has_letter(text):
                    out.append(("und", 0.0, False))
                else:
                    k, score, unsure = model.predict(features(text))
                    out.append((model.languages[k], score, unsure))
            lang, score, unsure = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
