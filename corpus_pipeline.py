"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  ``run`` writes
every stage as Parquet in the shared folder and rereads it, so that a lost executor costs one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventscope.llm import jaccard, mixing, secrets, sentencepiece_codec, site_quality
from eventscope.llm.common import materialize, packed, read_table, unpacked
from eventscope.llm.queries import sites_of, tokenizer_model
from eventscope.sources.storage import release, written

SEED = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier rejects go."""
    judged = site_quality.classify(sites_of(packed(docs, "doc_id", "text", "source", "lang")), read_table(spark, sf_dir, "labels"), keep=["__row"])
    return unpacked(judged.filter("accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return jaccard.keep_one(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by placeholders; no document goes."""
    cleaned = secrets.redact(secrets.scan(packed(docs, "doc_id", "text")))
    return unpacked(cleaned, text=cleaned["text"]).select(*[f"`{c}`" for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks."""
    return mixing.mix(docs, seed=SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken document as token ids with the byte spans of its pieces."""
    return sentencepiece_codec.encode(docs, tokenizer_model()).select("doc_id", "n_tokens", "ids", "begins", "ends")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", tokens),
]

#: Fitted and iterated stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = read_table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        release(spark, mark, keep=1)  # all but this stage's result
    return docs
