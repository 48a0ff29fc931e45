"""Quality classification with hierarchical empirical Bayes.

A logistic classifier gives each document's evidence.  Hosts and paths get posteriors from grouped
sums of that evidence: a path's mean is shrunk toward its host's, the host's toward the global mean,
by the ratio of variance within groups to variance between them, so that sparse sites fall back on
what is known above them.  A document's log-odds are its evidence moved by the log-odds of its path
without the document itself against the global ones; a page alone on its site gets the global prior.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm import quality_rules
from eventscope.llm.common import join_small_or_large, materialize

#: Labelled rows that the classifier is fitted on at most.
TRAIN_ROWS = 20_000
#: The table of paths is broadcast up to this many rows, else joined by shuffle.
BROADCAST_SITES = 100_000
FEATURES = ("log_words", "word_length", "symbols", "stop_words", "dup_lines", "repeats", "long_words")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``measures`` and one column ``f_<name>`` per feature, each in a bounded range."""
    made = quality_rules.measure(docs)
    m = F.col("measures")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    value = {
        "log_words": F.log1p(m["n_words"]), "word_length": F.least(m["mean_word_length"], F.lit(30.0)), "symbols": F.sqrt(F.least(m["symbol_ratio"], F.lit(1.0))),
        "stop_words": m["stop_word_ratio"], "dup_lines": m["dup_line_ratio"], "repeats": ratio(m["n_repeat_words"], m["n_words"]),
        "long_words": (m["mean_word_length"] > 9).cast("double"),
    }
    return made.withColumns({f"f_{name}": value[name].cast("double") for name in FEATURES}).drop("measures")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[float], float] | None:
    """Coefficients by feature and intercept, from ``labels`` (``doc_id, quality`` 0 or 1); None if one class is missing.

    At most ``rows`` labels are used, those whose ids come first by hash, and one row of ``docs`` for each, the
    first by hash of its text: repeated rows change nothing.  A null text counts as empty, labels without a
    document and rows with a null id or quality are left out; of several labels of one id the higher counts.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "quality-labels")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = named.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.first("label").alias("label"))
    sample = materialize(features(once).drop("text"), "quality-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="x").transform(sample)
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, maxIter=100).fit(vectors)
    return [float(c) for c in model.coefficients], float(model.intercept)


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(bounded / (1 - bounded))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """``(host, path, n, s, hn, hs)``: documents and evidence of each path and host, null ones being groups of their own; and the priors.

    The priors are the global ``mean``, and ``host_worth`` and ``path_worth``: how many documents the prior
    above a host or path is worth, variance inside over variance between by the method of moments.
    """
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("paths"), F.count("*").alias("k")).first()
    above = hosts.agg(F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hosts"), F.count("*").alias("k")).first()
    if not whole["n"]:
        return paths.select("host", "path", "n", "s", F.lit(0.0).alias("hn"), F.lit(0.0).alias("hs")), {"mean": 0.5, "host_worth": 1.0, "path_worth": 1.0}
    mean = whole["s"] / whole["n"]
    inside = max(1e-6, (whole["q"] - whole["paths"]) / max(1.0, whole["n"] - whole["k"]))

    def worth(between: float, groups: int, over: int) -> float:
        free = max(1, groups - over)
        spread = (between / free - inside) / max(1.0, whole["n"] / max(1, groups))
        return min(1e6, max(1.0, inside / spread)) if spread > 0 else 1e6

    priors = {"mean": mean, "host_worth": worth(above["hosts"] - whole["s"] ** 2 / whole["n"], above["k"], 1), "path_worth": worth(whole["paths"] - above["hosts"], whole["k"], above["k"])}
    named = hosts.withColumnRenamed("host", "h")
    return paths.join(named, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "hn", "hs"), priors


def path_prior(p: Column, sums: Column, priors: dict[str, float]) -> Column:
    """The posterior mean of a document's path from all other documents; ``p`` is its own evidence, ``sums`` a row of ``site_sums``."""
    host = (sums["hs"] - p + priors["host_worth"] * priors["mean"]) / (sums["hn"] - 1 + priors["host_worth"])
    return (sums["s"] - p + priors["path_worth"] * host) / (sums["n"] - 1 + priors["path_worth"])


def classify(docs: DataFrame, labels: DataFrame, accept_at: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` (``doc_id, text, host, path``, any others) with ``p_document, site_prior, posterior, accepted``.

    ``keep`` names the columns of ``docs`` to return, all unless given.  They are written once with the
    evidence, so that no text is measured twice.

    Null texts count as empty, null hosts and paths are groups of their own, repeated rows are each judged.
    Without labels of both classes every document is accepted with posterior 0.5.  Columns of the added
    names are replaced.
    """
    docs = docs.drop("p_document", "site_prior", "posterior", "accepted")
    kept = [f"`{c}`" for c in keep or docs.columns]
    model = train(docs, labels)
    if model is None:
        half = F.lit(0.5)
        return docs.select(*kept).withColumns({"p_document": half, "site_prior": half, "posterior": half, "accepted": F.lit(True)})
    weights, bias = model
    needed = docs.select("text", F.struct("host", "path").alias("site"), F.struct(*kept).alias("row"))
    evidence = reduce(Column.__add__, [F.col(f"f_{n}") * w for n, w in zip(FEATURES, weights, strict=True)], F.lit(bias))
    made = features(needed).select("row", "site", evidence.alias("logit"))
    made = materialize(made.withColumn("p", _chance(F.col("logit"))), "quality-evidence")
    sums, priors = site_sums(made.select("site.host", "site.path", "p"))
    sites = materialize(sums.select(F.struct("host", "path").alias("site"), F.struct("n", "s", "hn", "hs").alias("sums")), "quality-sites")
    joined = join_small_or_large(made, sites, "site", "left", BROADCAST_SITES)
    judged = joined.withColumn("prior", path_prior(F.col("p"), F.col("sums"), priors))
    judged = judged.withColumn("posterior", _chance(F.col("logit") + _logit(F.col("prior")) - _logit(F.lit(priors["mean"]))))
    return judged.select("row.*", F.col("p").alias("p_document"), F.col("prior").alias("site_prior"), "posterior", (F.col("posterior") >= accept_at).alias("accepted"))
