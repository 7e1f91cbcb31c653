"""Quality: document evidence combined with what is known of its site.

Method: hierarchical empirical Bayes.  A logistic classifier over properties of
the text gives a document's evidence.  Sites (hosts) and paths within them are
beta-binomial: a site's posterior shrinks its documents' evidence toward the
global mean, a path's shrinks toward its site's, each with a strength estimated
from how much groups differ beyond chance (method of moments), so a sparse site
says little and a large one speaks for itself.  The score adds the path's
log-odds over the global ones to the document's.

Known labels that are not held out count as certain evidence, all other
documents by their classifier probability.  Groups are sums and counts, so a
host of a third of all documents costs one partial sum a task; group tables are
joined back as plain sides, which AQE may split or broadcast.

``documents`` name a host (``source``) and no address, so the path level is host
and language; with addresses the path column would be a folder.

Defined results: null and empty texts have the properties of an empty text; a
null host or path is a group of its own; rows are scored each for itself; without
labels of both classes the classifier says one half; an empty table gives an
empty table.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import let, staged
from factloom.llm.toxicity import held_out

#: Labelled documents of each class that training reads at most.
SAMPLE = 3000


def properties(text: Column) -> Column:
    """Numbers that tell prose from junk, as an array of doubles."""
    def of(t: Column) -> Column:
        return let(F.split(t, "[ \\t\\n\\x0b\\f\\r]+"), lambda words: let(F.size(words).cast("double"), lambda n: F.array(
            F.log1p(F.char_length(t).cast("double")) / 10,
            F.char_length(t) / n / 10,
            F.size(F.array_distinct(words)) / n,
            F.regexp_count(t, F.lit("[^\\p{L}\\p{N}\\s.,;:'-]")) / n,
            F.regexp_count(t, F.lit("\\p{N}")) / n,
            F.regexp_count(t, F.lit("[.!?](?=\\s|$)")) / n * 5,
            F.regexp_count(t, F.lit("(\\b\\w+\\b) \\1\\b")) / n,
            F.regexp_count(t, F.lit("\\p{Lu}")) / n,
            F.regexp_count(t, F.lit("\\n")) / n * 5)))
    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights and intercept, by Newton steps."""
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)),
                               x1.T @ (p - y) + ridge * w)
        w -= np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean and spread of the properties and the weights; None without both classes."""
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = labels.filter("quality = 1").orderBy(*order).limit(sample).unionByName(
        labels.filter("quality = 0").orderBy(*order).limit(sample))
    rows = (docs.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))  # at most 2 * sample ids
            .select("id", properties(F.col("text")).alias("x"), "quality").orderBy("id", "x").collect())
    y = np.array([r["quality"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r["x"] for r in rows], float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    return mean, spread, _logistic((x - mean) / spread, y)


def _probability(x: Column, model) -> Column:
    if model is None:
        return F.lit(0.5)
    mean, spread, weights = model
    slopes = weights[:-1] / spread
    shift = float(weights[-1] - (slopes * mean).sum())
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(s)) for s in slopes]), lambda a, b: a * b),
                      F.lit(shift), lambda s, v: s + v)
    return 1 / (1 + F.exp(-F.greatest(F.least(dot, F.lit(30.0)), F.lit(-30.0))))


def _strength(groups: DataFrame, n: str, mean: str, around: str) -> float:
    """How many documents a group's prior is worth: the moment estimate of the
    beta-binomial, from group means around their prior means."""
    variance = F.col(around) * (1 - F.col(around))
    row = groups.filter(F.col(n) > 1).agg(
        F.sum(F.col(n) * (F.col(mean) - F.col(around)) ** 2), F.sum(variance), F.sum(F.col(n) * variance),
        F.count(F.lit(1))).first()
    if not row[3] or not row[2]:
        return 1.0
    between = max((row[0] - row[1]) / (row[2] - row[1]) if row[2] > row[1] else 0.0, 1e-4)
    return float(min(max(1 / between - 1, 1.0), 1e4))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Per row: id, ``evidence`` (classifier), ``site`` (path posterior), ``score``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"),
                      F.coalesce(F.col(path_col).cast("string"), F.lit("\0")).alias("path"))
    known = staged(labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
                   .groupBy(F.col(id_col).alias("label_id")).agg(F.max("quality").alias("quality")), "labels")
    model = train(src, known)
    rows = staged(src.select("id", "host", "path", _probability(properties(F.col("text")), model).alias("evidence")),
                  "evidence")
    certain = rows.join(known, F.col("id") == F.col("label_id"), "left").withColumn(
        "y", F.coalesce(F.col("quality").cast("double"), "evidence"))
    paths = staged(certain.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "paths")
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    overall = min(max((total[1] or 0.5) / (total[0] or 1), 1e-3), 1 - 1e-3)

    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
                   .withColumn("mean", F.col("hs") / F.col("hn")).withColumn("prior", F.lit(overall)), "hosts")
    worth = _strength(hosts, "hn", "mean", "prior")
    hosts = hosts.select("host", ((F.col("hs") + worth * overall) / (F.col("hn") + worth)).alias("host_mean"))
    nested = staged(paths.join(hosts, "host").withColumn("mean", F.col("s") / F.col("n")), "nested")
    worth = _strength(nested, "n", "mean", "host_mean")
    sites = staged(nested.select("host", "path", (
        (F.col("s") + worth * F.col("host_mean")) / (F.col("n") + worth)).alias("site")), "sites")

    def odds(p: Column) -> Column:
        return F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))

    logit = odds(F.col("evidence")) + odds(F.col("site")) - odds(F.lit(overall))
    return rows.join(sites, ["host", "path"]).select(
        F.col("id").alias(id_col), "evidence", "site", (1 / (1 + F.exp(-logit))).alias("score"))
