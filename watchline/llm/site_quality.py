"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on a document's own counts gives its evidence. The evidence of a path's documents is
shrunk towards its host's, and a host's towards that of all documents, the more so the fewer they are; how
much is learnt from how far hosts, and paths within hosts, differ. A document's log odds are its own plus how
far its path stands from the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import staged
from watchline.llm.quality_rules import counted

#: Labelled documents that the regression learns from at most, those of the least hashes of their ids.
LABELLED = 20_000
#: Groups that a broadcast may hold; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
SALTS = 32
#: Evidence is kept this far from 0 and 1, and a shrinkage weight within these bounds, in documents.
MARGIN, LEAST_WEIGHT, MOST_WEIGHT = 1e-3, 1.0, 1e4


def evidence_features() -> list[Column]:
    c = lambda name: F.col(name).cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    letters = F.greatest(c("n_letters"), F.lit(1.0))
    return [
        F.least(F.log1p(c("n_words")), F.lit(5.0)),
        F.least(c("n_symbols") / words, F.lit(1.0)),
        F.least(c("n_upper") / letters, F.lit(1.0)),
        F.least(c("n_marks") / words, F.lit(1.0)),
        c("n_lettered") / words,
        c("n_letters") / F.greatest(c("word_chars"), F.lit(1.0)),
        c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        c("n_repeat_words") / words,
        F.least(c("word_chars") / words, F.lit(20.0)),
    ]


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic regression on unscaled features."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    full = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        h = p * (1 - p) + 1e-9
        w += np.linalg.solve((full * h[:, None]).T @ full + np.eye(len(w)), full.T @ (y - p) - w)
    coefficients = np.where(scale > 1e-6, w[:-1] / scale, 0.0)
    return coefficients, float(w[-1] - center @ coefficients)


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def shrinkage(groups: DataFrame, prior: str) -> float:
    """The prior's weight, in documents: inner variance over the variance between groups, by moments."""
    mean = F.col("total") / F.col("n")
    row = groups.agg(
        F.sum(F.col("squares") - F.col("n") * mean * mean).alias("inner"), F.sum(F.col("n") - 1).alias("freedom"),
        F.sum(F.col("n") * (mean - F.col(prior)) ** 2).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"),
    ).first()
    if not row.n or not row.freedom:
        return MOST_WEIGHT
    inner = row.inner / row.freedom
    between = max(0.0, (row.between - row.k * inner) / row.n)
    return float(np.clip(inner / between if between > 0 else MOST_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT))


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares"))


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, posterior, kept`` of each row.

    ``host`` and ``path`` name columns; a null host or path is a group of its own. Null and empty texts have the
    evidence of a text without words. Rows without label or id teach nothing; of several labels of one id the
    lowest counts. Without labels of both kinds all evidence is 1/2. Repeated rows count as often as they are there.
    """
    features = evidence_features()
    keyed = docs.select(F.struct("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")).alias("doc_id"), "text")
    rows = staged(counted(keyed, "struct<doc_id:bigint,host:string,path:string>").select("doc_id.*", F.array(*features).alias("x")))
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # bounded, so it may be broadcast
    # One row of each id, the least one, so that LABELLED bounds what comes to the driver.
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    x, y = np.array([r.x for r in sample]), np.array([float(r.quality > 0) for r in sample])
    coefficients, intercept = regression(x, y) if len(set(y)) == 2 else (np.zeros(len(features)), 0.0)
    z = F.lit(float(intercept))
    for i, c in enumerate(coefficients):
        z = z + F.col("x")[i] * float(c)
    evidence = F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(MARGIN)), F.lit(1 - MARGIN))
    rows = rows.select("doc_id", "host", "path", evidence.alias("evidence"))

    paths = staged(sums(rows, "host", "path"))
    whole = paths.agg(F.sum("total") / F.sum("n")).first()[0]
    whole = min(max(whole, MARGIN), 1 - MARGIN) if whole is not None else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).withColumn("whole", F.lit(float(whole)))
    weight = shrinkage(hosts, "whole")
    hosts = hosts.select("host", ((F.col("total") + weight * whole) / (F.col("n") + weight)).alias("host_posterior"))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    placed = paths.join(hosts, same(paths, hosts, ["host"])).drop(hosts["host"])
    within = shrinkage(placed, "host_posterior")
    groups = staged(placed.select("host", "path", "host_posterior", ((F.col("total") + within * F.col("host_posterior")) / (F.col("n") + within)).alias("path_posterior")))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    groups = groups.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_posterior", "path_posterior")
    found = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    if few:
        joined = rows.join(F.broadcast(groups), found)
    else:  # a host may hold a third of all rows: its rows are dealt over SALTS tasks, each with a copy of its groups
        salted = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")).join(salted, found & (F.col("salt") == F.col("s")))
    odds = log_odds(F.col("evidence")) + log_odds(F.col("path_posterior")) - F.lit(float(np.log(whole / (1 - whole))))
    posterior = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "evidence", "host_posterior", "path_posterior", posterior.alias("posterior"), (posterior >= threshold).alias("kept"))
