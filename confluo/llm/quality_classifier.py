"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence is a logistic score on its statistics. Grouped sums of those probabilities give each
host (first level) and path (both levels) a mean; a mean over n documents is shrunk as
(sum + m * parent's mean) / (n + m), where m, the prior's strength, comes from the spread of the groups' means by
the method of moments over all groups. The posterior log-odds add the site's shift from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import trees
from confluo.llm.common import ID, KEY, TEXT, cut, release, row_key
from confluo.llm.doc_stats import FEATURES, base_stats, features
from confluo.llm.quality_rules import SAMPLE, labelled_features

KEEP_AT, SALT = 0.5, 16
#: Weight of the site's shift against the document's own evidence, which the site's mean also holds.
SITE_WEIGHT = 0.5


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def evidence(d: DataFrame, model: trees.Forest, *carry: str) -> DataFrame:
    """The columns ``carry`` and p, the document's own probability of good quality."""
    kept = d.select(*carry, TEXT)
    schema = kept.drop(TEXT).schema.add("p", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x = [features(raw, text, base_stats(raw, text)) for t in b.column(len(carry)).cast(pa.binary()).to_pylist() for raw in (t or b"",) for text in (raw.decode("utf-8", "replace"),)]
            p = 1 / (1 + np.exp(-model.raw(np.array(x, float).reshape(-1, len(FEATURES)))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(p)], names=[*carry, "p"])

    return kept.mapInArrow(run, schema)


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior strength m by the method of moments: groups' means spread by mu(1-mu)/(m+1) beyond sampling noise."""
    own, mu = F.col("s") / F.col("n"), F.col(parent)
    within = F.greatest(F.col("q") / F.col("n") - own * own, F.lit(0.0)) / F.col("n")
    r = groups.where("n >= 2").agg(F.sum(F.col("n") * (F.pow(own - mu, 2) - within)), F.sum("n"), F.sum(F.col("n") * mu * (1 - mu))).first()
    if not r[1]:
        return 10.0
    between, spread = max(r[0] / r[1], 1e-6), r[2] / r[1]
    return float(np.clip(spread / between - 1, 1.0, 1e6))


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, sample: int = SAMPLE) -> DataFrame:
    """(id, evidence, host_mean, path_mean, posterior, kept) for each row; the row's key is in the column KEY.

    Null hosts or paths are sites of their own; without the columns all documents are one site; a null text has no words; null ids and repeated rows pass through;
    without usable labels the evidence is the base rate; an empty table gives no rows; other columns are ignored.
    """
    path = [F.coalesce(docs[c].cast("string"), F.lit("\x00")) if c in docs.columns else F.lit("") for c in path_cols]
    host = docs[host_col].cast("string") if host_col in docs.columns else F.lit("")
    d = docs.select(docs[id_col].alias(ID), docs[text_col].alias(TEXT), host.alias("host"), F.concat_ws("\x1f", *path).alias("path"))
    model = trees.fit(*labelled_features(d, labels, "quality", sample=sample), signs=list(FEATURES.values()))
    d = d.withColumn("host", F.coalesce("host", F.lit("\x00"))).withColumn(KEY, row_key(F.col(ID), F.col(TEXT)))
    scored = cut(evidence(d, model, ID, KEY, "host", "path"))  # ids, sites and a number a row: the texts are scored once
    sums = lambda *by: scored.groupBy(*by).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    n, s = scored.agg(F.count("*"), F.sum("p")).first()
    mu = float(s / n) if n else 0.5
    hosts = sums("host").withColumn("mu", F.lit(mu))
    m_host = _strength(hosts, "mu")
    hosts = hosts.select("host", ((F.col("s") + m_host * mu) / (F.col("n") + m_host)).alias("host_mean"))
    paths = sums("host", "path").join(hosts, "host")
    m_path = _strength(paths, "host_mean")
    sites = paths.select("host", "path", "host_mean", ((F.col("s") + m_path * F.col("host_mean")) / (F.col("n") + m_path)).alias("path_mean"))
    # A host may hold a third of all rows: its rows are dealt over SALT keys, the few site rows are repeated.
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    both = scored.withColumn("salt", F.pmod(F.col(KEY), F.lit(SALT)).cast("int")).join(salted, ["host", "path", "salt"])
    odds = _logit(F.col("p")) + SITE_WEIGHT * (_logit(F.col("path_mean")) - _logit(F.lit(mu)))
    posterior = 1 / (1 + F.exp(-odds))
    return both.select(F.col(ID).alias(id_col), KEY, F.col("p").alias("evidence"), "host_mean", "path_mean", posterior.alias("posterior"), (posterior >= keep_at).alias("kept"))


def drop_rejected(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the rows whose key was rejected."""
    out = decisions.where(~F.col("kept")).select(F.col(KEY).alias("__rejected")).distinct()
    return docs.join(out, row_key(docs[id_col], docs[text_col]) == out["__rejected"], "left_anti")
