"""Quality rules: fixed limits on document statistics, then boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import trees
from confluo.llm.common import ID, TEXT, id_type, narrow
from confluo.llm.doc_stats import FEATURES, base_stats, features

#: The trees are fitted on so many labelled documents at most: those with the smallest hash of the id.
SAMPLE = 20_000
#: Fixed limits of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: A document goes when the trees give good quality less than this probability.
KEEP_AT = 0.3
_FEATURE_SCHEMA = ", ".join(f"{f} double" for f in FEATURES)


def labelled_features(d: DataFrame, labels: DataFrame, label: str, label_id: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of a bounded sample of labelled documents; ``d`` has ID and TEXT.

    An id with two labels has the smaller one, an id with several texts the first of them in order, so reruns agree and
    no more than ``sample`` rows come to the driver.
    """
    known = labels.select(F.col(label_id).alias("__pick"), F.col(label).cast("double").alias("__y")).na.drop()
    some = known.groupBy("__pick").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__pick"), "__pick").limit(sample)
    found = d.join(F.broadcast(some), F.col(ID) == F.col("__pick"))  # at most `sample` ids and labels are broadcast
    picked = found.groupBy("__pick", "__y").agg(F.min(TEXT).alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(raw, raw.decode("utf-8", "replace"), base_stats(raw, raw.decode("utf-8", "replace"))) for t in b.column(2).cast(pa.binary()).to_pylist() for raw in (t or b"",)]
            cols = list(zip(*x)) if x else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), *(pa.array(c, pa.float64()) for c in cols)], names=["pick", "y", *FEATURES])

    rows = picked.mapInArrow(run, f"pick string, y double, {_FEATURE_SCHEMA}").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the same order, and so the same model, on each run
    return rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float)


def fit_rules(d: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE) -> trees.Forest:
    return trees.fit(*labelled_features(d, labels, label, label_id, sample), signs=list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, sample: int = SAMPLE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row.

    ``score`` is the trees' probability of good quality; ``kept`` is false where the base rules fail, else
    score >= keep_at. A null text has no words and so fails; null ids and repeated rows pass through; without
    usable labels the trees give the base rate (0.5 for none); an empty table gives no rows; other columns are ignored.
    """
    d = narrow(docs, id_col, text_col)
    model = fit_rules(d, labels, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, x = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                raw = t or b""
                text = raw.decode("utf-8", "replace")
                base = base_stats(raw, text)
                x.append(features(raw, text, base))
                stats.append((len(base[0]), *base[1:]))
            s = np.array(stats, np.int64).reshape(-1, 5)
            score = 1 / (1 + np.exp(-model.raw(np.array(x, float).reshape(-1, len(FEATURES)))))
            failed = (s[:, 0] < LEAST_WORDS) | (100 * s[:, 4] > MOST_REPEATED_PERCENT * s[:, 0])
            cols = [b.column(0), *(pa.array(s[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *counts, "base_failed", "kept", "score"])

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = ", ".join(f"{c} long" for c in counts)
    return d.mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, {kinds}, base_failed boolean, kept boolean, score double")
