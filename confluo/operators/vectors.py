"""Similarity, centroids and validity of vectors in built-in array functions; neighbours.py searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.operators import neighbours
from confluo.operators.shared import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), F.lit(-1.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def validity(v: Column, min_norm: float = 0.1, min_mean: float = 1e-6, max_zero: float = 0.5, most: float = 100.0) -> Column:
    """The first rule a vector breaks, else 'valid'."""
    size = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)) / size
    zeros = F.size(F.filter(v, lambda x: F.abs(x) <= 1e-8)) / size
    return (
        F.when(v.isNull() | (size == 0), "empty").when(F.forall(v, lambda x: F.abs(x) <= 1e-8), "all_zeros").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "nan_or_inf")
        .when(dot(v, v) < 1e-8, "zero_norm").when(F.exists(v, lambda x: F.abs(x) > most), "extreme").when(norm(v) < min_norm, "low_norm").when(mean < min_mean, "low_mean").when(zeros > max_zero, "sparse").otherwise("valid")
    )


def relevance_gate(d: Column, at: float = 0.35, faithful: bool = True) -> Column:
    """Pass where 1 - D^2 / 2 (as the service does) or the true cosine 1 - D / 2 reaches the threshold; no index passes."""
    return F.coalesce((1 - (d * d if faithful else d) / 2) >= at, F.lit(True))


#: The thresholds of validity for ordinary, good and difficult sound: norm, mean size, share of zeros.
PROFILES = {"default": (0.1, 1e-6, 0.5), "strict": (0.2, 1e-5, 0.3), "lenient": (0.05, 1e-7, 0.7)}


def profiled(v: Column) -> Column:
    """The first rule that a vector breaks under each profile, by name."""
    return F.create_map(*[x for name, limits in PROFILES.items() for x in (F.lit(name), validity(v, *limits))])


def similar_speakers(vecs: DataFrame, key: str, weight: str, at: float, most: int) -> DataFrame:
    """(a, b, cos): of all pairs of speakers (numbers) the ``most`` whose centroids are the most alike, from ``at`` on, each once, ties by
    number. Unit vectors of a cosine are within 2 - 2 * cosine of each other, so pairs come from the search by distance."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"])
    c = cut(centroids(vecs, key, weight).groupBy(F.col(key).cast("long").alias("vec_id")).agg(rows.alias("v")))
    pairs = neighbours.within(c, c, 2 - 2 * at).where("query_id < vec_id")
    alike = pairs.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.round(1 - F.col("d") / 2, 6).alias("cos"))
    return alike.orderBy(F.desc("cos"), "a", "b").limit(most)


def centroids(vecs: DataFrame, key: str, weight: str) -> DataFrame:
    """Unit weighted mean vectors as (key, dim, x): sums by dimension, combined before the shuffle."""
    s = vecs.select(key, weight, F.posexplode("v").alias("dim", "x")).groupBy(key, "dim")
    s = s.agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("m"))
    return s.withColumn("x", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(key)))).select(key, "dim", "x")


def least_best_match(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, least): of the best cosines of a's vectors among b's the least; ``pairs`` has a row a vector pair (va, vb, cos)."""
    return pairs.groupBy(a, b, "va").agg(F.max("cos").alias("best")).groupBy(a, b).agg(F.min("best").alias("least"))


def score_distribution(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, n, mean, sd, least, most, p25, p50, p75) of each key's scores: the spread over all of them, percentiles by linear
    interpolation. Null scores and scores of zero don't count; a key without others has no row."""
    x = F.col(score)
    quarter = lambda p, name: F.percentile(score, F.lit(p)).alias(name)
    real = scores.where((x != 0) & x.isNotNull()).groupBy(key)
    return real.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"), quarter(0.25, "p25"), quarter(0.5, "p50"), quarter(0.75, "p75"))


def plane(vecs: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, x, y): unit centroids on the two main axes of their spread, an axis' largest part positive; zeros for one key.

    The spread is a matrix of the vectors' length squared, summed by its cells over all centroids; it alone goes to the driver, whose
    two eigenvectors come back as a table of as many rows as the vectors are long. Any number of keys is projected by a join.
    """
    c = cut(centroids(vecs, key, weight))
    means = c.groupBy("dim").agg(F.avg("x").alias("m"))
    moved = c.join(means, "dim").select(key, "dim", (F.col("x") - F.col("m")).alias("x"))
    held = moved.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("v"))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if b.num_rows:
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], names=["i", "j", "s"])

    sums = held.select("v").mapInArrow(outer, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    schema = "dim int, a double, b double"
    size = 1 + max((r["i"] for r in sums), default=-1)
    spread = np.zeros((size, size))
    for r in sums:
        spread[r["i"], r["j"]] = r["s"]
    values, axes = np.linalg.eigh((spread + spread.T) / 2)
    axes = axes[:, np.argsort(-values)[:2]].T * (np.sort(values)[::-1][:2, None] > 1e-12)
    axes = np.vstack([axes, np.zeros((2 - len(axes), size))])
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1, 1) if size else axes
    table = vecs.sparkSession.createDataFrame([(k, float(axes[0, k]), float(axes[1, k])) for k in range(size)], schema)
    xy = moved.join(table, "dim").groupBy(key).agg(*(F.round(F.sum(F.col("x") * F.col(n)), 6).alias(m) for n, m in (("a", "x"), ("b", "y"))))
    return xy.select(key, (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


def pairs_within(vecs: DataFrame, key: str) -> DataFrame:
    """Pairs of vectors of one group (a < b) with their cosine; groups are single speakers or chunks, small by nature."""
    a, b = vecs.select(key, F.col("vec_id").alias("a"), F.col("v").alias("va")), vecs.select(key, F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, key).where("a < b").select(key, "a", "b", cosine(F.col("va"), F.col("vb")).alias("cos"))


def softmax_confidence(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, best, confidence): p_best * (0.7 + 0.3 * (p1 - p2)); the gap of a single score is 1."""
    g, line = W.partitionBy(key), W.partitionBy(key).orderBy(F.desc(score), "candidate")
    p = scores.withColumn("__e", F.exp(F.col(score) - F.max(score).over(g))).withColumn("__p", F.col("__e") / F.sum("__e").over(g)).withColumn("__r", F.row_number().over(line))
    out = p.groupBy(key).agg(F.max(F.when(F.col("__r") == 1, F.col("candidate"))).alias("best"), F.max(F.when(F.col("__r") == 1, F.col("__p"))).alias("p1"), F.max(F.when(F.col("__r") == 2, F.col("__p"))).alias("p2"))
    return out.select(key, "best", (F.col("p1") * (0.7 + 0.3 * F.coalesce(F.col("p1") - F.col("p2"), F.lit(1.0)))).alias("confidence"))


def transitions(turns: DataFrame) -> DataFrame:
    """(from, to, n, bonus) over consecutive turns of a stream with different speakers."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    t = turns.withColumn("from_speaker", F.lag("speaker").over(line)).where("from_speaker <> speaker").groupBy("from_speaker", F.col("speaker").alias("to_speaker")).agg(F.count("*").alias("n"))
    return t.withColumn("bonus", F.least(F.col("n") / F.sum("n").over(W.partitionBy("from_speaker")) * 0.03, F.lit(0.03)))
