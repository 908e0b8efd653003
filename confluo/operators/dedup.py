"""First-seen, last-write-wins and duplicate-group operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.functions.text import normal_action
from confluo.operators import scan


def first_seen(rows: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """The first row of each normalised text a key, as one grouped minimum; blank texts go."""
    named = rows.withColumn("__n", normal_action(F.col(text))).where("__n <> ''")
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__m")
    return named.groupBy(key, "__n").agg(first).select("__m.*")


def last_write(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The latest row of each key, as one grouped maximum."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("m")).select(*keys, "m.*")


_OPEN = "coalesce(continuation_of, 0) = 0 and coalesce(correction_of, 0) = 0"


def duplicate_types(insights: DataFrame) -> DataFrame:
    """Types that a window has more than once, continuations and corrections left out."""
    return insights.where(_OPEN).groupBy("stream_id", "window_id", "insight_type").agg(F.count("*").alias("n")).where("n > 1")


def consolidate(insights: DataFrame) -> DataFrame:
    """One row a duplicate group: the highest confidence, the first text and classification, and an id after the stream's last one."""
    g = insights.where(_OPEN).groupBy("stream_id", "window_id", "insight_type")
    first = [F.min_by(c, "insight_id").alias(c) for c in ("insight_text", "classification")]
    rows = g.agg(F.max("confidence").alias("confidence"), *first, F.count("*").alias("n")).where("n > 1")
    last = insights.groupBy("stream_id").agg(F.max("insight_id").alias("__last"))
    line = W.partitionBy("stream_id").orderBy("window_id", "insight_type")
    return rows.join(last, "stream_id").withColumn("insight_id", F.col("__last") + F.row_number().over(line)).drop("__last")


def trimmed_cues(cues: DataFrame, parts: int | None = None) -> DataFrame:
    """Cues of a stream with each end at most a millisecond before the next start."""
    n = scan.next_value(cues, "stream_id", ["ts_start", "window_id"], "ts_start", "__next", parts)
    return n.withColumn("ts_end", F.least("ts_end", F.coalesce(F.col("__next") - 0.001, F.col("ts_end")))).drop("__next")
