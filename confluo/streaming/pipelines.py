"""Structured Streaming forms: the batch operators over micro-batches, with watermarks of our own."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from confluo.functions.text import normal_action
from confluo.operators import cluster


def source(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """Files of ``path`` as a stream, in micro-batches of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Event time with the session's zone: watermarks need it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def health_per_minute(requests: DataFrame, delay: str = "10 seconds") -> DataFrame:
    w = F.window("ts", "1 minute")
    g = _timed(requests, "ts").withWatermark("ts", delay).groupBy(w, "plugin").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
    return g.select(F.col("window.start").alias("minute"), "plugin", "total", "ok")


def sliding_energy(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Mean square of samples in windows of 2.5 s every 2 s."""
    w = F.window("ts", "2500 milliseconds", "2000 milliseconds")
    return _timed(frames, "ts").withWatermark("ts", delay).groupBy("stream_id", w).agg(F.avg(F.col("sample") * F.col("sample")).alias("mean_square"), F.count("*").alias("n")).select("stream_id", F.col("window.start").alias("start"), "mean_square", "n")


def tumbling_energy(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Mean square of samples in windows of 10 s side by side; the last, partial one comes when the watermark passes it."""
    w = F.window("ts", "10 seconds")
    g = _timed(frames, "ts").withWatermark("ts", delay).groupBy("stream_id", w)
    return g.agg(F.avg(F.col("sample") * F.col("sample")).alias("mean_square"), F.count("*").alias("n")).select("stream_id", F.col("window.start").alias("start"), "mean_square", "n")


def first_actions(windows: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first window of each normalised action of a stream; blank ones go. State lasts as long as the watermark's delay."""
    named = _timed(windows, ts).withColumn("norm", normal_action(F.col("text"))).where("norm <> ''")
    return named.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["stream_id", "norm"])


def count_windows(windows: DataFrame, n: int) -> DataFrame:
    """(stream_id, summary_id, text, ts_start, ts_end): once n windows of a stream are pending, they are one; a rest stays in the
    stream's state. Windows of a micro-batch are taken by id; the end is that of the last-starting window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, pending = state.get if state.exists else (0, "[]")
        rows = json.loads(pending)
        for pdf in batches:
            rows += pdf[["window_id", "text", "ts_start", "ts_end"]].values.tolist()
        rows.sort(key=lambda r: r[0])
        out = []
        while len(rows) >= n:
            now, rows = sorted(rows[:n], key=lambda r: (r[2], r[0])), rows[n:]
            out.append((key[0], done, " ".join(r[1] for r in now if r[1]), now[0][2], now[-1][3]))
            done += 1
        state.update((done, json.dumps(rows)))
        yield pd.DataFrame(out, columns=["stream_id", "summary_id", "text", "ts_start", "ts_end"])

    schema = "stream_id long, summary_id long, text string, ts_start double, ts_end double"
    return windows.groupBy("stream_id").applyInPandasWithState(run, schema, "done long, pending string", "append", GroupStateTimeout.NoTimeout)


def online_speakers(turns: DataFrame, settings: cluster.Settings | None = None) -> DataFrame:
    """(stream_id, turn_id, speaker, confidence): the batch operator's clusterer as a stream's state; -1 is nobody known. Turns of a
    micro-batch are taken in order of start. A stream's state holds its speakers: eight prototypes and fifty chunks each."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = pickle.loads(state.get[0]) if state.exists else cluster.Clusterer(settings)
        out = []
        for r in pd.concat(list(batches)).sort_values(["start", "turn_id"]).itertuples():
            k, conf = c.identify(np.asarray(r.v, float), r.start, r.start, r.end, r.chunk, r.label, r.is_overlap, r.is_onset, r.duration)
            out.append((key[0], r.turn_id, -1 if k is None else k, round(conf, 6)))
        state.update((pickle.dumps(c),))
        yield pd.DataFrame(out, columns=["stream_id", "turn_id", "speaker", "confidence"])

    schema = "stream_id long, turn_id long, speaker long, confidence double"
    return turns.groupBy("stream_id").applyInPandasWithState(run, schema, "memory binary", "append", GroupStateTimeout.NoTimeout)


def rendezvous(a: DataFrame, b: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each (stream, window) once both streams have it."""
    x = _timed(a, ts).withWatermark(ts, delay).select("stream_id", "window_id", F.col(ts).alias("ts_a"))
    y = _timed(b, ts).withWatermark(ts, delay).select(F.col("stream_id").alias("s2"), F.col("window_id").alias("w2"), F.col(ts).alias("ts_b"))
    near = (F.col("ts_b") >= F.col("ts_a") - F.expr(f"interval {delay}")) & (F.col("ts_b") <= F.col("ts_a") + F.expr(f"interval {delay}"))
    return x.join(y, (F.col("stream_id") == F.col("s2")) & (F.col("window_id") == F.col("w2")) & near).select("stream_id", "window_id")


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, batch by batch, exactly once by the checkpoint."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
