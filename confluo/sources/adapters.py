"""Engine tables from the driver's tables: transcription windows, vectors, requests, frames, sections, insights, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcription_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), t.alias("window_id"), "text", (t * F.lit(2.0)).alias("ts_start"), (t * F.lit(2.0) + 2.5).alias("ts_end"), F.col("role").alias("speaker"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"), F.floor(F.col("vec_id") / 10).alias("chunk_id"))


def one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as windows of a single stream, each as long as its value's seconds; purchases and signups change its type."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1000000.0)
    kind = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    cols = [F.col("event_id").alias("window_id"), F.col("props").alias("text"), at.alias("ts_start"), (at + F.col("value")).alias("ts_end"), kind.alias("change")]
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("stream_id"), *cols)


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, fail = F.col("event_type"), F.col("event_type") == "error"
    plugin = F.when(kind.isin("view", "click"), "rapid_summary").otherwise("context_summary")
    why = F.when(fail, F.element_at(F.array(F.lit("parse_failure"), F.lit("timeout_failure"), F.lit("truncation_failure")), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), "ts", plugin.alias("plugin"), F.when(plugin.contains("context"), "reasoning").otherwise("fast").alias("model_type"), (~fail).alias("success"), why.alias("failure_type"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), (F.unix_timestamp("ts") - 1704067200).alias("media_s"), (F.col("value") / 500).alias("sample"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = transcription_windows(spark, sf_dir)
    start = F.col("window_id") * 2000
    return w.select("stream_id", "window_id", start.alias("start_ms"), (start + 5000 + F.length("text") % 3 * 2000).alias("end_ms"), F.substring("text", 1, 12).alias("heading"), F.col("text").alias("content"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcription_windows(spark, sf_dir).select("stream_id", F.col("window_id").alias("segment_id"), (F.col("ts_start") * 1000).cast("long").alias("seg_start_ms"), (F.col("ts_end") * 1000).cast("long").alias("seg_end_ms"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = transcription_windows(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("KEY POINT", "ACTION", "DECISION", "QUESTION", "RISK", "SENTIMENT", "PARTICIPANTS", "NOTES")]), (F.length("text") % 8 + 1).cast("int"))
    return w.select("stream_id", F.floor(F.col("window_id") / 2).alias("window_id"), F.col("window_id").alias("insight_id"), kind.alias("insight_type"), F.col("text").alias("insight_text"), (F.length("text") % 100 / F.lit(100.0)).alias("confidence"), F.when(F.col("window_id") % 3 != 0, F.col("window_id") - 1).alias("continuation_of"), F.when(F.col("window_id") % 6 == 3, F.col("window_id") - 2).alias("correction_of"), F.concat(F.lit("class "), (F.col("window_id") % 4).cast("string")).alias("classification"))


#: Content types in the order that the change table deals them.
CONTENT_TYPES = ("GENERAL_MEETING", "TECHNICAL_TALK", "LECTURE_OR_TALK", "INTERVIEW", "PODCAST", "STREAMER_MONOLOGUE", "NEWS_UPDATE", "GAMEPLAY_COMMENTARY", "CUSTOMER_SUPPORT", "DEBATE", "UNKNOWN")


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in CONTENT_TYPES]), ((F.col("stream_id") + F.col("window_id")) % 11 + 1).cast("int"))
    return transcription_windows(spark, sf_dir).where("window_id % 3 = 0").select("stream_id", F.col("window_id").alias("change_window"), (F.col("ts_start") * 1000).cast("long").alias("start_ms"), kind.alias("content_type"))


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as turns of streams of 100: each leans to the axis of its label, so that labels sound like speakers; some are short, some
    overlapped or onset-contaminated."""
    lean = F.transform("v", lambda x, i: x * 0.6 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    at = F.col("vec_id") * F.lit(1.5)
    long = F.lit(0.2) + (F.col("vec_id") % 10) * F.lit(0.12)
    cols = [lean.alias("v"), at.alias("start"), (at + long).alias("end"), long.alias("duration"), F.col("chunk_id").alias("chunk"), "label"]
    flags = [(F.col("vec_id") % 17 == 5).alias("is_overlap"), (F.col("vec_id") % 13 == 7).alias("is_onset")]
    return vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("stream_id"), F.col("vec_id").alias("turn_id"), *cols, *flags)


#: Plugins of the result table, with the windows that they have results for.
PLUGINS = {"context_summary": 2, "rapid_summary": 1}


def plugin_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, window_id, plugin, formatted, include) of two plugins."""
    w, out = transcription_windows(spark, sf_dir), None
    for name, every in PLUGINS.items():
        line = F.concat(F.lit(f"{name}: "), "text")
        part = w.where(F.col("window_id") % every == 0).select("stream_id", "window_id", F.lit(name).alias("plugin"), line.alias("formatted"), (F.col("window_id") % 5 != 4).alias("include"))
        out = part if out is None else out.unionByName(part)
    return out
