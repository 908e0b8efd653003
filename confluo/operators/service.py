"""The service's smaller rules over streams: filters, windows, lookups, payloads and documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.functions import repetition
from confluo.functions import text as T
from confluo.operators import vectors
from confluo.operators.context import ordered_text, repeated_words

#: Topics that an insight answer may name, and headings that say nothing.
TOPICS = ("GENERAL", "BUSINESS", "TECHNICAL", "EDUCATION", "NEWS", "ENTERTAINMENT", "SPORTS", "GAMING", "SUPPORT", "OTHER")
PLACEHOLDERS = ("untitled topic", "topic", "section")
#: The least probability of a word, of a language, and the shortest turn in seconds.
SURE_WORD, SURE_LANGUAGE, SHORTEST = 0.60, 0.5, 0.15


def _line():
    return W.partitionBy("stream_id").orderBy("window_id")


def frame_time(stamp: Column, base: Column) -> Column:
    """Seconds of a frame by its time base; the stamp itself where there is none."""
    return F.coalesce(stamp * base, stamp.cast("double"))


def has_speech(segments: Column) -> Column:
    return F.exists(segments, lambda s: F.trim(s["text"]) != "")


def long_enough(seconds: Column) -> Column:
    return seconds >= SHORTEST


def is_degenerate(heading: Column, content: Column) -> Column:
    return F.lower(F.trim(heading)).isin(*PLACEHOLDERS) & (F.trim(content) == "")


def sure_words(words: Column) -> Column:
    return F.filter(words, lambda w: w["probability"] >= SURE_WORD)


def confident_text(text: Column, confidence: Column) -> Column:
    return F.when(confidence < SURE_LANGUAGE, "").otherwise(text)


def long_items(items: Column) -> Column:
    return F.filter(items, lambda i: F.length(i) > 1)


def without_regressions(rows: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Detections but unknown ones after a known one of the stream."""
    known = F.max((F.col("content_type") != unknown).cast("int")).over(_line().rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__k", known).where((F.col("content_type") != unknown) | (F.coalesce("__k", F.lit(0)) == 0)).drop("__k")


def language_changes(rows: DataFrame) -> DataFrame:
    """Rows whose language differs from the last one detected before; null is no detection."""
    known = rows.where("lang is not null").withColumn("__p", F.lag("lang").over(_line()))
    return known.where(F.col("__p").isNull() | (F.col("__p") != F.col("lang"))).drop("__p")


def tumbling(frames: DataFrame, seconds: int) -> DataFrame:
    """(stream_id, win, n, total, partial): windows side by side; the last of a stream may be partial."""
    w = frames.groupBy("stream_id", F.floor(F.col("media_s") / seconds).alias("win")).agg(F.count("*").alias("n"), F.sum("sample").alias("total"))
    return w.withColumn("partial", F.max("win").over(W.partitionBy("stream_id")) == F.col("win"))


def sliding(frames: DataFrame, stride: float, length: float) -> DataFrame:
    """(stream_id, start, n): a frame is in each window [k * stride, k * stride + length) that holds it."""
    last = F.floor(F.col("media_s") / stride)
    first = F.greatest(F.lit(0), F.floor((F.col("media_s") - length) / stride) + 1)
    w = frames.withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return w.groupBy("stream_id", (F.col("k") * F.lit(stride)).alias("start")).agg(F.count("*").alias("n"))


def event_batches(events: DataFrame, n: int) -> DataFrame:
    """(stream_id, batch, ts_start, ts_end, n): every n events at once; a shorter rest waits."""
    b = events.withColumn("batch", F.floor((F.row_number().over(_line()) - 1) / n))
    return b.groupBy("stream_id", "batch").agg(F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"), F.count("*").alias("n")).where(F.col("n") == n)


def markdown(sections: DataFrame, actions: list[str], follow_ups: list[str]) -> DataFrame:
    """(stream_id, document): check boxes, a rule, then the sections by time."""
    boxes = [f"## {name}\n\n" + "\n".join(f"- [ ] {x}" for x in items) for name, items in (("Actions", actions), ("Follow Ups", follow_ups)) if items]
    block = T.section_block(F.col("heading"), F.col("start_ms"), F.col("end_ms"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", block.alias("block"))))
    parts = F.concat(F.array(*[F.lit(x) for x in [*boxes, *(["---"] if boxes else [])]]).cast("array<string>"), F.transform(rows, lambda r: r["block"]))
    return sections.groupBy("stream_id").agg(F.array_join(parts, "\n\n").alias("document"))


def speaker_statistics(vecs: DataFrame, decision: Column, confidence: Column, valid: Column, last: int = 20) -> DataFrame:
    """One row: speakers, samples, samples a speaker, the mean confidence of the matches among the last decisions (1 for none), and
    the share of valid vectors."""
    per = vecs.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("speakers"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    rate = vecs.agg((F.count_if(valid) / F.greatest(F.lit(1), F.count("*"))).alias("valid"))
    recent = vecs.select("vec_id", decision.alias("decision"), confidence.alias("c")).orderBy(F.desc("vec_id")).limit(last).where("decision = 'match'")
    mean = recent.agg(F.round(F.coalesce(F.avg("c"), F.lit(1.0)), 6).alias("confidence"))
    share = F.round(F.col("samples") / F.greatest(F.lit(1), "speakers").cast("double"), 6).alias("mean")
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - three single rows
    return one(per).join(one(mean), "one").join(one(rate), "one").select("speakers", "samples", share, "confidence", F.round("valid", 6).alias("valid"))


def timestamp_dedup(w: DataFrame, word_ms: int) -> DataFrame:
    """(stream_id, window_id, text, path): a window's text without what the one before it had already.

    The first window of a stream stays whole. Words with times (``timed``; ``word_ms`` apart from the window's start on) go if they began
    before the last window's end; words without go by the mirrored rule against the kept text of the last window. The kept
    text goes from window to window, so a stream's rows pass by in order, and only the last kept text is held.
    """
    names = ["stream_id", "window_id", "text", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, before, prev = None, [], None
        for b in batches:
            texts, paths = [], []
            for s, start, end, timed, words in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                path = "first" if s != stream else "timestamps" if timed else "words"
                if path == "timestamps":
                    words = [x for i, x in enumerate(words) if int(start * 1000 + i * word_ms) / 1000.0 >= prev]
                elif path == "words":
                    words = words[repeated_words(before, words) :]
                stream, before, prev = s, words, end
                texts.append(" ".join(words))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=names)

    rows = w.select("stream_id", "window_id", "ts_start", "ts_end", "timed", T.words(F.coalesce("text", F.lit(""))).alias("words"))
    dealt = rows.repartition("stream_id").sortWithinPartitions("stream_id", "window_id")
    return dealt.mapInArrow(run, "stream_id long, window_id long, text string, path string")


def lookup(wanted: DataFrame, w: DataFrame) -> DataFrame:
    """Windows by id; a missing one has an empty text and starts at 0."""
    found = w.select("stream_id", F.col("window_id").alias("wanted"), "text", "ts_start")
    j = wanted.join(found, ["stream_id", "wanted"], "left")
    return j.select("stream_id", "summary_id", "wanted", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ts_start", F.lit(0.0)).alias("ts_start"))


def latest_insights(insights: DataFrame, window: int) -> DataFrame:
    """(stream_id, latest, prior, per_window): the result of the asked window, or of the newest that has one (every second has); the
    insights of all windows but the last, and their number a window before it."""
    even = insights.where("window_id % 2 = 0").groupBy("stream_id", "window_id").agg(ordered_text("insight_text", "insight_id", sep=" / ").alias("said"))
    newest = even.groupBy("stream_id").agg(F.max_by("said", F.struct((F.col("window_id") == window).alias("asked"), "window_id")).alias("latest"))
    last = W.partitionBy("stream_id")
    marked = insights.withColumn("__last", F.max("window_id").over(last))
    n = marked.groupBy("stream_id").agg(F.count_if(F.col("window_id") < F.col("__last")).alias("prior"), F.count_distinct("window_id").alias("windows"))
    rate = F.round(F.coalesce(F.try_divide(F.col("prior").cast("double"), (F.col("windows") - 1).cast("double")), F.lit(0.0)), 6)
    return n.join(newest, "stream_id", "left").select("stream_id", "latest", "prior", rate.alias("per_window"))


def stored_results(results: DataFrame, most: int) -> DataFrame:
    """(stream_id, plugin, window_id, stored): the last result of a plugin that isn't too large, as JSON; the last write wins."""
    fits = results.where((F.col("plugin") != "") & (F.length("formatted") <= most))
    json = F.to_json(F.struct(F.col("formatted").alias("text"), "include"))
    return fits.groupBy("stream_id", "plugin").agg(F.max("window_id").alias("window_id"), F.max_by(json, "window_id").alias("stored"))


def unprocessed(w: DataFrame) -> DataFrame:
    """(stream_id, unprocessed, everything, pending) from windows with the flag ``processed``."""
    open_ = F.when(~F.col("processed"), F.col("text")).otherwise("")
    g = w.withColumn("open", open_).groupBy("stream_id")
    return g.agg(ordered_text("open", "window_id").alias("unprocessed"), ordered_text("text", "window_id").alias("everything"), F.count_if(~F.col("processed")).alias("pending"))


def viewer_cues(w: DataFrame, last: int) -> DataFrame:
    """(stream_id, cues, total, duration, in_order): the last cues, newest first; the duration is the last cue's end."""
    ranked = w.withColumn("rn", F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc("window_id"))))
    rows = F.array_sort(F.collect_list(F.when(F.col("rn") <= last, F.struct("rn", "text"))))  # no more than the cues shown
    cues = F.array_join(F.transform(rows, lambda r: r["text"]), " | ")
    end = F.max_by("ts_end", "window_id")
    return ranked.groupBy("stream_id").agg(cues.alias("cues"), F.count("*").alias("total"), end.alias("duration"), (F.max("ts_end") == end).alias("in_order"))


def segments_payload(w: DataFrame) -> DataFrame:
    """(stream_id, window_id, segment): one segment a window in stream time, with an id from time and text, and its words."""
    ms = lambda s: (s * 1000).cast("long")
    words = F.transform(T.words(F.col("text")), lambda x, i: F.struct((ms(F.col("ts_start")) + i * 100).alias("start_ms"), (ms(F.col("ts_start")) + i * 100 + 100).alias("end_ms"), x.alias("text")))
    number = F.lower(F.lpad(F.hex(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    name = F.concat(ms(F.col("ts_start")).cast("string"), F.lit("-"), number)
    fields = [name.alias("id"), ms(F.col("ts_start")).alias("start_ms"), ms(F.col("ts_end")).alias("end_ms"), "text", words.alias("words"), "speaker"]
    return w.select("stream_id", "window_id", F.struct(*fields).alias("segment"))


def speakers_payload(w: DataFrame) -> DataFrame:
    """(stream_id, turns): consecutive turns as 'speaker:start-end' in ms, in order."""
    ms = lambda c: (F.col(c) * 1000).cast("long").cast("string")
    turn = F.concat("speaker", F.lit(":"), ms("ts_start"), F.lit("-"), ms("ts_end"))
    return w.withColumn("turn", turn).groupBy("stream_id").agg(ordered_text("turn", "window_id", sep=",").alias("turns"))


def styles(changes: DataFrame) -> DataFrame:
    """(stream_id, styles): content types by first appearance."""
    rows = F.array_sort(F.collect_list(F.struct("change_window", "content_type")))
    return changes.groupBy("stream_id").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["content_type"])), ",").alias("styles"))


def token_sums(w: DataFrame) -> DataFrame:
    return w.groupBy("stream_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def pending(started: DataFrame, finished: DataFrame) -> DataFrame:
    """(stream_id, pending): windows begun but not finished."""
    events = started.select("stream_id", F.lit(1).alias("e")).unionByName(finished.select("stream_id", F.lit(-1).alias("e")))
    return events.groupBy("stream_id").agg(F.sum("e").alias("pending"))


def availability_flags(streams: DataFrame, w: DataFrame, minimal: int) -> DataFrame:
    """(stream_id, chars, is_empty, is_minimal), streams without windows too."""
    g = w.groupBy("stream_id").agg(F.sum(F.length("text")).alias("chars"))
    chars = F.coalesce("chars", F.lit(0))
    return streams.join(g, "stream_id", "left").select("stream_id", chars.alias("chars"), F.col("chars").isNull().alias("is_empty"), (chars < minimal).alias("is_minimal"))


def parsed_context(raw: Column) -> Column:
    """(topic, insights, error) of an answer: an object must name a topic, an unknown one is GENERAL; a list is insights alone; what
    isn't whole JSON is an error without insights."""
    variant = F.try_parse_json(raw)
    shape = F.schema_of_variant(variant)
    items = "array<struct<insight_text: string>>"
    no = F.array().cast(items)
    obj = F.from_json(raw, f"topic string, insights {items}")
    topic = F.when(obj["topic"].isin(*TOPICS), obj["topic"]).when(obj["topic"].isNotNull(), "GENERAL")
    is_list, is_object = shape.startswith("ARRAY"), shape.startswith("OBJECT")
    error = F.when(variant.isNull(), "json").when(is_object & obj["topic"].isNull(), "topic is missing")
    insights = F.when(is_list, F.coalesce(F.from_json(raw, items), no)).when(is_object & obj["topic"].isNotNull(), F.coalesce(obj["insights"], no)).otherwise(no)
    return F.struct(F.when(is_object, topic).alias("topic"), insights.alias("insights"), error.alias("error"))


def parsed_content_type(raw: Column, types: tuple[str, ...], unknown: str = "UNKNOWN") -> Column:
    """The content type of an answer; unknown where it isn't one object or names none of the types."""
    text = F.trim(raw)
    named = F.get_json_object(F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), text), "$.content_type")
    return F.when(named.isin(*types), named).otherwise(unknown)


def document(rows: list[tuple]) -> tuple[str, list[str]]:
    """(document, styles) of (start_ms, end_ms, text, content type) rows: texts without what they repeat at boundaries, each with
    its end time; a text before gives way where the rule cuts it."""
    blocks, styles_, last, ends = ["[0:00:00]"], [], "", None
    clock = lambda ms: f"{max(0, ms) // 3600000}:{max(0, ms) // 60000 % 60:02d}:{max(0, ms) // 1000 % 60:02d}"
    for _, end, text, kind in rows:
        text = (text or "").strip()
        if text and last:
            before, text, _ = repetition.boundary(last, text, 120)
            if before != last:
                blocks[-1] = f"{before}\n\n[{clock(ends)}]"
        if text:
            last = text
            blocks.append(f"{text}\n\n[{clock(end)}]")
        if kind not in styles_:
            styles_.append(kind)
        ends = end
    return "\n\n".join(blocks).strip(), styles_


def rendered(w: DataFrame) -> DataFrame:
    """(stream_id, document, styles, windows) from formatted windows, one task a stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_start", "window_id"])
        rows = [(int(r.ts_start * 1000), int(r.ts_end * 1000), r.text, r.content_type) for r in pdf.itertuples()]
        text, used = document(rows)
        return pd.DataFrame([(pdf["stream_id"].iloc[0], text, ",".join(used), len(pdf))], columns=["stream_id", "document", "styles", "windows"])

    return w.groupBy("stream_id").applyInPandas(run, "stream_id long, document string, styles string, windows long")


def latest(events: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """The last ``most`` events of each key: what a bounded buffer still holds."""
    line = W.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("__r", F.row_number().over(line)).where(F.col("__r") <= most).drop("__r")


def transcript_range(w: DataFrame, start: float, end: float, now: DataFrame) -> DataFrame:
    """(stream_id, answer): what a stream said in a stretch of time, each window under its times; ``now`` (stream_id, position) tells
    where the stream stands, which the answer notes if the stretch goes beyond."""
    s, e = T.hms(F.lit(start)), T.hms(F.lit(end))
    label = F.concat(F.lit("["), T.hms(F.col("ts_start")), F.lit(" – "), T.hms(F.col("ts_end")), F.lit("]\n"), "text")
    inside = w.where((F.col("ts_start") < end) & (F.col("ts_end") > start)).withColumn("line", label)
    g = inside.groupBy("stream_id").agg(ordered_text("line", "ts_start", "window_id", sep="\n").alias("lines"), F.count("*").alias("n"))
    beyond = (F.lit(end) > F.col("position")) & (F.col("position") > 0)
    note = F.when(beyond, F.concat(F.lit(" (stream is at "), T.hms(F.col("position")), F.lit(")"))).otherwise("")
    some = F.concat(F.lit("[Transcript "), s, F.lit(" to "), e, F.lit(" — "), F.col("n").cast("string"), F.lit(" window(s)"), note, F.lit("]\n\n"), "lines")
    none = F.concat(F.lit("No transcript between "), s, F.lit(" and "), e, F.lit("."), note)
    return now.join(g, "stream_id", "left").select("stream_id", F.coalesce(some, none).alias("answer"))


def stream_status(streams: DataFrame, w: DataFrame, summaries: DataFrame) -> DataFrame:
    """(stream_id, answer): where each of ``streams`` stands, how many windows it has, how long they are in all and on average, and how
    many summary windows there are; a stream at 0 or without windows hasn't started."""
    g = w.groupBy("stream_id").agg(F.max("ts_end").alias("at"), F.count("*").alias("n"), F.sum(F.col("ts_end") - F.col("ts_start")).alias("long"))
    all_ = streams.select("stream_id").join(g, "stream_id", "left").join(summaries.groupBy("stream_id").agg(F.count("*").alias("notes")), "stream_id", "left")
    line = lambda name, x: F.concat(F.lit(f"{name:<24}: "), x)
    lines = [line("Current stream position", T.hms(F.col("at"))), line("Total indexed chunks", F.col("n").cast("string")), line("Total indexed duration", T.hms(F.col("long"))), line("Average chunk duration", T.hms(F.col("long") / F.col("n")))]
    text = F.concat_ws("\n", *lines, line("Fast summary chunks", F.coalesce("notes", F.lit(0)).cast("string")))
    none = "Stream has not started or no transcript content has been indexed yet."
    return all_.select("stream_id", F.when(F.col("at") > 0, text).otherwise(none).alias("answer"))


def availability_text(streams: DataFrame, available: DataFrame) -> DataFrame:
    """(stream_id, answer): how long a stretch of each of ``streams`` can be asked about, with its ends, from ``availability``'s rows."""
    first, last = F.col("first_start"), F.col("last_end")
    span = F.concat(T.duration_text(last - first), F.lit(" ("), T.hms(first), F.lit(" to "), T.hms(last), F.lit(")"), F.when(F.col("is_minimal"), " - stream recently started").otherwise(""))
    return streams.select("stream_id").join(available, "stream_id", "left").select("stream_id", F.when(first.isNotNull(), span).otherwise("No summary content available yet.").alias("answer"))


def diagnostics(turns: DataFrame, config: dict, sure: float = 0.65, last: int = 20, history: int = 50) -> DataFrame:
    """One row a stream of ``online_speakers``: speakers and samples at the end, samples a speaker, turns of nobody, speakers that were
    merged into others, the share of known turns that aren't sure, the mean confidence of the last known turns (1 for none), the
    distribution of all confidences, the latest turns as speakers in order, and the settings."""
    known = F.col("speaker") >= 0
    line = W.partitionBy("stream_id").orderBy(F.desc("turn_id"))
    t = turns.withColumn("__at", F.sum(known.cast("int")).over(line))  # the turn is the so-manieth known one from the end
    heard = F.count_if(known)
    shown = F.transform(F.array_sort(F.collect_list(F.when(known & (F.col("__at") <= history), F.struct("turn_id", "speaker")))), lambda r: r["speaker"])
    speakers = F.count_distinct(F.when(F.col("final") >= 0, F.col("final")))
    recent = F.avg(F.when(known & (F.col("__at") <= last), F.col("confidence")))
    n = [speakers.alias("speakers"), F.count("*").alias("turns"), heard.alias("samples"), (heard / F.greatest(F.lit(1), speakers)).alias("mean_samples"), F.count_if(~known).alias("unknown")]
    merged = F.count_distinct(F.when(F.col("speaker") != F.col("final"), F.col("speaker"))).alias("merged")
    unsure = (F.count_if(known & (F.col("confidence") < sure)) / F.greatest(F.lit(1), heard)).alias("low_confidence_rate")
    one = t.groupBy("stream_id").agg(*n, merged, unsure, F.coalesce(recent, F.lit(1.0)).alias("confidence"), shown.alias("timeline"))
    spread = vectors.score_distribution(turns.where(known), "stream_id", "confidence")
    names = [c for c in spread.columns if c != "stream_id"]
    both = one.join(spread.select("stream_id", F.struct(*names).alias("scores")), "stream_id", "left")
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    return both.withColumn("config", settings)


def formatted(results: DataFrame, callbacks: dict[str, Column]) -> DataFrame:
    """``results`` with ``line``: a plugin's own format, null where that fails; JSON for a plugin without one; null for no result."""
    json = F.to_json(F.struct("formatted"))
    own = None
    for plugin, expression in callbacks.items():
        own = F.when(F.col("plugin") == plugin, expression) if own is None else own.when(F.col("plugin") == plugin, expression)
    line = json if own is None else F.when(F.col("plugin").isin(list(callbacks)), own).otherwise(json)
    return results.withColumn("line", F.when(F.coalesce("formatted", F.lit("")) != "", line))


def prompt(parts: dict[str, Column]) -> Column:
    """The parts that aren't empty, each under its heading, in the given order."""
    blocks = [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), text)) for name, text in parts.items()]
    return F.concat_ws("\n\n", *blocks)


def health_alerts(requests: DataFrame, least: float) -> DataFrame:
    """(stream_id, payload): the monitoring channel's events, one a stream whose share of successes in per cent is under ``least``."""
    g = requests.groupBy("stream_id").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
    low = g.where(100 * F.col("ok") < least * F.col("total"))
    return low.select("stream_id", F.to_json(F.struct(F.lit("monitoring").alias("type"), "stream_id", "total", "ok")).alias("payload"))


def mono(samples: Column, channels: int) -> Column:
    """The mean of the channels of interleaved samples."""
    n = F.floor(F.size(samples) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: F.aggregate(F.slice(samples, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda s, x: s + x) / channels)
