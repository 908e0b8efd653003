"""Windows of windows and bounded contexts. Every frame is keyed by stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.operators import scan


def ordered_text(text: str, *order: str, sep: str = " ") -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return F.array_join(F.filter(F.transform(rows, lambda r: r["__t"]), lambda t: t != ""), sep)


def count_windows(w: DataFrame, n: int) -> DataFrame:
    """Every n windows of a stream as one; a shorter rest waits. The end is that of the last-starting window."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    g = w.withColumn("summary_id", F.floor((F.row_number().over(line) - 1) / n))
    out = g.groupBy("stream_id", "summary_id").agg(F.count("*").alias("n_windows"), ordered_text("text", "ts_start", "window_id").alias("text"), F.min("ts_start").alias("ts_start"), F.max_by("ts_end", F.struct("ts_start", "window_id")).alias("ts_end"))
    return out.where(F.col("n_windows") == n).withColumn("char_count", F.length("text").cast("long"))


def retain(w: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """The latest windows whose characters fit the limit, and the newest one in any case; ``parts`` as in scan.py."""
    kept = scan.running_sum(w, "stream_id", [F.desc("summary_id")], F.col("char_count"), "__sum", parts)
    newest = w.groupBy("stream_id").agg(F.max("summary_id").alias("__newest"))
    return kept.join(newest, "stream_id").where((F.col("__sum") <= limit) | (F.col("summary_id") == F.col("__newest"))).drop("__sum", "__newest")


def availability(w: DataFrame, minimal: int = 500) -> DataFrame:
    return w.groupBy("stream_id").agg(F.min("ts_start").alias("first_start"), F.max_by("ts_end", "summary_id").alias("last_end"), F.sum("char_count").alias("chars"), F.count("*").alias("windows")).withColumn("is_minimal", F.col("chars") < minimal)


def recent(w: DataFrame, chars: int, parts: int | None = None) -> DataFrame:
    """Newest first until so many characters are there, the window that crosses the limit included; ``parts`` as in scan.py."""
    before = scan.running_sum(w, "stream_id", [F.desc("window_id")], F.length("text"), "__b", parts, itself=False)
    return before.where(F.col("__b") < chars).drop("__b")


def budget_fold(items: DataFrame, keys: list[str], order: str, cost: Column, tokens: Column | int) -> DataFrame:
    """(keys, used, taken, first_miss): newest to oldest by ``order``, an item is taken if its cost still fits; a fold, as a missed
    item doesn't end it. ``tokens``: 0 takes all, less than 0 nothing; ``first_miss`` is the order of the first one that didn't fit."""
    limit = tokens if isinstance(tokens, Column) else F.lit(tokens)
    rows = F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("neg"), cost.cast("long").alias("cost"))))
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("taken"), F.lit(None).cast("long").alias("miss"))
    g = items.groupBy(*keys).agg(rows.alias("rows"), F.max(limit).alias("limit"))

    def step(s: Column, r: Column) -> Column:
        take = F.struct((s["used"] + r["cost"]).alias("used"), F.concat(s["taken"], F.array(-r["neg"])).alias("taken"), s["miss"].alias("miss"))
        miss = F.struct(s["used"].alias("used"), s["taken"].alias("taken"), F.coalesce(s["miss"], -r["neg"]).alias("miss"))
        limit = F.col("limit")
        return F.when(limit < 0, s).when((limit == 0) | limit.isNull() | (s["used"] + r["cost"] <= limit), take).otherwise(miss)

    s = F.aggregate("rows", start, step)
    return g.select(*keys, s.alias("s")).select(*keys, F.col("s.used").alias("used"), F.col("s.taken").alias("taken"), F.col("s.miss").alias("first_miss"))


def text_and_results(w: DataFrame, results: DataFrame, text_tokens: int, plugins: dict[str, int | None]) -> DataFrame:
    """(stream_id, text, text_tokens, results, per_window): the text and the plugins' results that fit their budgets.

    ``w`` (stream_id, window_id, text), ``results`` (stream_id, window_id, plugin, formatted, include). Text comes oldest first, each
    plugin's results newest first. A budget of None is none, one of 0 for a plugin takes what costs nothing. Once the text and
    every plugin have missed an item, nothing older is taken. ``per_window`` is a plugin's number of results over the
    number of windows.
    """
    asked = results.where(F.col("plugin").isin(list(plugins)) & F.coalesce("include", F.lit(True)) & (F.col("formatted") != ""))
    # A plugin's limit of 0 isn't "no limit": it becomes a limit that only free items meet.
    limits = F.create_map(*[x for p, n in plugins.items() for x in (F.lit(p), F.lit(n).cast("double"))]) if plugins else None
    own = F.try_element_at(limits, F.col("plugin")) if plugins else F.lit(None).cast("double")
    own = F.when(own == 0, 0.5).otherwise(own)
    texts = budget_fold(w, ["stream_id"], "window_id", F.floor(F.length("text") / 4), text_tokens)
    folded = budget_fold(asked, ["stream_id", "plugin"], "window_id", F.floor(F.length("formatted") / 4), own)
    missed = folded.where("first_miss is not null").groupBy("stream_id").agg(F.count("*").alias("n"), F.min("first_miss").alias("at"))
    all_missed = F.col("first_miss").isNotNull() & (F.coalesce("n", F.lit(0)) == len(plugins))
    stop = F.when(all_missed, F.least("first_miss", F.coalesce("at", "first_miss")))
    stops = texts.join(missed, "stream_id", "left").select("stream_id", "used", "taken", stop.alias("stop"))
    kept = lambda ids: F.filter(ids, lambda i: F.col("stop").isNull() | (i >= F.col("stop")))
    mine = stops.select("stream_id", F.explode(kept(F.col("taken"))).alias("window_id")).join(w, ["stream_id", "window_id"])
    text = mine.groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "text"))), lambda r: r["text"]), "\n").alias("text"),
        F.sum(F.floor(F.length("text") / 4)).alias("text_tokens"),
    )
    taken = folded.join(stops.select("stream_id", "stop"), "stream_id").select("stream_id", "plugin", F.explode(kept(F.col("taken"))).alias("window_id"))
    lines = taken.join(asked, ["stream_id", "plugin", "window_id"])
    newest = F.array_sort(F.collect_list(F.struct((-F.col("window_id")).alias("neg"), "formatted")))
    per = lines.groupBy("stream_id", "plugin").agg(F.transform(newest, lambda r: r["formatted"]).alias("list"))
    joined = F.array_sort(F.collect_list(F.struct("plugin", "list"))).alias("results")
    out = w.groupBy("stream_id").agg(F.count("*").alias("windows")).join(text, "stream_id", "left").join(per.groupBy("stream_id").agg(joined), "stream_id", "left")
    ratio = F.transform("results", lambda r: F.struct(r["plugin"].alias("plugin"), (F.size(r["list"]) / F.col("windows").cast("double")).alias("ratio")))
    return out.select("stream_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text_tokens", F.lit(0)).cast("long").alias("text_tokens"), "results", ratio.alias("per_window"))


def context_string(text: Column, results: Column) -> Column:
    """Prior text and the plugins' results under their headings, whichever there are."""
    prior = F.when(text != "", F.concat(F.lit("## PRIOR TEXT\n"), text))
    every = F.flatten(F.transform(results, lambda r: r["list"]))
    other = F.when(F.size(every) > 0, F.concat(F.lit("## OTHER PLUGIN RESULTS\n"), F.array_join(every, "\n\n---\n\n")))
    return F.concat_ws("\n\n", prior, other)


def every_nth(w: DataFrame, n: int, delay: float = 0.0) -> DataFrame:
    """Each n-th window of a stream among those that begin ``delay`` seconds or more after its first."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    late = w.withColumn("__f", F.min("ts_start").over(W.partitionBy("stream_id"))).where(F.col("ts_start") - F.col("__f") >= delay).drop("__f")
    return late.withColumn("__n", F.row_number().over(line)).where(F.col("__n") % n == 0).drop("__n")


def detection_ranges(w: DataFrame, n: int) -> DataFrame:
    """Of every n-th window: from the window after the last one looked at (or n - 1 back) up to it."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    picked = every_nth(w, n)
    return picked.select("stream_id", "window_id", F.coalesce(F.lag("window_id").over(line) + 1, F.greatest(F.lit(0), F.col("window_id") - n + 1)).alias("from_id"))


def sliding_sections(s: DataFrame, keep_ms: int) -> DataFrame:
    """Sections that end in the last ``keep_ms`` of the stream; the most recent one always."""
    key = W.partitionBy("stream_id")
    latest = F.row_number().over(key.orderBy(F.desc("end_ms"), F.desc("start_ms")))
    return s.withColumn("__l", F.max("end_ms").over(key)).withColumn("__r", latest).where((F.col("end_ms") >= F.col("__l") - keep_ms) | (F.col("__r") == 1)).drop("__l", "__r")


def since(w: DataFrame, t: float, by_end: bool) -> DataFrame:
    return w.where(F.col("ts_end" if by_end else "ts_start") >= t)


def between(w: DataFrame, start: float, end: float) -> DataFrame:
    """Windows that overlap the open interval."""
    return w.where((F.col("ts_start") < end) & (F.col("ts_end") > start))


def repeated_words(before: list[str], words: list[str]) -> int:
    """Words by the mirrored rule: the i-th last word before against the i-th word after, as long as they are equal."""
    n = 0
    while n < min(len(before), len(words)) and before[-n - 1].lower() == words[n].lower():
        n += 1
    return n


def word_overlap(w: DataFrame) -> DataFrame:
    """(stream_id, window_id, removed): words of a window that repeat the kept text of the one before it.

    The kept text of one window is the 'before' of the next, so a stream is folded in order; its rows pass by one after
    another, and only the last kept text is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, before = None, []
        for b in batches:
            removed = []
            for s, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                words = (text or "").split()
                if s != stream:
                    stream, before = s, []
                n = repeated_words(before, words)
                removed.append(n)
                before = words[n:]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64())], names=["stream_id", "window_id", "removed"])

    rows = w.select("stream_id", "window_id", "text").repartition("stream_id").sortWithinPartitions("stream_id", "window_id")
    return rows.mapInArrow(run, "stream_id long, window_id long, removed long")
