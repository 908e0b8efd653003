"""Formatted windows of streams, in one pass or as windows and content types come, in any order.

A window's text is formatted under the content type in force at its start, and against the end of the formatted text of
the window before it. So one late window, or one late change of type, touches all windows from the first that it concerns on,
and none before. ``recompute`` takes a micro-batch of both in, finds each stream's first window whose text or type isn't what was
formatted, formats the stream anew from there, and commits the new rows as the batch's version; ``current`` is each window's
last version. Rows of a stream pass by one after another and only the last formatted text is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from confluo.functions import repetition
from confluo.operators import joins
from confluo.streaming import delivery

#: Fixed value: letters of the formatted text before that a window is formatted against.
TAIL = 1000
#: Streams are dealt to so many folders; a batch reads those of its own streams.
FOLDERS = 16
WINDOWS = "stream_id long, window_id long, text string, ts_start double, ts_end double"
CHANGES = "stream_id long, change_window long, start_ms long, content_type string"
FORMATTED = "stream_id long, window_id long, text string, start_ms long, end_ms long, content_type string, formatted string"
Rule = Callable[[str, str, str], str]


def plain(text: str, content_type: str, tail: str) -> str:
    """Repeats out, and what the window repeats of the end of the one before."""
    return repetition.boundary(tail, repetition.clean_up(text), 120)[1] if tail else repetition.clean_up(text)


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def typed(windows: DataFrame, changes: DataFrame) -> DataFrame:
    """Windows that have text, with the type in force: the last change at or before the start, or the latest known where that is unknown."""
    w = windows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    ms = lambda c: (F.col(c) * 1000).cast("long")
    w = w.select("stream_id", "window_id", "text", ms("ts_start").alias("ms"), ms("ts_end").alias("end_ms"))
    return joins.type_in_force(w, changes, True).withColumnRenamed("ms", "start_ms")


def folded(rows: DataFrame, rule: Rule = plain) -> DataFrame:
    """``rows`` (as FORMATTED, formatted null) in order of window, each formatted against the one before; a row that has its formatted
    text already only hands it on."""
    cols = [c.split()[0] for c in FORMATTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for b in batches:
            keep, out = [], []
            for k, (stream, window, text, _, _, kind, done) in enumerate(zip(*(b.column(c).to_pylist() for c in range(7)))):
                tail = last[-TAIL:] if at == (stream, window - 1) else ""
                last = rule(text.strip(), kind, tail) if done is None else done
                at = (stream, window)
                if done is None:
                    keep.append(k)
                    out.append(last)
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in range(6)), pa.array(out, pa.string())], names=cols)

    dealt = rows.select(*cols).repartition("stream_id").sortWithinPartitions("stream_id", "window_id")
    return dealt.mapInArrow(run, FORMATTED)


def format_windows(windows: DataFrame, changes: DataFrame, rule: Rule = plain) -> DataFrame:
    """All windows at once. Windows without text have no row, and the next one is formatted afresh."""
    return folded(typed(windows, changes).withColumn("formatted", F.lit(None).cast("string")), rule)


def _folder() -> F.Column:
    return F.pmod(F.xxhash64("stream_id"), F.lit(FOLDERS)).cast("int").alias("folder")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The version of the last batch for each key."""
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v"))
    return last.select(*keys, *(F.col(f"v.{c}").alias(c) for c in cols))


def _stored(spark: SparkSession, root: str, name: str, ddl: str, before: int | None, folders: list[int] | None, *keys: str) -> DataFrame:
    rows = delivery.committed(spark, root, name, _schema(ddl + ", folder int"), before)
    rows = rows if folders is None else rows.where(F.col("folder").isin(folders))
    return _last(rows.drop("folder"), *keys)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The formatted windows as of the last committed batch."""
    return _stored(spark, root, "formatted", FORMATTED, None, None, "stream_id", "window_id").where("text is not null")


def recompute(spark: SparkSession, root: str, batch: int, windows: DataFrame | None = None, changes: DataFrame | None = None, rule: Rule = plain) -> None:
    """Take new windows and changes in and format what they concern; a batch of the same number replaces itself.

    A window that comes again replaces the one before, and so does a change of the same window. A null stream or window is left out.
    """
    spark_empty = lambda ddl: spark.createDataFrame([], _schema(ddl))
    new = {"windows": (windows, WINDOWS, ("stream_id", "window_id")), "changes": (changes, CHANGES, ("stream_id", "change_window"))}
    came = {}
    for name, (rows, ddl, keys) in new.items():
        rows = spark_empty(ddl) if rows is None else rows
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in _schema(ddl))).where(" and ".join(f"{k} is not null" for k in keys))
        # One row a key within a batch, whichever copy sorts last.
        rest = [f.name for f in _schema(ddl) if f.name not in keys]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("v")).select(*keys, *(F.col(f"v.{c}").alias(c) for c in rest))
        came[name] = one.select(*[f.name for f in _schema(ddl)], _folder())
        came[name] = spark.read.schema(_schema(ddl + ", folder int")).parquet(delivery.put(came[name], root, name, batch, "folder"))
    touched = came["windows"].select("stream_id", "folder").unionByName(came["changes"].select("stream_id", "folder")).distinct().persist()
    try:
        folders = sorted(r[0] for r in touched.select("folder").distinct().collect())
        streams = touched.select("stream_id")
        have = {}
        for name, (_, ddl, keys) in new.items():
            past = delivery.committed(spark, root, name, _schema(ddl + ", folder int"), batch).where(F.col("folder").isin(folders))
            every = past.unionByName(came[name].withColumn("batch", F.lit(batch).cast("long"))).drop("folder")
            have[name] = _last(every.join(streams, "stream_id", "left_semi"), *keys)
        now = typed(have["windows"], have["changes"])
        done = _stored(spark, root, "formatted", FORMATTED, batch, folders, "stream_id", "window_id").join(streams, "stream_id", "left_semi")
        old = done.select("stream_id", "window_id", "formatted", *(F.col(c).alias(f"was_{c}") for c in ("text", "start_ms", "end_ms", "content_type")))
        both = now.join(old, ["stream_id", "window_id"], "full")
        changed = F.lit(False)
        for c in ("text", "start_ms", "end_ms", "content_type"):
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
        first = F.min(F.when(changed, F.col("window_id"))).over(W.partitionBy("stream_id"))
        marked = both.withColumn("dirty", first).where("dirty is not null")
        # The window before the first dirty one hands its formatted text on; a window that lost its text leaves an empty row.
        needed = marked.where((F.col("window_id") >= F.col("dirty")) | (F.col("window_id") == F.col("dirty") - 1))
        again = F.when(F.col("window_id") >= F.col("dirty"), F.lit(None)).otherwise(F.col("formatted"))
        todo = needed.where("text is not null").select("stream_id", "window_id", "text", "start_ms", "end_ms", "content_type", again.alias("formatted"))
        lost = needed.where("text is null and formatted <> ''").select("stream_id", "window_id", "text", "start_ms", "end_ms", "content_type", F.lit("").alias("formatted"))
        result = folded(todo, rule).unionByName(lost).withColumn("folder", _folder())
        delivery.put(result, root, "formatted", batch, "folder")
        delivery.commit(spark, root, batch)
    finally:
        touched.unpersist()


def each_batch(root: str, rule: Rule = plain) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over one stream of both kinds: rows with a ``change`` are changes of type, the others are windows."""

    def each(rows: DataFrame, batch: int) -> None:
        kept = rows.persist()
        try:
            windows = kept.where("change is null").select("stream_id", "window_id", "text", "ts_start", "ts_end")
            changes = kept.where("change is not null").select("stream_id", F.col("window_id").alias("change_window"), (F.col("ts_start") * 1000).cast("long").alias("start_ms"), F.col("change").alias("content_type"))
            recompute(rows.sparkSession, root, batch, windows, changes, rule)
        finally:
            kept.unpersist()

    return each
