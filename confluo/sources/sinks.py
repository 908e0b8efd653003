"""Events and subtitles out: JSON events, CSV, WebVTT and SRT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.text import cue_time


def events(rows: DataFrame, kind: str) -> DataFrame:
    """(type, payload): one JSON object a row, told apart by its type."""
    return rows.select(F.lit(kind).alias("type"), F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("payload"))


def parse_event(payload: Column, schema: str) -> Column:
    """The event, or null for what isn't JSON."""
    return F.from_json(payload, schema, {"mode": "PERMISSIVE"})


def dispatched(payload: Column, kinds: list[str]) -> Column:
    """Whether an event is of a kind that someone handles."""
    return F.coalesce(F.get_json_object(payload, "$.type").isin(*kinds), F.lit(False))


def csv_line(*cols: str) -> Column:
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cols]
    return F.concat_ws(",", *quoted)


def vtt_cue(n: str, start: str, end: str, text: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit("\n"), cue_time(F.col(start)), F.lit(" --> "), cue_time(F.col(end)), F.lit("\n"), F.col(text))


def srt_text(srt: Column) -> Column:
    lines = F.split(srt, "\n")
    return F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1))), "\n")


def write_events(rows: DataFrame, path: str, form: str = "json") -> None:
    rows.write.mode("append").format(form).save(path)
