"""Scalar and array functions on text and time, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space; none for an empty text."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def to_ms(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def hms(seconds: Column, always_hours: bool = False) -> Column:
    """HH:MM:SS, or MM:SS under an hour unless ``always_hours``; fractions are cut off."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    full = F.concat_ws(":", F.when(h > 99, h.cast("string")).otherwise(_two(h)), _two(m), _two(s % 60))
    return full if always_hours else F.when(h > 0, full).otherwise(F.concat_ws(":", _two(m), _two(s % 60)))


def clock(ms: Column) -> Column:
    """H:MM:SS of milliseconds, from 0 up."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def cue_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm for subtitle cues."""
    return F.concat(hms(seconds, True), F.lit("."), F.lpad((F.floor(seconds * 1000) % 1000).cast("string"), 3, "0"))


def normal_action(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\A\s+|\s+\z", "")), r"\.+\z", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bare_token(token: Column) -> Column:
    """Lower case without what isn't a letter, digit, underscore or apostrophe at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), r"(?U)^[^\w']+", ""), r"(?U)[^\w']+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1))


#: The CJK blocks that are stripped.
CJK_BLOCKS = (
    "\u2E80-\u2EFF", "\u2F00-\u2FDF", "\u3000-\u303F", "\u3040-\u309F", "\u30A0-\u30FF", "\u3100-\u312F", "\u3130-\u318F",
    "\u3190-\u319F", "\u31A0-\u31BF", "\u31F0-\u31FF", "\u3200-\u32FF", "\u3300-\u33FF", "\u3400-\u4DBF", "\u4E00-\u9FFF",
    "\uA000-\uA48F", "\uA490-\uA4CF", "\uAC00-\uD7AF", "\uF900-\uFAFF", "\uFE30-\uFE4F",
)
#: Phrases that tell a leaked instruction.
LEAK_PHRASES = (
    "professional meeting scribe", "expert editor maintaining", "your task is to produce", "core editing rule",
    "return a json object", "security constraints", "these instructions", "system prompt", "as a language model", "as an ai",
    "i am an ai", "summarisation process", "fast-pass summariser", "heading format", "json response", "output format",
    "key points guidelines", "topics guidelines",
)
#: The time ranges that mark an item without timing, and those that may end a heading.
ZERO_RANGE = r"\[\s*0:00:00\s*[–—-]\s*0:00:00\s*\]"
TRAILING_RANGE = r"\s*\[\d+:\d{2}:\d{2}\s*[–—-]\s*\d+:\d{2}:\d{2}\]\s*$"


def strip_cjk(text: Column) -> Column:
    """Runs of CJK letters become one blank, runs of blanks one, ends are trimmed."""
    cut = F.regexp_replace(text, f"[{''.join(CJK_BLOCKS)}]+", " ")
    return F.regexp_replace(F.regexp_replace(cut, " {2,}", " "), r"\A\s+|\s+\z", "")


def drop_lines_with(text: Column, phrases: tuple[str, ...] = LEAK_PHRASES) -> Column:
    """Lines without any of the phrases, case aside."""
    bad = lambda line: F.exists(F.array(*[F.lit(f) for f in phrases]), lambda f: F.contains(F.lower(line), f))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(line)), "\n")


def drop_zero_timed(items: Column) -> Column:
    return F.filter(items, lambda i: ~i.rlike(ZERO_RANGE))


def strip_trailing_range(heading: Column) -> Column:
    return F.regexp_replace(heading, TRAILING_RANGE, "")


def strip_fence(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def tidy_punctuation(text: Column) -> Column:
    return F.regexp_replace(squeeze(text), r"\s+([,.;:!?])", "$1")


def reference_id(text: Column) -> Column:
    """A positive whole number or null."""
    whole = F.regexp_extract(F.trim(text), r"\A\+?(\d{1,18})(?:\.0*)?\z", 1)
    return F.when(whole != "", F.when(whole.cast("long") > 0, whole.cast("long")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def caps(latest_end_ms: Column) -> tuple[Column, Column]:
    """(key points, topics) allowed for so much media."""
    blocks = F.greatest(F.lit(1), F.ceil(latest_end_ms / 1800000))
    return F.least(10 + 3 * (blocks - 1), F.lit(35)).cast("long"), F.least(8 + 2 * (blocks - 1), F.lit(24)).cast("long")


def phrases_equivalent(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (bare_token(x) == bare_token(y)) & (bare_token(x) != ""))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (clamp(x, -1.0, 1.0) * 32767).cast("smallint"))


def dbfs(mean_square: Column) -> Column:
    """Level of a frame by its mean square; an empty frame (null) is infinitely quiet."""
    return F.coalesce(20 * F.log10(F.greatest(F.sqrt(mean_square), F.lit(1e-12))), F.lit(float("-inf")))


def duration_text(seconds: Column) -> Column:
    """'1 hour 2 minutes 5 seconds': parts of zero are left out, but for a duration of nothing."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    part = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    nothing = (h <= 0) & (m <= 0)
    return F.concat_ws(" ", F.when(h > 0, part(h, "hour")), F.when(m > 0, part(m, "minute")), F.when((r > 0) | nothing, part(r, "second")))


#: Languages that an answer may be asked for in.
LANGUAGES = {
    "en": "English", "zh": "Chinese", "es": "Spanish", "fr": "French", "de": "German", "ja": "Japanese", "ko": "Korean",
    "pt": "Portuguese", "it": "Italian", "ru": "Russian", "ar": "Arabic", "hi": "Hindi", "nl": "Dutch", "pl": "Polish",
    "tr": "Turkish", "vi": "Vietnamese", "th": "Thai", "id": "Indonesian",
}


def language_name(code: Column) -> Column:
    """The language that answers are asked for in; English for an unknown or missing code."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("English"))


#: Names of tools that an answer shouldn't mention.
TOOL_NAMES = (
    "search_notes", "search_content", "get_segment", "get_status", "check_availability", "search_web", "search_fast_summaries",
    "search_transcript", "get_transcript_time_range", "get_stream_info", "get_context_availability", "web_search",
)
_STRIP = r"\A\s+|\s+\z"


def agent_answer(raw: Column) -> tuple[Column, Column]:
    """(response, error) of an agent's raw output: tool calls go, an answer is unwrapped, mentions of tools go, an error is
    taken out."""
    trim = lambda c: F.regexp_replace(c, _STRIP, "")
    tools = rf"(?i)(?:I\s+(?:used|called|invoked|ran)\s+(?:the\s+)?|(?:using|via|through)\s+(?:the\s+)?)(?:{'|'.join(TOOL_NAMES)})(?:\s+tool)?(?:\s+to\b|\s*,)?\s*"
    text = trim(F.regexp_replace(raw, r"(?si)<tool_call>.*?</?tool_call>", ""))
    text = trim(F.regexp_replace(text, r"(?si)<answer>(.*?)</answer>", "$1"))
    text = trim(F.regexp_replace(text, tools, ""))
    has = text.rlike(r"(?si)<error>.*?</error>")
    error = F.when(has, trim(F.regexp_extract(text, r"(?si)<error>(.*?)</error>", 1)))
    return F.when(has, trim(F.regexp_replace(text, r"(?si)<error>.*?</error>", ""))).otherwise(text), error


#: What an error that never succeeds on retry says.
HOPELESS = ("context_length_exceeded", "maximum context length", "too many tokens", "reduce the length")


def is_retryable(message: Column) -> Column:
    return ~F.exists(F.array(*[F.lit(p) for p in HOPELESS]), lambda p: F.contains(F.lower(message), p))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def first_half(text: Column) -> Column:
    """What a retry after a truncated answer keeps of its prior context."""
    return F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def after_truncation(prior: Column, answer: Column, tokens: Column, retry_answer: Column, retry_tokens: Column, most: int) -> Column:
    """(prior, answer) that count: an answer of ``most`` tokens or more is cut off, and asked for again with the first half of the prior
    context; one that fails then (null) or is cut off again is empty. A null prior is empty."""
    context = F.coalesce(prior, F.lit(""))
    again = F.when(retry_tokens < most, F.coalesce(retry_answer, F.lit(""))).otherwise("")
    cut = F.coalesce(tokens >= most, F.lit(False))
    return F.struct(F.when(cut, first_half(context)).otherwise(context).alias("prior"), F.when(cut, again).otherwise(answer).alias("answer"))


def segments_text(segments: Column, field: str = "text") -> Column:
    """The segments' texts in their order, those that are there joined by a blank."""
    return F.array_join(F.filter(F.transform(segments, lambda s: s[field]), lambda t: t != ""), " ")


def insight_line(kind: Column, number: Column, start: Column, end: Column, text: Column, continues: Column, corrects: Column) -> Column:
    """'- **TYPE** [#id] [start - end]: text (CONTINUATION of insight #n)'; a reference of 0 is none."""
    mark = lambda word, n: F.when(n != 0, F.concat(F.lit(f"{word} of insight #"), n.cast("string")))
    marks = F.concat_ws(", ", mark("CONTINUATION", continues), mark("CORRECTION", corrects))
    head = F.concat(F.lit("- **"), kind, F.lit("** [#"), number.cast("string"), F.lit("] ["))
    when = F.concat(hms(start, True), F.lit(" - "), hms(end, True), F.lit("]: "))
    return F.concat(head, when, text, F.when(marks != "", F.concat(F.lit(" ("), marks, F.lit(")"))).otherwise(""))


def section_block(heading: Column, start_ms: Column, end_ms: Column, content: Column) -> Column:
    """A section as markdown: heading without a range of its own, clock range, content."""
    trim = lambda c: F.regexp_replace(c, _STRIP, "")
    named = F.when(F.coalesce(heading, F.lit("")) == "", "Untitled Topic").otherwise(heading)
    title = trim(strip_trailing_range(trim(named)))
    return F.concat(F.lit("## "), title, F.lit(" ["), clock(start_ms), F.lit(" – "), clock(end_ms), F.lit("]\n\n"), trim(F.coalesce(content, F.lit(""))))


def multiset_coverage(source: Column, candidate: Column) -> Column:
    """Share of the candidate's tokens that the source has, each as often as it stands there; 0 without tokens."""
    count = lambda tokens, w: F.size(F.filter(tokens, lambda x: x == w))
    both = F.aggregate(F.array_distinct(candidate), F.lit(0), lambda n, w: n + F.least(count(source, w), count(candidate, w)))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(candidate).cast("double")), F.lit(0.0))
