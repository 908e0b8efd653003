"""Text rules with index jumps, as Arrow UDFs: repeated phrases, sequence similarity, chunks."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F


def _bare(token: str) -> str:
    return re.sub(r"[^\w']+$", "", re.sub(r"^[^\w']+", "", token.lower()))


def collapse_repeats(text: str, most: int = 6) -> str:
    """Where a phrase of up to ``most`` words stands twice in a row its second copy stays; longest phrases first, one pass."""
    tokens, out, i = text.split(), [], 0
    bare = [_bare(t) for t in tokens]
    while i < len(tokens):
        size = next((k for k in range(min(most, (len(tokens) - i) // 2), 0, -1) if all(bare[i : i + k]) and bare[i : i + k] == bare[i + k : i + 2 * k]), 0)
        out += tokens[i + size : i + 2 * size] if size else [tokens[i]]
        i += 2 * size or 1
    return " ".join(out)


def collapse_between_markers(text: str, most: int = 6) -> str:
    """The same, with [..] markers kept in place and never crossed."""
    parts = re.split(r"(\[[^\]]+\])", text)
    return " ".join(p for p in (x if i % 2 else collapse_repeats(x, most) for i, x in enumerate(parts)) if p)


def split_chunks(text: str, budget: int = 500, carry: int = 500) -> list[str]:
    """Sentences packed into chunks of up to max(2000, 4 * budget) characters.

    A chunk that a sentence opens after a full one begins with the end of that one, which counts; a sentence too long for a
    chunk is cut into pieces of its own, without such a beginning, and the next chunk starts afresh.
    """
    most, text = max(2000, 4 * budget), " ".join(text.split())
    if len(text) <= most:
        return [text] if text else []
    chunks, now, held = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(s) > most:
            chunks += [" ".join(now)] if now else []
            chunks += [s[i : i + most].strip() for i in range(0, len(s), most)]
            now, held = [], 0
        elif held + len(s) + 1 <= most:
            now.append(s)
            held += len(s) + 1
        else:
            chunks.append(" ".join(now))
            now = [x for x in (chunks[-1][len(chunks[-1]) - min(carry, len(chunks[-1])) :].strip(), s) if x]
            held = sum(len(x) + 1 for x in now)
    return [c for c in [*chunks, " ".join(now)] if c]


def boundary(before: str, after: str, most: int = 80) -> tuple[str, str, int]:
    """(before, after, case) with what the two texts repeat at their boundary taken out; case 0 is none.

    1: the longest end of ``before`` that begins ``after`` goes from ``after``; one or two words count from a mean length of 3 on.
    2: a cut last word that begins the first word of ``after`` goes. 3: so does a cut last word whose whole stands after a
    repeated context; the context goes on both sides, so its words are lost, as the rule has it.
    """
    before, after = before.strip(), after.strip()
    p, c = before.split(), after.split()
    if not p or not c:
        return before, after, 0
    bp, bc = [_bare(t) for t in p[-most - 1 :]], [_bare(t) for t in c[: most + 1]]
    same = lambda a, b: a == b and all(a)
    for n in range(min(most, len(p), len(c)), 0, -1):
        if same(bp[-n:], bc[:n]) and (n > 2 or sum(map(len, bp[-n:])) >= 3 * n):
            return before, " ".join(c[n:]), 1
    cut = bp[-1]
    if len(cut) >= 2 and bc[0] != cut and bc[0].startswith(cut):
        return " ".join(p[:-1]), after, 2
    for k in range(1, min(most, len(p) - 1, len(c) - 1) + 1) if len(cut) >= 3 else ():
        if bc[k] != cut and bc[k].startswith(cut) and same(bp[-k - 1 : -1], bc[:k]):
            return " ".join(p[: -k - 1]), " ".join(c[k:]), 3
    return before, after, 0


def clean_up(text: str) -> str:
    """Repeats out, white space to single blanks, none before punctuation."""
    return re.sub(r"\s+([,.;:!?])", r"\1", " ".join(collapse_between_markers(text).split()))


#: What a rewritten text must share with its source, and its length over the source's.
COVERAGE, SIMILARITY, SHORTEST, LONGEST = 0.82, 0.55, 0.75, 1.30


def accepted(source: str, candidate: str) -> bool:
    """Whether a rewritten text stays close enough to its source."""
    words = lambda t: re.findall(r"[a-z0-9']+", t.lower())
    a, b = Counter(words(source)), Counter(words(candidate))
    total = sum(b.values())
    x, y = " ".join(source.split()), " ".join(candidate.split())
    if not total or not x or not y:
        return bool(y) and not x
    close = sum((a & b).values()) / total >= COVERAGE and SHORTEST <= len(y) / len(x) <= LONGEST
    return close and difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() >= SIMILARITY


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    norm = lambda t: " ".join((t or "").lower().split())
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.map(norm), b.map(norm))])


# UDFs are made on call: a worker that imports this module has no session to parse their types with.
def repeats_collapsed():
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: collapse_between_markers(t or ""))

    return F.pandas_udf(run, "string")


def chunks_of():
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_chunks(t or ""))

    return F.pandas_udf(run, "array<string>")


def boundaries(most: int):
    def run(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        got = [boundary(a or "", b or "", most) for a, b in zip(before, after)]
        return pd.DataFrame(got, columns=["before", "after", "case"])

    return F.pandas_udf(run, "before string, after string, case int")


def validated():
    """The candidate where it is close enough to its source, else the source cleaned up."""

    def run(source: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([" ".join(b.split()) if accepted(a or "", b or "") else clean_up(a or "") for a, b in zip(source, candidate)])

    return F.pandas_udf(run, "string")


def similarity():
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _ratio(a, b)

    return F.pandas_udf(run, "double")
