"""Periodic runs of words: maximal repetitions of every document, and the text with each run cut to its first period.

Documents are taken in chunks. A word's symbol is its number among the distinct words of its document, and each document ends
in a symbol of its own, so suffixes of two documents never agree and one suffix array serves the whole chunk:

1. suffix array by prefix doubling; the ranks of each step stay, so that the longest common extension of two places to
   the right or to the left is a descent over the steps (``Index``);
2. the longest previous factor of each place from its neighbours with smaller places in the suffix array (``previous_factors``),
   and from it the LZ blocks (``blocks``);
3. at each block's boundary the extensions of every period that can cross it (``boundary_runs``): a run that crosses a
   boundary, and no later one, has less than a period before the last but one block, so a run of ``times`` periods has
   (times - 1) * period < the two blocks' words;
4. runs inside one block are copied from where its words stood before, out of buckets by start (``copied_runs``).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import ID, TEXT, id_type, narrow, release

#: Words that a task takes at once; one document may be longer.
CHUNK = 1 << 18
#: A run has so many words at least, and so many periods.
LEAST, TIMES = 6, 4
#: Pairs of places whose extension is looked up at once.
PAIRS = 1 << 20


class Index:
    """Suffix array of ``symbols`` (all suffixes differ: documents end in symbols of their own) and common extensions.

    ``steps[k][i]`` is the rank of place i by its first 2 ** k symbols; equal ranks are equal symbols.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        s = symbols[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[starts, n])
        rank[order] = np.repeat(starts, size)
        self.n, self.steps = n, [self._held(rank)]
        open_, h = order[np.repeat(size, size) > 1], 1
        while len(open_):
            # Only places that share their rank are told apart further; a group's first rank stays its first member's.
            after = rank[np.minimum(open_ + h, n - 1)]
            by = np.lexsort((after, rank[open_]))
            open_, after = open_[by], after[by]
            old = rank[open_]
            head = np.r_[True, old[1:] != old[:-1]]
            new = head | np.r_[True, after[1:] != after[:-1]]
            at = np.arange(len(open_))
            rank = rank.copy()
            rank[open_] = old + (np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0)))
            self.steps.append(self._held(rank))
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(open_)])
            open_, h = open_[np.repeat(size, size) > 1], 2 * h
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _held(rank: np.ndarray) -> np.ndarray:
        return rank.astype(np.int32 if len(rank) < 1 << 31 else np.int64)

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that agree from places x and y (never the same place) on."""
        x, y = x.copy(), y.copy()
        start, last = x.copy(), self.n - 1
        for k in range(len(self.steps) - 1, -1, -1):
            inside = (x <= last) & (y <= last)
            same = inside & (self.steps[k][np.minimum(x, last)] == self.steps[k][np.minimum(y, last)])
            x += same.astype(np.int64) << k
            y += same.astype(np.int64) << k
        return x - start

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that agree up to places x and y, themselves included; a place before the first agrees with none."""
        x, y = x.copy(), y.copy()
        start = x.copy()
        for k in range(len(self.steps) - 1, -1, -1):
            a, b = x - (1 << k) + 1, y - (1 << k) + 1
            same = (a >= 0) & (b >= 0)
            same &= self.steps[k][np.maximum(a, 0)] == self.steps[k][np.maximum(b, 0)]
            x -= same.astype(np.int64) << k
            y -= same.astype(np.int64) << k
        return start - x


def previous_factors(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor that starts at each place and also at an earlier one; length 0 has no place."""
    n, first = index.n, index.steps[0]
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    order = index.suffixes
    # Symbols that stand once have no earlier factor; the others' suffixes are read symbol by symbol.
    share = np.bincount(first, minlength=n)[first[order]] > 1
    left, right, stack, group = before.tolist(), after.tolist(), [], -1
    places = order[share]
    for i, g in zip(places.tolist(), first[places].tolist()):
        if g != group:
            stack, group = [], g
        while stack and stack[-1] > i:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    before, after = np.array(left, np.int64), np.array(right, np.int64)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (before, after):
        at = np.flatnonzero(near >= 0)
        got = index.right(at, near[at])
        better = got > length[at]
        length[at[better]], source[at[better]] = got[better], near[at[better]]
    return length, source


def blocks(length: list[int], first: int, end: int) -> list[int]:
    """Starts of the LZ blocks of the document at [first, end), and its end."""
    out, i = [], first
    while i < end:
        out.append(i)
        i += length[i] or 1
    out.append(end)
    return out


def boundary_runs(index: Index, starts: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(document, start, end, period) of runs that touch a boundary, whatever its multiples. ``starts`` are all
    boundaries in order, the documents' ends included, ``doc`` theirs, ``ends`` the documents' ends."""
    width = np.diff(starts, prepend=starts[:1]) * (np.r_[False, doc[1:] == doc[:-1]])
    here = np.diff(starts, append=starts[-1:]) * (np.r_[doc[1:] == doc[:-1], False])
    most = np.maximum(width + here - 1, 0) // (times - 1)
    found: list[list[np.ndarray]] = [[], [], [], []]
    upto = np.cumsum(most)
    lo = 0
    while lo < len(starts):
        # So many boundaries that their periods are about PAIRS, one boundary at least.
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        m = most[lo:hi]
        nth = np.repeat(np.arange(lo, hi), m)
        p = np.arange(len(nth)) - np.repeat(np.cumsum(m) - m, m) + 1
        b, end = starts[nth], ends[doc[nth]]
        for x in (b, b - p):  # the period after the boundary, and the one before it
            ok = (x >= 0) & (x + p <= end)
            at, per, d = x[ok], p[ok], doc[nth[ok]]
            # Most places differ at once on both sides; only the others are extended.
            one = index.steps[0]
            near = (one[at] == one[at + per]) | ((at > 0) & (one[at - 1] == one[at + per - 1]))
            at, per, d = at[near], per[near], d[near]
            s = at - index.left(at - 1, at + per - 1)
            e = at + per + index.right(at, at + per)
            whole = e - s >= np.maximum(least, times * per)
            for col, v in zip(found, (d, s, e, per)):
                col.append(v[whole])
        lo = hi
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)


def copied_runs(starts: list[int], source: list[int], runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """``runs`` (start, end, period) of a document and those strictly inside one of its blocks, as where the block's words stood before."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in sorted(runs):
        bucket.setdefault(s, []).append((e, p))
    at = sorted(bucket)
    for b, e in zip(starts, starts[1:]):
        if e - b < least + 2:
            continue
        shift = b - source[b]
        i = bisect_right(at, b - shift)
        while i < len(at) and at[i] < e - shift:
            s = at[i]
            for end, p in bucket[s]:
                if end < e - shift:
                    there = bucket.get(s + shift)
                    if there is None:
                        there = bucket[s + shift] = []
                        at.insert(bisect_left(at, s + shift), s + shift)
                    if (end + shift, p) not in there:
                        there.append((end + shift, p))
            i += 1
    return [(s, e, p) for s in at for e, p in bucket[s]]


def runs_of(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each document, a list of words, its runs as (start, length, period) in order of start, then period."""
    codes, firsts, base = [], [], 0
    for words in docs:
        own: dict[bytes, int] = {}
        firsts.append(len(codes))
        codes += [own.setdefault(w, len(own) + base) for w in words]
        base += len(own) + 1
        codes.append(base - 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not docs:
        return out
    index = Index(np.array(codes, np.int64))
    length, source = previous_factors(index)
    own_length, own_source = length.tolist(), source.tolist()
    cuts = [blocks(own_length, f, f + len(words)) for f, words in zip(firsts, docs)]
    starts = np.array([s for c in cuts for s in c], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(c) for c in cuts])
    ends = np.array([f + len(w) for f, w in zip(firsts, docs)], np.int64)
    d, s, e, p = boundary_runs(index, starts, doc, ends, least, times)
    # A stretch was met with its smallest period and with multiples of it.
    order = np.lexsort((p, e, s))
    d, s, e, p = d[order], s[order], e[order], p[order]
    keep = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(s)]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, *run in zip(d[keep].tolist(), s[keep].tolist(), e[keep].tolist(), p[keep].tolist()):
        found.setdefault(k, []).append(tuple(run))
    for k, runs in found.items():
        every = copied_runs(cuts[k], own_source, runs, least)
        out[k] = sorted(((s - firsts[k], e - s, p) for s, e, p in every), key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, texts: bool = True,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]) for each row.

    A run is a stretch of ``least`` words and ``times`` of its smallest period or more that can't be extended; start, length, period
    are those of the run of the greatest exponent, null without one. ``runs`` are all as (start, length, period), ``collapsed``
    the words left when each run keeps its first period, joined by a space. ``change`` gives the words to look at
    from the id and the words. A null or blank text has no words and no runs; repeated rows and rows of one id are judged each by
    itself; an empty table gives no rows; other columns are ignored; the id may have any type. One pass, no shuffle; a document
    is one task's work, and a task holds CHUNK words or one document.
    """
    fields = ("start", "length", "period")
    triple = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
    names = [id_col, "n_words", "n_runs", *fields, "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    def settled(ids: list, docs: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        rows = []
        for words, runs in zip(docs, runs_of(docs, least, times)):
            best = greatest(runs)
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
            left = b" ".join(collapsed(words, runs))
            full = ([dict(zip(fields, r)) for r in runs], left.decode("utf-8", "replace")) if texts else (None, None)
            rows.append((len(words), len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest(), *full))
        cols = list(zip(*rows))
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), triple, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, kind = [], [], 0, None
        for b in batches:
            kind = b.column(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if change is not None:
                    words = change(i, words)
                if ids and size + len(words) > CHUNK:
                    yield settled(ids, held, kind)
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(words)
                size += len(words)
        if ids:
            yield settled(ids, held, kind)
        held = None
        release()

    struct = ", ".join(f"{f}: long" for f in fields)
    plain = ", ".join(f"{f} long" for f in ("n_words", "n_runs", *fields, "exponent_milli"))
    schema = f"`{id_col}` {id_type(docs, id_col)}, {plain}, runs_sha256 string, collapsed_sha256 string, runs array<struct<{struct}>>, collapsed string"
    out = narrow(docs, id_col, text_col).select(F.col(ID), F.col(TEXT)).mapInArrow(run, schema)
    return out if texts else out.drop("runs", "collapsed")
