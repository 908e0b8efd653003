"""Online speaker clustering: one pass in time order with prototypes, dynamic thresholds and merges.

The core is a plain class that takes event time as an argument, so that batch and stream share it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from confluo.functions import text as T

TRAILING_RANGE = re.compile(T.TRAILING_RANGE)


@dataclass
class Settings:
    """The service's defaults."""

    threshold: float = 0.71
    least_samples: int = 2
    alpha: float = 0.05
    tau: float = 28800.0
    protos: int = 8
    near_proto: float = 0.78
    merge_sure: float = 0.92
    merge_new: float = 0.80
    merge_periodic: float = 0.639
    guard: float = 0.65
    least_guard: float = 0.50
    margin: float = 0.02
    hard_margin: float = 0.65
    learn_from: float = 0.35
    create_from: float = 0.40
    soft: float = 0.50
    soft_share: float = 0.7
    recency: float = 0.02
    quick: float = 0.3
    quick_bonus: float = 0.02
    moves_bonus: float = 0.03
    session_threshold: float = 0.65
    session_guard: float = 0.55
    session_merges: int = 20


def broken_rule(v: np.ndarray, min_norm: float = 0.1, min_mean: float = 1e-6, max_zero: float = 0.5, most: float = 100.0) -> str | None:
    """The first rule that a vector breaks, or None; the rules of vectors.validity."""
    if not len(v):
        return "empty"
    if np.all(np.abs(v) <= 1e-8):
        return "all_zeros"
    if not np.all(np.isfinite(v)):
        return "nan_or_inf"
    if float(v @ v) < 1e-8:
        return "zero_norm"
    if np.abs(v).max() > most:
        return "extreme"
    if np.linalg.norm(v) < min_norm:
        return "low_norm"
    if np.abs(v).mean() < min_mean:
        return "low_mean"
    return "sparse" if (np.abs(v) <= 1e-8).mean() > max_zero else None


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(1e-12, float(np.linalg.norm(v)))


@dataclass
class Speaker:
    number: int
    centroid: np.ndarray
    protos: list[list] = field(default_factory=list)  # [unit vector, count]
    count: int = 1
    last_seen: float = 0.0
    chunks: list[tuple] = field(default_factory=list)
    variance: float = 0.0

    def settle(self) -> None:
        self.centroid = _unit(sum(v * n for v, n in self.protos))


class Clusterer:
    def __init__(self, s: Settings | None = None):
        self.s, self.speakers, self.next, self.seen = s or Settings(), {}, 0, 0
        self.last, self.last_end = None, 0.0
        self.moves: dict[tuple[int, int], int] = {}
        self.merges: list[tuple[int, int]] = []
        self.invalid: dict[str, int] = {}

    def dynamic(self, now: float) -> float:
        n = sum(now - p.last_seen <= 2 * self.s.tau for p in self.speakers.values())
        return self.s.threshold + 0.02 * (1 - math.exp(-n / 8))

    def _bonus(self, to: int) -> float:
        if self.last is None or self.last == to:
            return 0.0
        total = sum(n for (a, _), n in self.moves.items() if a == self.last)
        return min(self.s.moves_bonus * self.moves.get((self.last, to), 0) / total, self.s.moves_bonus) if total else 0.0

    def _score(self, p: Speaker, v: np.ndarray, now: float, start: float | None) -> float:
        x = max(float(v @ q) for q, _ in p.protos)
        if now > p.last_seen:
            x *= math.exp(-(now - p.last_seen) / self.s.tau)
        if p.number == self.last:
            x += self.s.recency
            if start is not None and self.last_end > 0 and 0 <= start - self.last_end < self.s.quick:
                x += self.s.quick_bonus
        return x + self._bonus(p.number)

    def identify(self, v: np.ndarray, now: float, start: float | None, end: float | None, chunk=None, label=None, overlap: bool = False, onset: bool = False, duration: float | None = None) -> tuple[int | None, float]:
        """(speaker, confidence) of one segment; None is nobody known. ``now`` is event time."""
        s = self.s
        self.seen += 1
        rule = broken_rule(v)
        if rule:
            self.invalid[rule] = self.invalid.get(rule, 0) + 1
            return None, 0.0
        duration = duration if duration is not None else 1.0
        v, learn = _unit(v), not overlap and not onset and duration >= s.learn_from
        self.clean_up()
        if not self.speakers:
            return (None, 0.0) if overlap else (self._create(v, now, end, chunk, label), 1.0)
        scores = {k: self._score(p, v, now, start) for k, p in self.speakers.items()}
        best, top, second = None, -1.0, -1.0
        for k, x in scores.items():
            if x > top:
                best, top, second = k, x, top
            elif x > second:
                second = x
        penalty = max(0.0, s.margin - (top - second)) if second > -1 else 0.0
        force = penalty > 0 and top - penalty < s.hard_margin and duration >= s.create_from
        if duration < s.create_from and not overlap:
            if best is None or top < s.soft:
                return None, 0.0
            self._heard(best, end, chunk, label)
            return best, s.soft_share * top
        if best is not None and top - penalty >= self.dynamic(now) and not force:
            ranked = sorted(scores.values(), reverse=True)
            e = np.exp(np.array(ranked) - max(ranked))
            p = e / e.sum()
            confidence = float(math.exp(scores[best] - max(ranked)) / e.sum() * (0.7 + 0.3 * (p[0] - p[1] if len(p) > 1 else 1.0)))
            if learn:
                self._learn(self.speakers[best], v)
            self.speakers[best].last_seen = now
            self._heard(best, end, chunk, label)
            if self.seen % 3 == 0:
                self.merge(s.merge_periodic)
            return best, confidence
        if overlap:
            return None, 0.0
        new = self._create(v, now, end, chunk, label)
        into = self._merge_new(new, v)
        return (new, 1.0) if into is None else (into, float(np.clip(v @ self.speakers[into].centroid, -1, 1)))

    def clean_up(self) -> list[int]:
        """Speakers whose centroid breaks a rule go."""
        gone = [k for k, p in self.speakers.items() if broken_rule(p.centroid)]
        for k in gone:
            del self.speakers[k]
        return gone

    def _create(self, v, now, end, chunk, label) -> int:
        k, self.next = self.next, self.next + 1
        self.speakers[k] = Speaker(k, v, [[v, 1]], 1, now)
        self.last = k  # before the move is noted: a new speaker's first move is to itself and so is none
        self._heard(k, end, chunk, label)
        return k

    def _heard(self, k: int, end, chunk, label) -> None:
        if self.last is not None and self.last != k:
            self.moves[self.last, k] = self.moves.get((self.last, k), 0) + 1
        if chunk is not None and label is not None:
            self.speakers[k].chunks = [*self.speakers[k].chunks, (chunk, label)][-50:]
        self.last = k
        if end is not None:
            self.last_end = end

    def _learn(self, p: Speaker, v: np.ndarray) -> None:
        near = max(p.protos, key=lambda q: float(v @ q[0]))
        if float(v @ near[0]) >= self.s.near_proto:
            near[0], near[1] = _unit((1 - self.s.alpha) * near[0] + self.s.alpha * v), near[1] + 1
        elif len(p.protos) < self.s.protos:
            p.protos.append([v, 1])
        else:  # the prototype most like another one gives way
            m = np.stack([q for q, _ in p.protos])
            like = m @ m.T - 3 * np.eye(len(m))
            p.protos[int(like.max(1).argmax())] = [v, 1]
        p.count += 1
        p.settle()
        m = np.stack([q for q, _ in p.protos])
        upper = np.triu_indices(len(m), 1)
        p.variance = 1 - float((m @ m.T)[upper].mean()) if len(m) > 1 else 0.0

    def together(self, a: Speaker, b: Speaker) -> bool:
        """Both were heard in one chunk under different labels."""
        mine: dict = {}
        for c, x in a.chunks:
            mine.setdefault(c, set()).add(x)
        return any(c in mine and x not in mine[c] for c, x in b.chunks)

    def _alike(self, a: Speaker, b: Speaker, guard: float) -> bool:
        """Each prototype of ``a`` has one of ``b`` near enough; speakers that vary much are asked for less."""
        if min(len(a.protos), len(b.protos)) < 2:
            return True
        least = min(max(float(q @ r) for r, _ in b.protos) for q, _ in a.protos)
        return least >= max(guard - (a.variance + b.variance) / 2, self.s.least_guard)

    def _merge_new(self, k: int, v: np.ndarray) -> int | None:
        """A new speaker has one prototype, so the guard on prototypes never holds it back."""
        for j, p in list(self.speakers.items()):
            if j == k or p.count < 2:
                continue
            c = float(v @ p.centroid)
            if c >= self.s.merge_sure or c >= self.s.merge_new and not self.together(p, self.speakers[k]):
                self._join(j, k)
                return j
        return None

    def similar(self, at: float) -> list[tuple[float, int, int]]:
        """(cosine, a, b) of pairs of speakers with enough samples, the nearest first."""
        live = [p for p in self.speakers.values() if p.count >= self.s.least_samples]
        pairs = [(float(np.clip(a.centroid @ b.centroid, -1, 1)), a.number, b.number) for i, a in enumerate(live) for b in live[i + 1 :]]
        return sorted((x for x in pairs if x[0] >= at), key=lambda x: -x[0])

    def merge(self, at: float, most: int = 5, session: bool = False, guard: float | None = None) -> int:
        """Merge near-certain pairs, then pairs from ``at`` on, each time the nearest allowed; the number of merges."""
        guard, done = self.s.guard if guard is None else guard, 0

        def allowed(c: float, a: int, b: int) -> bool:
            x, y = self.speakers[a], self.speakers[b]
            return c >= self.s.merge_sure or (session or not self.together(x, y)) and self._alike(x, y, guard)

        for level in (self.s.merge_sure, at):
            while done < most:
                hit = next(((a, b) for c, a, b in self.similar(level) if allowed(c, a, b)), None)
                if not hit:
                    break
                self._join(*hit)
                done += 1
        return done

    def consolidate(self) -> list[tuple[int, int]]:
        """(kept, lost) of the merges after a session: relaxed thresholds, shared chunks don't count."""
        before = len(self.merges)
        self.merge(self.s.session_threshold, self.s.session_merges, True, self.s.session_guard)
        return [(kept, lost) for lost, kept in self.merges[before:]][-20:]

    def merge_by_hand(self, a: int, b: int) -> bool:
        """False where one of them isn't known. Who spoke last is then the one that stayed."""
        if a == b or a not in self.speakers or b not in self.speakers:
            return False
        self._join(a, b)
        if self.last == max(a, b):
            self.last = min(a, b)
        return True

    def statistics(self) -> dict:
        counts = [p.count for p in self.speakers.values()]
        bad = sum(self.invalid.values())
        return {"speakers": len(counts), "samples": sum(counts), "mean": sum(counts) / max(1, len(counts)), "valid": (self.seen - bad) / max(1, self.seen)}

    def _join(self, a: int, b: int) -> None:
        kept, lost = min(a, b), max(a, b)
        p, q = self.speakers[kept], self.speakers.pop(lost)
        p.protos = p.protos + q.protos
        if len(p.protos) > self.s.protos:
            p.protos = sorted(p.protos, key=lambda x: -x[1])[: self.s.protos]
        p.settle()
        p.count, p.last_seen, p.chunks, p.variance = p.count + q.count, max(p.last_seen, q.last_seen), (p.chunks + q.chunks)[-50:], 0.0
        for x, y in [m for m in self.moves if lost in m]:
            n = self.moves.pop((x, y))
            x, y = (kept if x == lost else x), (kept if y == lost else y)
            if x != y:
                self.moves[x, y] = self.moves.get((x, y), 0) + n
        self.merges.append((lost, kept))


SPEAKER_TURNS = ("turn_id", "v", "start", "end", "duration", "chunk", "label", "is_overlap", "is_onset")


def online_speakers(turns: DataFrame, key: str, settings: Settings | None = None) -> DataFrame:
    """(key, turn_id, speaker, confidence, final): a stream's turns in order of start, one task a stream; -1 is nobody known.

    ``turns`` has the columns of SPEAKER_TURNS; the event time is the start. ``final`` is the speaker after the consolidation at the end.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, out = Clusterer(settings), []
        for r in pdf.sort_values(["start", "turn_id"]).itertuples():
            k, conf = c.identify(np.asarray(r.v, float), r.start, r.start, r.end, r.chunk, r.label, r.is_overlap, r.is_onset, r.duration)
            out.append((getattr(r, key), r.turn_id, -1 if k is None else k, round(conf, 6)))
        c.consolidate()
        end = dict(c.merges)

        def last(k: int) -> int:
            while k in end:
                k = end[k]
            return k

        return pd.DataFrame([(*x, last(x[2])) for x in out], columns=[key, "turn_id", "speaker", "confidence", "final"])

    return turns.select(key, *SPEAKER_TURNS).groupBy(key).applyInPandas(run, f"{key} long, turn_id long, speaker long, confidence double, final long")


def overlap_share(a: dict, b: dict) -> float:
    """Common time over the shorter one's, at least a millisecond."""
    a1, b1 = max(a["start_ms"], a["end_ms"]), max(b["start_ms"], b["end_ms"])
    both = max(0, min(a1, b1) - max(a["start_ms"], b["start_ms"]))
    return both / min(max(1, a1 - a["start_ms"]), max(1, b1 - b["start_ms"]))


def merged(have: list[dict], incoming: list[dict], latest_end: int | None = None, near: int = 30000) -> list[dict]:
    """Sections after taking in others one by one, by start and end.

    The best match by overlap plus half for an equal heading, the first among equals, from an overlap of a half or an equal
    heading on, is replaced; without one the section is added. With ``latest_end`` only a section that ends near it may
    shrink: any other one keeps its text against fewer words, and only its end may grow.
    """
    title = lambda x: (x["heading"] or "").strip().lower()
    have = [dict(x) for x in have]
    for s in incoming:
        best, top = None, 0.0
        for i, x in enumerate(have):
            share, same = overlap_share(s, x), bool(title(s)) and title(s) == title(x)
            if (share >= 0.5 or same) and share + 0.5 * same > top:
                best, top = i, share + 0.5 * same
        heading = TRAILING_RANGE.sub("", (s["heading"] or "Untitled Topic").strip()).strip()
        new = {**s, "heading": heading, "end_ms": max(s["start_ms"], s["end_ms"]), "content": s["content"] or ""}
        if best is None:
            have.append(new)
            continue
        old = have[best]
        free = latest_end is None or abs(old["end_ms"] - latest_end) < near
        if free or len(new["content"].split()) >= len((old["content"] or "").split()):
            have[best] = new
        else:
            old["end_ms"] = max(old["end_ms"], new["end_ms"])
    return sorted(have, key=lambda x: (x["start_ms"], x["end_ms"]))


def spliced(have: list[dict], verified: list[dict]) -> list[dict]:
    """Each verified section in place of the first one that it overlaps by a half."""
    have = list(have)
    for v in verified:
        at = next((i for i, x in enumerate(have) if overlap_share(v, x) >= 0.5), None)
        if at is not None:
            have[at] = v
    return have


_SECTION = ["heading", "start_ms", "end_ms", "content"]


def _with_sections(old: DataFrame, new: DataFrame, key: str, rule) -> DataFrame:
    """``rule`` on the two lists of sections of a stream, each in order of start and end."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = lambda x: [] if x.empty else x.sort_values(["start_ms", "end_ms"], kind="stable").to_dict("records")
        return pd.DataFrame(rule(rows(a), rows(b)), columns=[key, *_SECTION])

    # Both sides may come from one table: toDF gives one of them names of its own.
    right = new.toDF(*new.columns).select(key, *_SECTION).groupBy(key)
    return old.select(key, *_SECTION).groupBy(key).cogroup(right).applyInPandas(run, f"{key} long, heading string, start_ms long, end_ms long, content string")


def merge_sections(old: DataFrame, new: DataFrame, key: str = "stream_id") -> DataFrame:
    """Sections after taking in ``new``; only the one that ended last may shrink."""
    return _with_sections(old, new, key, lambda a, b: merged(a, b, max((x["end_ms"] for x in a), default=None)))


def splice_sections(old: DataFrame, new: DataFrame, key: str = "stream_id") -> DataFrame:
    return _with_sections(old, new, key, spliced)
