"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text, less exception phrases.

Folding: lower case; compatibility forms and letters that look like Latin ones become those; digits and signs
inside words become the letters they stand for; all else than letters and digits parts words. Terms are whole words
or beginnings of words, found in labelled rows: each must stand beside several different words, so that copies
of one text don't make its words terms. The score is a logistic function of the matched weight over the square
root of the text's length, fitted to the labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import ID, TEXT, cut, id_type, narrow

#: The lexicon is fitted on so many labelled rows of each class at most (smallest hash of the id).
SAMPLE = {1: 2000, 0: 4000}
#: The model's size, documented parameters: letters of a term, and terms and exception pairs at most, those with the most evidence.
SHORTEST, LONGEST, LEXICON = 3, 9, 5000
LEAST_DOCS, LEAST_NEIGHBOURS, PRECISION, EVIDENCE = 4, 4, 0.9, 16.0
AT = 0.3
#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁɡοαεικνρτυχßı", "abekmhopctyxijsdgoaeikvptuxsi")
DIGITS = str.maketrans("01345789@$", "oieastbgas")
_OTHER_SCRIPT = re.compile("[ıɑ-ɡͰ-ϿЀ-ԯ -⁯℀-⅏＀-￯\U0001d400-\U0001d7ff]")
_INSIDE = re.compile(r"[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    t = text.lower()
    if _OTHER_SCRIPT.search(t):
        t = unicodedata.normalize("NFKC", t).lower().translate(HOMOGLYPHS)
        t = re.sub("[​-‏⁠­]", "", t)
    if _INSIDE.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(DIGITS), t)
    return _WORD.findall(t)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@dataclass
class Lexicon:
    """Terms begin with a space; those for whole words end with one. exceptions: pairs of words that don't count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    bias: float = -3.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        if self.weights:
            a.make_automaton()
        return a if self.weights else None

    def matches(self, a, words: list[str]) -> Iterator[tuple[str, str, float]]:
        """(word before, matched word, weight) of each match."""
        if a is None or not words:
            return
        line = f" {' '.join(words)} "
        for end, (n, w) in a.iter(line):
            start = end - n + 1
            yield line[line.rfind(" ", 0, start) + 1 : start] if start else "", line[start + 1 : line.index(" ", start + 1)], w

    def strength(self, a, words: list[str]) -> float:
        total = sum(w for before, word, w in self.matches(a, words) if f"{before} {word}" not in self.exceptions)
        return total / math.sqrt(max(1, len(words)))

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * strength))))


def _terms(words: list[str]) -> Iterator[tuple[str, str]]:
    before = ""
    for w in words:
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            yield f" {w[:k]}", before
        if len(w) >= SHORTEST:
            yield f" {w} ", before
        before = w


def choose_terms(counts: list[tuple[str, int, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms and weights from (term, toxic documents, clean documents, neighbours): the most specific beginnings that
    together keep the documents of the shorter ones."""
    good: dict[str, tuple[int, float]] = {}
    for term, t, c, neighbours in counts:
        rate, other = (t + 0.5) / (toxic + 1), (c + 0.5) / (clean + 1)
        weight = math.log(rate / other)
        if t >= LEAST_DOCS and neighbours >= LEAST_NEIGHBOURS and rate / (rate + other) >= PRECISION and 2 * t * weight >= EVIDENCE:
            good[term] = (t, weight)
    children: dict[str, list[str]] = {}
    for term in good:
        children.setdefault(term[:-1], []).append(term)
    chosen: dict[str, float] = {}
    todo = [t for t in good if t[:-1] not in good]
    while todo:
        term = todo.pop()
        kids = children.get(term, [])
        if kids and len(kids) <= 3 and sum(good[k][0] for k in kids) >= 0.95 * good[term][0]:
            todo += kids
        else:
            chosen[term] = good[term][1]
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(slope, bias) by Newton's method with a small ridge."""
    a, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - 1e-2 * beta
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", label_id: str = "doc_id") -> Lexicon:
    """A lexicon from labelled rows that aren't held out (crc32 of the id as text, mod 4, is not 2)."""
    d = narrow(docs, id_col, text_col)
    usable = labels.select(F.col(label_id).alias("__pick"), F.col(label).cast("int").alias("__y")).na.drop().groupBy("__pick").agg(F.min("__y").alias("__y")).where(F.crc32(F.col("__pick").cast("string")) % 4 != 2)
    share = {r[0]: r[1] for r in usable.groupBy("__y").count().collect()}
    if not share.get(1) or not share.get(0):
        return Lexicon()
    some = None
    for y, n in SAMPLE.items():
        part = usable.where(F.col("__y") == y).orderBy(F.xxhash64("__pick"), "__pick").limit(n)
        some = part if some is None else some.unionByName(part)
    rows = cut(d.join(F.broadcast(some), F.col(ID) == F.col("__pick")).groupBy(TEXT).agg(F.min("__y").alias("__y")).select("__y", TEXT))  # the sample's ids are few by SAMPLE

    def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list] = {}
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine: set[str] = set()
                for term, before in _terms(fold(text or "")):
                    s = seen.get(term)
                    if s is None:
                        s = seen[term] = [0, 0, set()]
                    if y and len(s[2]) < LEAST_NEIGHBOURS:
                        s[2].add(before)
                    mine.add(term)
                for term in mine:
                    seen[term][0 if y else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([s[0] for s in seen.values()], pa.int64()), pa.array([s[1] for s in seen.values()], pa.int64()), pa.array([sorted(s[2]) for s in seen.values()], pa.list_(pa.string()))], names=["term", "t", "c", "near"])

    counts = rows.repartition(8).mapInArrow(term_rows, "term string, t long, c long, near array<string>").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    n = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    good = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("near") >= LEAST_NEIGHBOURS) & (F.col("t") * n.get(0, 0) >= F.col("c") * n.get(1, 0))).orderBy(F.desc(F.col("t") * n.get(0, 1) - F.col("c") * n.get(1, 0)), "term").limit(20 * LEXICON)
    lexicon = Lexicon(choose_terms([tuple(r) for r in good.collect()], n.get(1, 0), n.get(0, 0)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            got: Counter = Counter()
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.update({(f"{before} {word}", y) for before, word, _ in lexicon.matches(a, fold(text or ""))})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got]), pa.array([k[1] for k in got], pa.int32()), pa.array(list(got.values()), pa.int64())], names=["pair", "y", "n"])

    pairs = rows.mapInArrow(hits, "pair string, y int, n long").groupBy("pair").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"))
    lexicon.exceptions = frozenset(r[0] for r in pairs.where("c >= 3 and t = 0").orderBy(F.desc("c"), "pair").limit(LEXICON).collect())

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.strength(a, fold(t or "")) for t in b.column(1).to_pylist()], pa.float64())], names=["y", "x"])

    got = rows.mapInArrow(strengths, "y int, x double").toPandas().sort_values(["y", "x"])
    y, x = got["y"].to_numpy(float), got["x"].to_numpy(float)
    # Each class weighs as in all labelled rows, not as in the sample.
    w = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum())) / (share[0] + share[1]) * len(y)
    lexicon.slope, lexicon.bias = _logistic(x, y, w)
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: float = AT) -> DataFrame:
    """(id, held_out, score, predicted, strength) for each row.

    Only the text enters a score. Null and empty texts get the score of a text without matches; a null id is held out
    or not as the text 'None'; repeated rows each get a row; without labels of both classes nothing matches and all
    scores are low; an empty table gives no rows; other columns are ignored.
    """
    lexicon = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            s = [lexicon.strength(a, fold(t or "")) for t in b.column(1).to_pylist()]
            p = [lexicon.score(x) for x in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= at) for x in p], pa.int32()), pa.array(s, pa.float64())], names=[id_col, "held_out", "score", "predicted", "strength"])

    return narrow(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, held_out boolean, score double, predicted int, strength double")
