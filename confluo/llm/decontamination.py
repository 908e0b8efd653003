"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks.

Document frequencies of the benchmark's words are counted over all documents. A randomised SVD (random range, two power
steps, each a distributed pass of partial products) of the TF-IDF passages gives latent directions, half as many as passages or
fewer but for very small benchmarks. Windows of all documents are folded in by sums of their words' rows; a word outside the benchmark has no direction, but
its weight turns its window away from every passage. Windows near a passage by cosine are candidates, and so is each passage that stands word for word. They are verified
on words: the longest common subsequence must hold enough of the passage. A high share is a leak by itself; a weak one is, if
enough of the passage's rarest words (its answer) are there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import ID, KEY, TEXT, cut, id_type, narrow, release, row_key

#: Directions: RANK, or half as many as passages if those are fewer, but FULL or as many as passages at least.
RANK, FULL, POWER, SEED = 128, 32, 2, 7
#: Passages are pieces of PIECE words. They are compared with windows of whole steps of STEP words: of the first of WIDTHS that
#: holds them, else the last. BLOCK passages are compared in one pass over the documents.
PIECE, STEP, WIDTHS, BLOCK = 32, 8, (2, 4), 8192
#: A window is a candidate from this cosine on; a candidate is a leak from this share of the passage in common on.
NEAR, SURE = 0.2, 0.6
#: A weaker share is one if so much of the answer, the passage's rarest words, is there too.
COMMON, ANSWER, ANSWER_WORDS = 0.55, 0.6, 6
#: Passages of fewer words are found word for word only; those of any length are found so too.
LEAST_WORDS = 8
#: Words of documents that are compared at once, and cosines.
SPAN, CELLS = 1 << 15, 1 << 20
#: Fixed value: ASCII punctuation, which is stripped from the ends of words.
_EDGE = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def bare(words: list[bytes]) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in words]


def pieces(words: list[bytes]) -> list[list[bytes]]:
    """Passages of an item: PIECE words, overlapping by half; an item of up to one and a half is one passage."""
    if len(words) <= PIECE + PIECE // 2:
        return [words]
    return [words[s : s + PIECE] for s in range(0, len(words) - PIECE, PIECE // 2)] + [words[-PIECE:]]


def passages(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, nth, words) of every item with a word; ``words`` are bare and joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, n, b" ".join(p).decode("utf-8", "replace")) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := bare(normal_words(t))) for n, p in enumerate(pieces(w))]
            cols = list(zip(*got)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["item", "nth", "words"])

    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias(TEXT)).mapInArrow(run, "item long, nth long, words string")


def document_frequencies(d: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """(documents that hold each word of the vocabulary, documents), over all of ``d``: exact counts, one a word."""
    sent, size = d.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)  # the words of a block of passages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, place = np.zeros(size + 1, np.int64), sent.value
        get = place.get
        for b in batches:
            for t in b.column(0).to_pylist():
                at = {get(w.strip(_EDGE) or w, -1) for w in set(normal_words(t))}
                at.discard(-1)
                df[list(at)] += 1
            df[size] += b.num_rows
        release()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["f", "n"])

    got = d.select(TEXT).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for f, n in got:
        df[f] = n
    return df[:size], int(df[size])


def latent(texts: DataFrame, place: dict[bytes, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """words x rank directions of the unit TF-IDF passages of ``texts`` (words): the range finder of a randomised SVD, with
    partial products A'(A M) from each task. ``place`` numbers the words, ``idf`` weighs them."""
    m = np.random.default_rng(SEED).standard_normal((len(place), rank)).astype(np.float32)
    for _ in range(POWER + 1):

        def run(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            out = np.zeros(m.shape, np.float32)
            for b in batches:
                for t in b.column(0).to_pylist():
                    piece, n = np.unique([place[w] for w in t.encode().split(b" ")], return_counts=True)
                    w = n * idf[piece]
                    w = (w / max(1e-9, float(np.sqrt((w * w).sum())))).astype(np.float32)
                    out[piece] += w[:, None] * (m[piece] * w[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["y"])

        total = np.zeros(m.shape, np.float64)
        for (part,) in texts.coalesce(4).mapInArrow(run, "y binary").toLocalIterator():  # one part a task of a block
            total += np.frombuffer(part, np.float32).reshape(m.shape)
        m = np.linalg.qr(total)[0].astype(np.float32)
    return m


def places(words: list[int]) -> dict[int, int]:
    """Of each word the places it has in ``words``, as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    return at


def in_order(masks) -> int:
    """Length of the longest common subsequence, one big-integer step a word; a step is the word's places in the other text."""
    row = 0
    for m in masks:
        x = row | m
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


class Passages:
    """A block of benchmark passages: latent vectors, words and answers."""

    def __init__(self, rows: list[tuple]):
        self.items = [(r[0], r[1]) for r in rows]
        self.words = [r[2].encode().split(b" ") for r in rows]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.numbers = [np.array([self.vocabulary[x] for x in w], np.int64) for w in self.words]
        self.places = [places(x.tolist()) for x in self.numbers]

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = (np.log((n + 1) / (df + 1)) + 0.01).astype(np.float32)
        rarest = [sorted(set(w), key=lambda x: (-float(self.idf[self.vocabulary[x]]), x))[:ANSWER_WORDS] for w in self.words]
        self.answers = [[self.vocabulary[x] for x in a] for a in rarest]
        #: The passages by the number of their rarest word, with its first place in them: few texts hold it.
        self.rarest: dict[int, list[tuple[int, int]]] = {}
        for k, (w, a) in enumerate(zip(self.words, rarest)):
            self.rarest.setdefault(self.vocabulary[a[0]], []).append((k, w.index(a[0])))
        self.rare = np.zeros(len(self.vocabulary) + 1, bool)  # by word, the last one is any other
        self.rare[list(self.rarest)] = True

    def project(self, basis: np.ndarray) -> None:
        """Vectors of passages, by the width of the windows they are compared with; rows of words, then those of a word
        outside the vocabulary (only a weight: it turns a window away from every passage) and of padding."""
        rank = basis.shape[1]
        rows = basis * self.idf[:, None]
        long = [k for k, w in enumerate(self.words) if len(w) >= LEAST_WORDS]
        v = np.array([rows[[self.vocabulary[x] for x in self.words[k]]].sum(0) for k in long], np.float32).reshape(len(long), rank)
        whole = sum(float((self.idf[self.vocabulary[x]] ** 2)) for k in long for x in self.words[k])
        kept = float((v * v).sum()) / max(1e-9, whole)  # the share of a passage that the directions hold
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.rows = np.vstack([rows, np.zeros((2, rank))]).astype(np.float32)
        self.outside = np.zeros(len(rows) + 2, np.float32)
        self.outside[len(rows)] = kept * float(np.square(self.idf).mean()) if len(rows) else 1.0
        self.groups = []
        for steps in WIDTHS:
            mine = [j for j, k in enumerate(long) if self.width(len(self.words[k])) == steps]
            if mine:
                self.groups.append((steps, v[mine].T.copy(), np.array([long[j] for j in mine])))

    @staticmethod
    def width(n: int) -> int:
        """Steps of the windows a passage of n words is compared with."""
        return next((s for s in WIDTHS if s * STEP >= n), WIDTHS[-1])

    def near(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """{(document, passage): [(first word, cosine) of each window from NEAR on]} for documents as word numbers, all at once."""
        pad, most = len(self.rows) - 1, WIDTHS[-1]
        steps = np.array([-(-len(x) // STEP) for x in docs])
        first = np.cumsum(np.r_[0, steps + most])  # so many steps of padding that no window reaches two documents
        ids = np.full(first[-1] * STEP, pad, np.int64)
        for x, s in zip(docs, first):
            ids[s * STEP : s * STEP + len(x)] = x
        step = self.rows[ids[::STEP]]
        for j in range(1, STEP):
            step += self.rows[ids[j::STEP]]
        other = self.outside[ids].reshape(-1, STEP).sum(1)
        owner = np.repeat(np.arange(len(docs)), steps + most)
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for width, vectors, which in self.groups:
            m = len(step) - width + 1
            v, o = step[:m].copy(), other[:m].copy()
            for j in range(1, width):
                v += step[j : j + m]
                o += other[j : j + m]
            v /= np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v) + o, 1e-9))[:, None]
            rows = max(1, CELLS // len(which))
            for a in range(0, m, rows):
                c = v[a : a + rows] @ vectors
                for i, j in zip(*np.nonzero(c >= NEAR)):
                    d = int(owner[a + i])
                    found.setdefault((d, int(which[j])), []).append((int(a + i - first[d]) * STEP, float(c[i, j])))
        return found

    def verified(self, k: int, numbers: np.ndarray, windows: list[tuple[int, float]]) -> tuple | None:
        """(cosine, share in common, share of the answer, first word) at the best of the windows, or None, from the numbers of a
        document's words."""
        best, at, n, answer = None, self.places[k], len(self.words[k]), self.answers[k]
        reach = self.width(n) * STEP + n
        for start, cosine in windows:
            if best and best[1] >= 1.0:
                break
            region = numbers[max(0, start - n) : start + reach].tolist()
            have, there = at.keys() & region, 0
            for w in have:  # the passage's places whose word is in the region: no common subsequence is longer
                there |= at[w]
            if there.bit_count() < COMMON * n:
                continue
            masks = [at[w] for w in region if w in have]
            common = in_order(masks) / n
            if common < COMMON or (best and common <= best[1]):
                continue
            share = sum(w in have for w in answer) / len(answer)
            if common >= SURE or share >= ANSWER:
                best = (cosine, common, share, start)
        return best

    def stands(self, numbers: np.ndarray) -> dict[int, int]:
        """{passage: first word} of each passage that stands word for word among the numbers of a document's words."""
        found: dict[int, int] = {}
        for i in np.flatnonzero(self.rare[numbers]).tolist():
            for k, at in self.rarest[int(numbers[i])]:
                mine = self.numbers[k]
                if i >= at and k not in found and np.array_equal(numbers[i - at : i - at + len(mine)], mine):
                    found[k] = i - at
        return found


def search(d: DataFrame, block: Passages, *carry: str) -> DataFrame:
    """The columns ``carry`` with item_id, nth, cosine, common, answer and at: verified leaks, a row a passage."""
    schema = d.select(*carry).schema.add("item_id", "long").add("nth", "long").add("cosine", "double").add("common", "double").add("answer", "double").add("at", "long")
    sent = d.sparkSession.sparkContext.broadcast(block)  # at most BLOCK passages
    n_carry = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        outside = len(block.vocabulary)
        get = block.vocabulary.get
        release()

        def leaks(texts: list[tuple[int, list[bytes]]]) -> Iterator[tuple]:
            """Leaks of some documents, and of a long one by overlapping parts."""
            cut, far, whole, found = [], WIDTHS[-1] * STEP + PIECE * 2, {}, {}
            for row, raw in texts:
                whole[row] = numbers = np.array([get(w.strip(_EDGE) or w, outside) for w in raw], np.int64)
                cut += [(row, s, numbers[s : s + SPAN]) for s in range(0, max(1, len(raw) - far), SPAN - far)]
            for (i, k), windows in block.near([c[2] for c in cut]).items():
                row, s = cut[i][:2]
                got = block.verified(k, whole[row], [(a + s, c) for a, c in windows])
                if got and ((row, k) not in found or got[1] > found[row, k][1]):
                    found[row, k] = got
            for row, s, numbers in reversed(cut):
                for k, spot in block.stands(numbers).items():
                    # The cosine is that of the passage itself; a window's, if one was near enough, stays.
                    found[row, k] = (found.get((row, k), (1.0,))[0], 1.0, 1.0, s + spot)
            for (row, k), got in sorted(found.items()):
                yield row, block.items[k], got

        for b in batches:
            some, n, got = [], 0, []
            for row, t in enumerate(b.column(n_carry).to_pylist()):
                raw = normal_words(t)
                if raw:
                    some.append((row, raw))
                    n += len(raw)
                if n >= SPAN:
                    got += leaks(some)
                    some, n = [], 0
            got += leaks(some) if some else []
            take = pa.array([g[0] for g in got], pa.int64())
            new = [pa.array([g[1][i] for g in got], pa.int64()) for i in (0, 1)] + [pa.array([g[2][i] for g in got], pa.float64()) for i in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(n_carry)), *new, pa.array([g[2][3] for g in got], pa.int64())], names=schema.names)

    return d.select(*carry, TEXT).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, cosine, common, answer, at), one row a leaking document and benchmark item; the row's key is in KEY.

    Only documents with a leak are in the result; the figures are those of the item's best passage. Passages that
    stand word for word are leaks whatever their length, those under LEAST_WORDS words only so. Null and empty texts leak nothing, null and empty items aren't leaked;
    items with a null id are searched and have a null id in the result, all of them one item; equal rows of documents are
    one row of the result, null ids are treated like any; an empty table or benchmark gives no rows; other columns are ignored.
    """
    d = narrow(docs, id_col, text_col).withColumn(KEY, row_key(F.col(ID), F.col(TEXT)))
    found = cut(passages(benchmark, item_col, item_text).distinct())
    n_passages = found.count()
    if not n_passages:
        kinds = f"{KEY} long, item_id long, cosine double, common double, answer double, at long"
        return d.sparkSession.createDataFrame([], f"`{id_col}` {id_type(docs, id_col)}, {kinds}")
    blocks, out = -(-n_passages // BLOCK), None
    for k in range(blocks):  # the passages are a stated set; a block is searched in one pass over the documents
        mine = found.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else found
        block = Passages(sorted((tuple(r) for r in mine.collect()), key=str))
        block.weigh(*document_frequencies(d, block.vocabulary))
        rank = max(1, min(len(block.words), len(block.vocabulary), max(FULL, min(RANK, len(block.words) // 2))))
        block.project(latent(mine.select("words"), block.vocabulary, block.idf, rank))
        part = search(d, block, ID, KEY)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(ID, KEY, "item_id").agg(F.max(F.struct("common", "cosine", "answer", "at")).alias("best"))
    return best.select(F.col(ID).alias(id_col), KEY, "item_id", "best.cosine", "best.common", "best.answer", "best.at")


def drop_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns whatever their names, without the rows whose key is among the leaks; empty tables give no rows."""
    out = leaks.select(F.col(KEY).alias("__leak")).distinct()
    return docs.join(out, row_key(docs[id_col], docs[text_col]) == out["__leak"], "left_anti")
