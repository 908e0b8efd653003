"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Texts are cut into phrases where their content says so: each stretch of SPAN grams of GRAM bytes has an anchor, its gram of the
least hash (the last one of equals), and a phrase lies between two anchors. A window of ``window`` bytes belongs to the
anchor of its first stretch, which its bytes alone decide, and so do the next ``depth`` phrases: two equal windows have
their anchor at the same offset and the same phrases after it. So only suffixes that begin at an anchor are sorted, with phrases as symbols.

1. A block of documents is some shards; each shard's suffixes are sorted once, which gives its transform (``transform``). The
   transforms are merged by refining their interleave (``merge``): a round reads the transforms in the present interleave and
   deals their symbols out stably, which sorts all suffixes by one symbol more; where a class splits, the round is the
   common prefix. After ``depth`` rounds the unsplit stretches are the repeated intervals of the block.
2. Across blocks intervals are refined in an exchange: each sends its key (its phrases, and the bytes that all windows of an anchor
   have in common) once, with a hash of its stretch, all bytes of the anchor's windows. Stretches that stand twice are settled.
3. Where one interval has several stretches, their windows meet in a second exchange, byte by byte offset, and those that
   stand twice are settled. These are the ends of repeats, a few windows for each.

Strings are told by 64 bits of two hashes each, or 64 of one, 24 of the other and the bucket for single windows.

Most passages of a little over 50 words are shorter than a window of 400 bytes. Where they are asked for, all texts are read with
the shortest string that the method tells for sure, and then, with the window, those texts that such strings cover for its length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import exchange as X
from confluo.llm.common import ID, KEY, TEXT, cut, id_type, narrow, release, row_key

WINDOW, GRAM, SPAN = 400, 16, 64
#: Bytes of a passage: as few as hold an anchor's stretch and a phrase.
PASSAGE = 3 * SPAN + GRAM - 2
#: Bytes of text of a block (one document may be longer), shards of a block, bytes that are hashed at once.
BLOCK, SHARDS, PIECE = 1 << 23, 4, 1 << 20
LAST = np.iinfo(np.int64).max
LOW = np.uint64(0xFFFFFFFF)


def depth_of(window: int) -> int:
    """Phrases that any window shares beside its anchor."""
    return (window + 2 - 2 * SPAN - GRAM) // SPAN


@functools.cache
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of a base and of its inverse up to a piece and a window's length."""
    rnd = np.random.default_rng(seed)
    letters = rnd.integers(1, 1 << 63, 256, np.uint64)
    base = int(rnd.integers(1, 1 << 62)) * 2 + 1
    back, n = pow(base, -1, 1 << 64), PIECE + 4096
    powers = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    return letters, powers(base), powers(back)


def hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each text[start:end]; ``start`` ascending, none longer than 4,096 bytes."""
    letters, up, down = _tables(seed)
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = int(np.searchsorted(start, base + PIECE))
        part = text[base : int(end[lo:hi].max())]
        sums = np.r_[np.uint64(0), np.cumsum(letters[part] * up[: len(part)])]
        i, j = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64)
        lo = hi
    return X.stir(out)


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, first, last): the anchors of documents that lie end to end, with the places whose stretch each is the anchor of."""
    letters, reach = _tables(1)[0], SPAN + GRAM - 1
    place, first = [], []
    for a in range(0, max(0, len(text) - reach + 1), PIECE):
        part = text[a : a + PIECE + reach - 1]
        h, k = letters[part], 1
        while k < GRAM:
            h = h[:-k] * (X.M1 + np.uint64(2 * k)) + h[k:]
            k *= 2
        h = ((h ^ (h >> np.uint64(31))) * X.M2 & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64))
        k = 1
        while k < SPAN:
            h = np.minimum(h[:-k], h[k:])
            k *= 2
        m = (LOW - (h & LOW)).astype(np.int64) + a
        new = np.flatnonzero(np.r_[not place or place[-1][-1] != m[0], m[1:] != m[:-1]])
        if len(new):
            place.append(m[new])
            first.append(new + a)
    if not place:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, lo = np.concatenate(place), np.concatenate(first)
    hi = np.r_[lo[1:] - 1, len(text) - reach]
    doc = np.searchsorted(ends, at, "right")
    begins = np.r_[0, ends[:-1]]
    lo, hi = np.maximum(lo, begins[doc]), np.minimum(hi, ends[doc] - reach)
    ok = lo <= hi
    return doc[ok], at[ok], lo[ok], hi[ok]


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first symbols, at least ``depth``, and the symbol before each); the shard is read as a ring."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < depth:
        rank = np.unique(rank * len(symbols) + np.roll(rank, -h), return_inverse=True)[1]
        h *= 2
    order = np.argsort(rank, kind="stable")
    return order, symbols[order - 1]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, suffix, common): the shards' suffixes in one order by their first ``depth`` symbols, and the symbols that each
    shares with the one before it, if fewer than ``depth``, else ``depth``."""
    sizes = np.array([len(s[0]) for s in shards])
    base = np.cumsum(sizes) - sizes
    order, before = np.concatenate([s[0] for s in shards]), np.concatenate([s[1] for s in shards])
    shard = np.repeat(np.arange(len(shards)), sizes)
    common, same = np.full(len(shard), depth), np.zeros(len(shard), np.int64)

    def read() -> np.ndarray:
        """Where the interleave's entries stand in their shards' orders: each shard is read from its first on."""
        at = np.empty(len(shard), np.int64)
        at[np.argsort(shard, kind="stable")] = np.arange(len(shard))
        return at

    for k in range(depth):
        symbol = before[read()]
        dealt = np.argsort(symbol, kind="stable")
        shard, symbol, same = shard[dealt], symbol[dealt], same[dealt]
        split = np.r_[True, (symbol[1:] != symbol[:-1]) | (same[1:] != same[:-1])]
        common[split & (common == depth)] = k
        same = np.cumsum(split)
    return shard, order[read()], common


class Block:
    """Documents that lie end to end, their anchors and phrases."""

    def __init__(self, rows: list[tuple[int, int, bytes]], window: int):
        self.ids, self.keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.text = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        self.ends, self.window = np.cumsum(sizes), window
        self.begins = self.ends - sizes
        self.doc, self.place, self.first, self.last = anchors(self.text, self.ends)
        #: The last window of each anchor; anchors without windows are only symbols.
        self.upto = np.minimum(self.last, self.ends[self.doc] - window)
        self.number = np.int64(np.uint64(X.xxh3_64_intdigest(self.ids.tobytes() + self.keys.tobytes() + sizes.tobytes())))
        self.counts = np.bincount(self.doc, minlength=len(rows)) if len(self.doc) else np.zeros(len(rows), np.int64)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, interval, key, stretch) of the anchors with windows, in the merged order of their suffixes."""
        depth, n = depth_of(self.window), len(self.place)
        ends_doc = np.r_[self.doc[1:] != self.doc[:-1], True][:n]
        inner = np.flatnonzero(~ends_doc)
        symbol = np.zeros(n, np.uint64)
        symbol[inner] = hashes(self.text, self.place[inner], self.place[inner + 1], 2) | np.uint64(1)  # 0 ends a document
        cuts = [0, *(int(np.searchsorted(self.doc, self.doc[min(n - 1, n * k // SHARDS)])) for k in range(1, SHARDS)), n]
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        shard, suffix, common = merge([transform(symbol[a:b], depth) for a, b in parts], depth)
        anchor = suffix + np.array([a for a, _ in parts])[shard]
        interval = np.cumsum(common < depth)
        ok = self.upto[anchor] >= self.first[anchor]
        anchor, interval = anchor[ok], interval[ok]
        key = np.zeros(len(anchor), np.uint64)
        for k in range(depth):
            key = X.stir(key * X.M1 + symbol[anchor + k])
        by = np.sort(anchor)
        back = np.searchsorted(by, anchor)
        # What all windows of an anchor have: from it up to the end of the earliest one that may be.
        shared = hashes(self.text, self.place[by], self.place[by] + self.window - SPAN + 1, 2)[back]
        lo, hi = self.first[by], self.upto[by]
        shape = ((self.place[by] - lo) * SPAN + (hi - lo)).astype(np.uint64)
        stretch = X.stir(hashes(self.text, lo, hi + self.window, 3) * X.M2 + shape)[back]
        return anchor, interval, X.stir(key * X.M3 + shared), stretch


def blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Block, list[bytes]]]:
    """Blocks of the rows (ID, KEY, TEXT[, more]) with a window or more, each with the rows' fourth column."""
    rows, more, size = [], [], 0
    for b in batches:
        fourth = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for i, key, text, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), fourth):
            if len(text or b"") < window:
                continue
            if rows and size + len(text) > BLOCK:
                yield Block(rows, window), more
                rows, more, size = [], [], 0
            rows.append((LAST if i is None else i, key, text))
            more.append(x)
            size += len(text)
    if rows:
        yield Block(rows, window), more


def heads(block: Block, units: np.ndarray, n_buckets: int, per: int) -> list[tuple]:
    """What the block's home bucket must know: its documents' ids, keys and numbers of units."""
    owner = np.full(len(units), block.number)
    bucket, nth = X.spread(owner, n_buckets), np.arange(len(units))
    return X.pack(2, block.keys.view(np.uint64), owner, block.ids, nth, bucket, per) + X.pack(3, units.astype(np.uint64), owner, owner, nth, bucket, per)


def home(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(id, key, first unit, units, replies) for each document of the bucket's blocks with replies; units count from the document's first."""
    keys, blocks_, ids, nth, _ = X.unpack(table, 2)
    units, _, _, _, _ = X.unpack(table, 3)
    reply, owner, _, at, _ = X.unpack(table, 1)
    order = np.lexsort((reply, at, owner))
    reply, owner, at = reply[order].astype(np.int64), owner[order], at[order]
    for s, e in zip(*X.slices(owner)):
        mine = np.flatnonzero(blocks_ == owner[s])
        mine = mine[np.argsort(nth[mine], kind="stable")]
        # Blocks of equal rows have one number and equal documents; one copy of them is enough.
        mine = mine[np.r_[True, nth[mine][1:] != nth[mine][:-1]]]
        ends = np.cumsum(units[mine].astype(np.int64))
        doc = np.searchsorted(ends, at[s:e], "right")
        for i, j in zip(*X.slices(doc)):
            k = mine[doc[i]]
            start = ends[doc[i]] - int(units[k])
            yield int(ids[k]), int(keys[k].view(np.int64)), int(start), at[s + i : s + j] - start, reply[s + i : s + j]


SETTLED, OPEN, MODEL = 1, 2, 3


def repeated_intervals(d: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(doc, key, settled, models): packed numbers of anchors. Settled anchors' stretches stand twice; an anchor of an open
    interval comes as -1 - number; ``models`` are settled ones that open ones must be compared with, one for each stretch."""
    per = X.per_row(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches, window):
            anchor, interval, key, stretch = block.intervals()
            order = np.lexsort((anchor, stretch, interval))
            anchor, interval, key, stretch = anchor[order], interval[order], key[order], stretch[order]
            new = np.r_[True, (interval[1:] != interval[:-1]) | (stretch[1:] != stretch[:-1]) | (key[1:] != key[:-1])][: len(order)]
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(order)])
            here = lambda k: np.full(k, block.number)
            twice = anchor[np.repeat(size, size) > 1]
            out = heads(block, block.counts, n_buckets, per)
            out += X.pack(1, np.full(len(twice), SETTLED, np.uint64), here(len(twice)), here(len(twice)), twice, X.spread(here(len(twice)), n_buckets), per)
            bucket = (X.stir(key[starts] * X.M3) % np.uint64(n_buckets)).astype(np.int64)
            yield X.rows(out + X.pack(0, key[starts], here(len(starts)), stretch[starts].view(np.int64), 2 * anchor[starts] + (size > 1), bucket, per))
        release()

    def find(table: pa.Table) -> pa.Table:
        release()
        key, owner, stretch, at, _ = X.unpack(table, 0)
        order = np.lexsort((stretch, key))
        key, owner, stretch, at = key[order], owner[order], stretch[order], at[order]
        class_starts, class_ends = X.slices(key)
        new = np.r_[True, (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])][: len(key)]
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(key)])
        count = np.add.reduceat(1 + (at & 1), starts) if len(starts) else starts
        # Whether an entry's class has several stretches, and its stretch stands twice.
        kinds = np.add.reduceat(new.astype(np.int64), class_starts) if len(class_starts) else class_starts
        several = np.repeat(kinds > 1, class_ends - class_starts)
        settled = np.repeat(count > 1, size)
        out = []
        for reply, pick in ((SETTLED, settled & (at & 1 == 0)), (OPEN, several & ~settled), (MODEL, several & settled & new)):
            w = np.flatnonzero(pick)
            out += X.pack(1, np.full(len(w), reply, np.uint64), owner[w], owner[w], at[w] >> 1, X.spread(owner[w], n_buckets), per)
        return pa.concat_tables([X.of_kind(table, 1, 2, 3), pa.Table.from_batches([X.rows(out)])])

    def gather(table: pa.Table) -> pa.Table:
        release()
        rows = []
        for i, key, _, unit, reply in home(table):
            held = np.r_[unit[reply == SETTLED], -1 - unit[reply == OPEN]]
            models = unit[reply == MODEL]
            rows.append((i, key, np.unique(held).tobytes(), np.unique(models).tobytes() if len(models) else None))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc", "key", "settled", "models"])

    found = X.exchange(d.mapInArrow(send, X.SCHEMA), n_buckets, find, gather, "doc long, key long, settled binary, models binary")
    # Equal rows have equal settled anchors; a stretch's model stands in one of them.
    models = F.array_join(F.transform(F.collect_list("models"), lambda x: F.hex(x)), "")
    return found.groupBy("doc", "key").agg(F.max("settled").alias("settled"), F.unhex(models).alias("models"))


def repeated_ranges(d: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(doc, key, ranges, longest): packed (first byte, end) of all that repeated windows cover, and the bytes of the longest
    range; ``d`` has rows of ``repeated_intervals`` as its fourth column, a struct of settled and models."""
    per = X.per_row(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in blocks(batches, window):
            n = len(found)
            at = np.cumsum(block.counts) - block.counts
            lists: list[list[np.ndarray]] = [[], [], []]
            for k, f in enumerate(found):
                held = np.frombuffer(f["settled"] or b"", np.int64)
                for out, x in zip(lists, (held[held >= 0], -1 - held[held < 0], np.frombuffer(f["models"] or b"", np.int64))):
                    out.append(x + at[k])
            settled, open_, models = (np.sort(np.concatenate(x)) if n else np.zeros(0, np.int64) for x in lists)
            here = lambda k: np.full(k, block.number)
            own = lambda k: (here(k), here(k))
            out = heads(block, block.ends - block.begins, n_buckets, per)
            ends = block.upto[settled] + window
            out += X.pack(1, ends.astype(np.uint64), *own(len(settled)), block.first[settled], X.spread(here(len(settled)), n_buckets), per)
            each = np.r_[open_, models]
            asks = np.r_[np.ones(len(open_), np.int64), np.zeros(len(models), np.int64)]
            by = np.argsort(each, kind="stable")
            each, asks = each[by], asks[by]
            size = block.upto[each] - block.first[each] + 1
            s = np.repeat(block.first[each] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            offset = (np.repeat(block.place[each], size) - s).astype(np.uint64)
            order = np.argsort(s, kind="stable")
            s, offset, asks = s[order], offset[order], np.repeat(asks, size)[order]
            value = X.stir(hashes(block.text, s, s + window, 2) * X.M1 + offset)
            second = hashes(block.text, s, s + window, 3)
            # A window that stands twice in the block is settled here and sent once, for the others.
            order = np.lexsort((s, second, value))
            s, asks, value, second = s[order], asks[order], value[order], second[order]
            new = np.r_[True, (value[1:] != value[:-1]) | (second[1:] != second[:-1])][: len(s)]
            size = np.diff(np.r_[np.flatnonzero(new), len(s)])
            twice = np.repeat(size > 1, size)
            mine = np.sort(s[twice & (asks == 1)])
            out += X.pack(1, (mine + window).astype(np.uint64), *own(len(mine)), mine, X.spread(here(len(mine)), n_buckets), per)
            s, asks, value, second = s[new], np.where(twice, 0, asks)[new], value[new], second[new]
            mark = (second >> np.uint64(40)).astype(np.int64)
            bucket = (second % np.uint64(n_buckets)).astype(np.int64)
            yield X.rows(out + X.pack(0, value, here(len(s)), mark, 2 * s + asks, bucket, per))
        release()

    def find(table: pa.Table) -> pa.Table:
        release()
        value, owner, mark, at, _ = X.unpack(table, 0)
        order = np.lexsort((mark, value))
        value, owner, mark, at = value[order], owner[order], mark[order], at[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (mark[1:] != mark[:-1])][: len(value)]
        size = np.diff(np.r_[np.flatnonzero(new), len(value)])
        w = np.flatnonzero((np.repeat(size, size) > 1) & (at & 1 == 1))
        s = at[w] >> 1
        out = X.pack(1, (s + window).astype(np.uint64), owner[w], owner[w], s, X.spread(owner[w], n_buckets), per)
        return pa.concat_tables([X.of_kind(table, 1, 2, 3), pa.Table.from_batches([X.rows(out)])])

    def gather(table: pa.Table) -> pa.Table:
        release()
        rows = []
        for i, key, begin, first, end in home(table):
            end = np.maximum.accumulate(end - begin)
            gap = np.flatnonzero(first[1:] > end[:-1])
            spans = np.stack([np.r_[first[0], first[gap + 1]], np.r_[end[gap], end[-1]]], axis=1)
            rows.append((i, key, spans.tobytes(), int((spans[:, 1] - spans[:, 0]).max())))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["doc", "key", "ranges", "longest"])

    found = X.exchange(d.mapInArrow(send, X.SCHEMA), n_buckets, find, gather, "doc long, key long, ranges binary, longest long")
    return found.groupBy("doc", "key").agg(F.max("ranges").alias("ranges"), F.max("longest").alias("longest"))


def covered(numbered: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(doc, key, ranges, longest) of the rows (ID, KEY, TEXT) in which windows stand that also start elsewhere."""
    found = repeated_intervals(numbered, n_buckets, window)
    return repeated_ranges(numbered.join(found, own_row()).select(ID, KEY, TEXT, F.struct("settled", "models").alias("found")), n_buckets, window)


def own_row() -> Column:
    """A row's own (doc, key)."""
    return (F.coalesce(ID, F.lit(int(LAST))) == F.col("doc")) & (F.col(KEY) == F.col("key"))


def dedup_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True, passage: int | None = None
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept][, n_repeated]) for each row: its text without the bytes that a
    string of ``window`` bytes covers which also starts elsewhere, in the row or in another.

    ``spans`` are the maximal removed runs as (start, bytes), ``kept`` the bytes left. A null text is empty; a text shorter than a
    window loses nothing; repeated rows, rows of one id and rows without an id are documents of their own, so both copies
    of a text go; an empty table gives no rows; other columns are ignored. The id is an integer. ``window`` is 206 or more (a
    phrase must lie in each). With ``passage``, 206 or more and at most ``window``, ``n_repeated`` counts the bytes that such shorter
    strings cover which also start elsewhere; they stay in the text.
    """
    if depth_of(min(window, passage or window)) < 1:
        raise ValueError("a window must hold an anchor's stretch and a phrase")
    if passage and passage > window:
        raise ValueError("a passage is no longer than a window")
    d = narrow(docs, id_col, text_col).withColumn(KEY, row_key(F.col(ID), F.col(TEXT)))
    n_buckets = X.buckets_for(d)
    numbered = d.select(F.col(ID).cast("long").alias(ID), KEY, TEXT)
    if passage:
        passages = cut(covered(numbered, n_buckets, passage))
        # Each passage in a repeated window is repeated too, so only a range of a window's length holds one, here and elsewhere.
        long = numbered.join(passages.where(F.col("longest") >= window), own_row(), "left_semi")
        removed = covered(long, n_buckets, window).select("doc", "key", F.col("ranges").alias("removed"))
        found = passages.join(removed, ["doc", "key"], "left").select("doc", "key", "removed", "ranges")
    else:
        found = covered(numbered, n_buckets, window).select("doc", "key", F.col("ranges").alias("removed"), F.lit(None).cast("binary").alias("ranges"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, packed, again in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text, cuts = text or b"", np.frombuffer(packed or b"", np.int64).reshape(-1, 2).tolist()
                left, end = [], 0
                for s, e in cuts:
                    left.append(text[end:s])
                    end = e
                kept = b"".join([*left, text[end:]])
                full = ([{"start": s, "bytes": e - s} for s, e in cuts], kept) if texts else (None, None)
                repeated = int(np.diff(np.frombuffer(again or b"", np.int64).reshape(-1, 2)).sum())
                rows.append((len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), *full, repeated))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [*[pa.int64()] * 3, pa.string(), span, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    kind = id_type(docs, id_col)
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, bytes: long>>, kept binary, n_repeated long"
    out = numbered.join(found, own_row(), "left").select(F.col(ID).cast(kind).alias(ID), TEXT, "removed", "ranges").mapInArrow(run, schema)
    return out.drop(*([] if texts else ["spans", "kept"]), *([] if passage else ["n_repeated"]))
