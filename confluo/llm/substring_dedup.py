"""Substring dedup: relative Lempel-Ziv parsing of each document against the documents before it.

The reference is all documents with smaller ids. It lies in blocks: a block is a chunk of documents, their windows one after
another, and every 13-word window of every block is indexed, by hash, with its place. Each document's windows are looked up in
the whole index; a lookup gives the place of the window in the document of the smallest id that holds it. Where the next
window stands next to it in the same block, the match goes on, so a factor is as long as the lookups go in step: (block,
place, words). A factor holds 13 words or more; where one ends, the windows across its boundary have lookups of their own,
so none is lost. Factors make the duplicate spans.

Within a chunk of documents a window is settled at once and leaves for the index with its smallest document only. A window is
told by 64 bits of hash and, by its bucket, some independent further bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import exchange as X
from confluo.llm.common import ID, KEY, TEXT, id_type, narrow, release

WINDOW = 13
LAST = np.iinfo(np.int64).max


def parse(n_windows: np.ndarray, at: np.ndarray, block: np.ndarray, place: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(document, [first word, words, block, place]) of the factors of a chunk of documents with so many windows each.

    ``at`` are the windows found, in order, numbered through the chunk; ``block`` and ``place`` where they were found. A factor
    goes on while windows of one document stand side by side both here and there.
    """
    ends = np.cumsum(n_windows)
    doc = np.searchsorted(ends, at, "right")
    new = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1)
    s = np.flatnonzero(np.r_[True, new][: len(at)])
    count = np.diff(np.r_[s, len(at)])
    first = at[s] - (ends - n_windows)[doc[s]]
    return doc[s], np.stack([first, count + window - 1, block[s], place[s]], axis=1)


def lookup(d: DataFrame, n_buckets: int, window: int = WINDOW) -> DataFrame:
    """(doc, mark, factors) for each row with factors: packed numbers, four a factor; ``d`` has ID, KEY, TEXT."""
    per = X.per_row(n_buckets)

    def least(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose window also has a smaller id, and for each of them the first entry of the smallest."""
        order = np.argsort(h, kind="stable")
        s, e = X.slices(h[order])
        own = ids[order]
        low = np.repeat(np.minimum.reduceat(own, s), e - s) if len(s) else own
        group = np.repeat(np.arange(len(s)), e - s)
        lows = np.flatnonzero(own == low)
        first = order[lows[np.unique(group[lows], return_index=True)[1]]]
        again = own > low
        return order[again], first[group[again]]

    def settle(chunk: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, marks = np.array([c[0] for c in chunk], np.int64), np.array([c[1] for c in chunk], np.int64)
        n = np.array([len(c[2]) for c in chunk], np.int64)
        block = np.int64(np.uint64(X.xxh3_64_intdigest(ids.tobytes() + marks.tobytes() + n.tobytes())))
        h, h2 = np.concatenate([c[2] for c in chunk]), np.concatenate([c[3] for c in chunk])
        own = np.repeat(ids, n)
        again, first = least(h, own)
        home = lambda k: (np.full(k, block), X.spread(np.full(k, block), n_buckets))
        owner, bucket = home(len(again))
        out = X.pack(1, first.astype(np.uint64), owner, owner, again, bucket, per)
        owner, bucket = home(len(ids))
        heads = marks.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
        out += X.pack(2, heads, owner, ids, np.arange(len(ids)), bucket, per)
        open_ = np.ones(len(h), bool)
        open_[again] = False
        at = np.flatnonzero(open_)
        return X.rows(out + X.pack(0, h[at], home(len(at))[0], own[at], at, (h2[at] % np.uint64(n_buckets)).astype(np.int64), per))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for b in batches:
            for i, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                codes = X.word_codes(words)
                chunk.append((LAST if i is None else i, mark, X.windows(codes, window), X.windows(codes, window, X.M2)))
                size += len(words)
                if size >= X.CHUNK:
                    yield settle(chunk)
                    chunk, size = [], 0
        if chunk:
            yield settle(chunk)
        chunk = None
        release()

    def find(table: pa.Table) -> pa.Table:
        release()
        h, owner, ids, at, _ = X.unpack(table, 0)
        again, first = least(h, ids)
        out = X.pack(1, at[first].astype(np.uint64), owner[again], owner[first], at[again], X.spread(owner[again], n_buckets), per)
        return pa.concat_tables([X.of_kind(table, 1, 2), pa.Table.from_batches([X.rows(out)])])

    def gather(table: pa.Table) -> pa.Table:
        release()
        heads, blocks, ids, nth, _ = X.unpack(table, 2)
        place, owner, there, at, _ = X.unpack(table, 1)
        order = np.lexsort((at, owner))
        place, owner, there, at = place[order].astype(np.int64), owner[order], there[order], at[order]
        docs, marks, packed = [], [], []
        for s, e in zip(*X.slices(owner)):
            mine = np.flatnonzero(blocks == owner[s])
            mine = mine[np.argsort(nth[mine], kind="stable")]
            doc, factors = parse((heads[mine] & np.uint64(0xFFFFFFFF)).astype(np.int64), at[s:e], there[s:e], place[s:e], window)
            for i, j in zip(*X.slices(doc)):
                docs.append(int(ids[mine[doc[i]]]))
                marks.append(int(heads[mine[doc[i]]] >> np.uint64(32)))
                packed.append(factors[i:j].tobytes())
        return pa.table([pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())], names=["doc", "mark", "factors"])

    sent = d.select(F.col(ID).cast("long").alias(ID), F.pmod(F.col(KEY), F.lit(1 << 32)).alias(KEY), TEXT).mapInArrow(send, X.SCHEMA)
    return X.exchange(sent, n_buckets, find, gather, "doc long, mark long, factors binary")


def spans(factors: np.ndarray) -> list[tuple[int, int]]:
    """(first word, words) of each duplicate span: factors, joined where they overlap or touch; ``factors`` in order."""
    if not len(factors):
        return []
    first, last = factors[:, 0], np.maximum.accumulate(factors[:, 0] + factors[:, 1])
    cut = np.flatnonzero(first[1:] > last[:-1])
    return [(int(a), int(b - a)) for a, b in zip(np.r_[first[0], first[cut + 1]], np.r_[last[cut], last[-1]])]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, factors[, kept]) for each row.

    ``spans`` are the duplicate spans as (start, words), ``factors`` the parse: (start, words, block, place), the place a window's
    number in its block; ``kept`` the words left, joined by a space. A null text has no
    words; a null id counts as larger than all others; rows with one id don't count as earlier than each other, whatever their texts; an
    empty table gives no rows; other columns are ignored. The id is an integer.
    """
    from confluo.llm.common import row_key

    d = narrow(docs, id_col, text_col).withColumn(KEY, row_key(F.col(ID), F.col(TEXT)))
    # Equal rows have equal factors.
    found = lookup(d, X.buckets_for(d), window).groupBy("doc", "mark").agg(F.min("factors").alias("factors"))
    doc = F.coalesce(F.col(ID).cast("long"), F.lit(int(LAST)))
    j = d.join(found, (doc == F.col("doc")) & (F.pmod(F.col(KEY), F.lit(1 << 32)) == F.col("mark")), "left").select(ID, TEXT, "factors")

    four = ("start", "words", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, cut, parsed, kept = [], [], [], [], [], []
            for text, packed in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (text or b"").split()
                factors = np.frombuffer(packed or b"", np.int64).reshape(-1, 4)
                mine, left, end = spans(factors), [], 0
                for s, k in mine:
                    left += words[end:s]
                    end = s + k
                left += words[end:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                sha.append(hashlib.sha256(joined).hexdigest())
                cut.append([{"start": s, "words": k} for s, k in mine])
                parsed.append([dict(zip(four, f)) for f in factors.tolist()] if texts else None)
                kept.append(joined.decode("utf-8", "replace") if texts else None)
            two, all_four = (pa.list_(pa.struct([(x, pa.int64()) for x in names])) for names in (four[:2], four))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(cut, two), pa.array(parsed, all_four), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_removed", "kept_sha256", "spans", "factors", "kept"])

    structs = [f"{name} array<struct<{', '.join(f'{x}: long' for x in names)}>>" for name, names in (("spans", four[:2]), ("factors", four))]
    out = j.mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, n_words long, n_removed long, kept_sha256 string, {', '.join(structs)}, kept string")
    return out if texts else out.drop("kept", "factors")
