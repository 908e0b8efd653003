"""Packed exchange of word-window hashes: each task sends one row of arrays a bucket instead of a row a window.

A task first settles what it can by itself, over chunks of ``CHUNK`` windows, so a window that very many rows share
leaves each chunk once. A bucket holds about ``PER_BUCKET`` windows. Where there are more than ``COARSE`` buckets the
exchange has two levels: chunks are packed by coarse buckets, and tasks that hold one coarse bucket pack what they get anew,
CHUNK windows at once, so a packed row has CHUNK / COARSE windows or more however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from confluo.llm.common import cyclic_parts, release, text_bytes

CHUNK, PER_BUCKET, BYTES_A_WORD, COARSE = 1 << 20, 1 << 21, 6, 4096
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: A packed row: bucket, kind, and equally long arrays: a 64-bit value, its owner, a mark, a place, and the final bucket.
NAMES = ["bucket", "kind", "value", "owner", "mark", "at", "fine"]
SCHEMA = "bucket int, kind int, value binary, owner binary, mark binary, at binary, fine binary"


def stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def windows(codes: np.ndarray, k: int, factor: np.uint64 = M1) -> np.ndarray:
    """A 64-bit hash of each k-word window; another factor gives independent bits."""
    m = len(codes) - k + 1
    h = np.zeros(max(0, m), np.uint64)
    for j in range(k if m > 0 else 0):
        h = h * factor + codes[j : j + m]
    return stir(h)


def buckets_for(d: DataFrame) -> int:
    return cyclic_parts(d.sparkSession, text_bytes(d), PER_BUCKET * BYTES_A_WORD)


def spread(owner: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket where an owner gathers its replies."""
    return (stir(owner.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def slices(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(key)] if len(key) else starts


def squeeze(x: np.ndarray) -> bytes:
    """Compressed byte planes of the differences; one number where all are equal."""
    if (x == x[0]).all():
        return x[:1].tobytes()
    step = np.diff(x.view(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def swell(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8:
        return np.broadcast_to(np.frombuffer(raw, np.int64), n)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, n)
    return np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def pack(kind: int, value: np.ndarray, owner: np.ndarray, mark: np.ndarray, at: np.ndarray, bucket: np.ndarray, per: int) -> list[tuple]:
    """Packed rows of entries, one for ``per`` neighbouring buckets, each in order of owner, place."""
    coarse = bucket // per
    order = np.lexsort((at, owner, coarse))
    coarse = coarse[order]
    starts, ends = slices(coarse)
    coarse, columns = coarse[starts].tolist(), [value, owner, mark, at, bucket]
    del value, owner, mark, at, bucket
    out = []
    for k in range(len(columns)):  # one sorted copy at a time
        x, columns[k] = columns[k][order], None
        out.append([(squeeze(x[s:e]) if k else x[s:e].tobytes()) for s, e in zip(starts, ends)])
    return [(c, kind, *row) for c, *row in zip(coarse, *out)]


def of_kind(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pa.array([k in kinds for k in table.column("kind").to_pylist()], pa.bool_())).select(NAMES)


def unpack(table: pa.Table, kind: int, need: tuple[str, ...] = tuple(NAMES[2:])) -> tuple[np.ndarray | None, ...]:
    """(value, owner, mark, at, bucket) of all packed rows of a kind, one row after another; None for what isn't needed.

    A packed row is read where it lies and unpacked into its place, so nothing is held twice.
    """
    mine = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    raw = {x: table.column(x) for x in NAMES[2:]}
    n = [len(raw["value"][i].as_buffer()) // 8 for i in mine]
    ends = np.cumsum(n, dtype=np.int64).tolist()
    out = []
    for x in NAMES[2:]:
        col = np.empty(sum(n), np.uint64 if x == "value" else np.int64) if x in need else None
        for i, k, e in zip(mine, n, ends) if col is not None else ():
            buffer = raw[x][i].as_buffer()
            col[e - k : e] = np.frombuffer(buffer, np.uint64) if x == "value" else swell(buffer, k)
        out.append(col)
    return tuple(out)


def parts(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of hashes, dealt by their upper halves into parts of about ``size``: equal ones in one part, in their order."""
    n = min(1 << 16, -(-len(h) // size))
    half = np.uint64(32)
    kind = ((h >> half) * np.uint64(n) >> half).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=n)).tolist() if n else []
    for s, e in zip([0, *ends], ends):
        yield order[s:e]


def rows(items: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*items)) if items else [()] * len(NAMES)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=NAMES)


def per_row(n_buckets: int) -> int:
    """Buckets that one packed row of a chunk holds: 1, or so many that there are COARSE rows at most."""
    return -(-n_buckets // COARSE)


def delivered(sent: DataFrame, n_buckets: int) -> DataFrame:
    """``sent``, packed by buckets: as it is, or coarse rows packed anew."""
    if per_row(n_buckets) == 1:
        return sent

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def anew() -> pa.RecordBatch:
            table, out = pa.Table.from_batches(held), []
            for kind in sorted(set(table.column("kind").to_pylist())):
                out += pack(kind, *unpack(table, kind), 1)
            return rows(out)

        for b in batches:
            for i in range(b.num_rows):
                held.append(b.slice(i, 1))
                size += len(b.column(2)[i].as_py()) // 8
                if size >= CHUNK:
                    yield anew()
                    held, size = [], 0
        if held:
            yield anew()
        held = None
        release()

    return sent.repartition(min(n_buckets, COARSE), "bucket").sortWithinPartitions("bucket").mapInArrow(split, SCHEMA)


def exchange(sent: DataFrame, n_buckets: int, find: Callable[[pa.Table], pa.Table], gather: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``find`` meets the windows of a bucket and replies, ``gather`` the replies of a bucket of owners."""
    found = delivered(sent, n_buckets).groupBy("bucket").applyInArrow(find, SCHEMA)
    return delivered(found, n_buckets).groupBy("bucket").applyInArrow(gather, schema)
