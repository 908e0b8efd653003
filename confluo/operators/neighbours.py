"""Exact nearest neighbours by pivots: vectors lie in cells around a few of them, and a query meets the cells that may hold a neighbour.

A cell is a ring of distances around a pivot, cut into parts of PART_ROWS vectors or so by a hash of the id, so a pivot with a third
of all rows is many parts. By the triangle inequality a query at distance d from the pivot is at least d - hi and lo - d from
each vector of the ring [lo, hi], and at most d + hi. A query first meets the rings that are sure to hold k
vectors near it; the k-th distance found there is a bound, and then it meets all other rings that the bound doesn't exclude.
Queries are rows that are joined to parts: none goes through the driver. A task holds one part and TILE distances; a ring that very many queries ask
for is copied, and each copy meets ASK_ROWS of them or so.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pivots and rings of a pivot at most (their statistics are what the driver gets), vectors of a part, queries that a copy of a part
#: meets, distances held at once.
PIVOTS, RINGS, PART_ROWS, ASK_ROWS, TILE = 256, 4, 1 << 15, 1 << 15, 1 << 21
#: Distances are told apart by six digits; bounds leave room for that and for rounding errors.
DIGITS, ROOM = 6, 1e-5


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % parts.astype(np.uint64)).astype(np.int64)


class Cells:
    """The pivots and, for each ring with vectors, its pivot, number, nearest and farthest distance, and parts."""

    def __init__(self, pivots: np.ndarray, spans: np.ndarray, rings: np.ndarray):
        self.pivots, self.spans = pivots, spans  # spans: a pivot's least and largest distance
        self.pivot, self.ring, self.count = (rings[:, k].astype(np.int64) for k in range(3))
        self.lo, self.hi = rings[:, 3], rings[:, 4]
        self.parts = -(-self.count // PART_ROWS)
        self.number = np.full((len(pivots), RINGS), -1, np.int64)
        self.number[self.pivot, self.ring] = np.arange(len(self.pivot))

    def home(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each vector."""
        step = max(1, TILE // max(1, len(self.pivots)))
        near, far = [], []
        for k in range(0, len(v), step):
            d = _squared(v[k : k + step], self.pivots)
            near.append(d.argmin(1))
            far.append(np.sqrt(d.min(1)))
        return (np.concatenate(near), np.concatenate(far)) if near else (np.zeros(0, np.int64), np.zeros(0))

    def rings_of(self, pivot: np.ndarray, far: np.ndarray) -> np.ndarray:
        lo, hi = self.spans[pivot, 0], self.spans[pivot, 1]
        return np.minimum(RINGS - 1, (far - lo) / np.where(hi > lo, hi - lo, 1) * RINGS).astype(np.int64)

    def asked(self, q: np.ndarray, k: int, bound: np.ndarray | None) -> Iterator[np.ndarray]:
        """For each query the rings it meets: without bounds those that are sure to hold k near vectors, else all others that are
        within the bound (squared)."""
        step = max(1, TILE // max(1, len(self.pivot)))
        for s in range(0, len(q), step):
            d = np.sqrt(_squared(q[s : s + step], self.pivots))[:, self.pivot]
            order = np.argsort(d + self.hi, axis=1, kind="stable")
            before = np.cumsum(self.count[order], axis=1) - self.count[order]
            sure = np.zeros(d.shape, bool)
            np.put_along_axis(sure, order, before < k, axis=1)
            if bound is None:
                yield from map(np.flatnonzero, sure)
            else:
                least = np.maximum(0.0, np.maximum(d - self.hi, self.lo - d))
                within = least <= np.sqrt(bound[s : s + step] + ROOM)[:, None] + ROOM
                yield from map(np.flatnonzero, within & ~sure)


def cells(vecs: DataFrame) -> Cells | None:
    """Pivots (vectors of the smallest hashes of their ids: sqrt(n) / 4 of n, PIVOTS at most) and the rings' statistics."""
    n = vecs.count()
    if not n:
        return None
    many = max(1, min(PIVOTS, isqrt(n) // 4))
    rows = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).select("v").collect()
    c = Cells(np.array([r[0] for r in rows], float), np.zeros((many, 2)), np.zeros((0, 5)))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, d = c.home(_matrix(b.column(0), b.num_rows))
            ring = c.rings_of(pivot, d)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pivot.astype(np.int64), ring, d)], names=["pivot", "ring", "d"])

    measured = lambda: vecs.select("v").mapInArrow(far, "pivot long, ring long, d double")
    for r in measured().groupBy("pivot").agg(F.min("d"), F.max("d")).collect():
        c.spans[r[0]] = r[1:]
    stats = measured().groupBy("pivot", "ring").agg(F.count("*"), F.min("d"), F.max("d")).orderBy("pivot", "ring").collect()
    return Cells(c.pivots, c.spans, np.array([tuple(r) for r in stats], float).reshape(-1, 5))


def _met(v: np.ndarray, ids: np.ndarray, q: np.ndarray, asks: np.ndarray, k: int | None, bound: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, id, distance): the k nearest of a part for each query, those beyond its bound left out, or all within it; TILE distances
    at once."""
    step = max(1, TILE // max(1, len(ids)))
    most = min(k, len(ids)) if k is not None else 0
    for s in range(0, len(asks), step):
        if k is None:
            d = _squared(q[s : s + step], v)
            row, col = np.nonzero(d <= bound[s : s + step, None])
            yield asks[s : s + step][row], ids[col], d[row, col]
            continue
        d = np.round(_squared(q[s : s + step], v), DIGITS)
        last = np.partition(d, most - 1, axis=1)[:, most - 1]
        row, col = np.nonzero(d <= np.minimum(last, bound[s : s + step] + ROOM)[:, None])
        order = np.lexsort((ids[col], d[row, col], row))
        row, col = row[order], col[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        keep = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < k
        yield asks[s : s + step][row[keep]], ids[col[keep]], d[row[keep], col[keep]]


def _search(placed: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """(query_id, vec_id, d): for each query and part that it meets the k nearest, or all within its bound."""
    # One row a ring, so at most PIVOTS * RINGS of them.
    hot = {r[0]: -(-r[1] // ASK_ROWS) for r in asked.where("part = 0").groupBy("cell").count().where(F.col("count") > ASK_ROWS).collect()}
    copies = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("cell")), F.lit(1)) if hot else F.lit(1)
    every = F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("copy")
    one = F.pmod(F.xxhash64("id"), copies).cast("int").alias("copy")
    tables = [x.select("cell", "part", copy, F.lit(kind).alias("kind"), "id", "v", bound.alias("bound")) for x, copy, kind, bound in ((placed, every, 0, F.lit(None).cast("double")), (asked, one, 1, F.col("bound")))]
    dealt = tables[0].unionByName(tables[1]).repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vecs = None, [], []
        for b in batches:
            cell, part, copy, kind = places = [b.column(x).to_numpy(zero_copy_only=False) for x in range(4)]
            new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in places], axis=0)][: len(cell)])
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(cell)]):
                if (cell[s], part[s], copy[s]) != here:
                    here, ids, vecs = (cell[s], part[s], copy[s]), [], []
                own, v = b.column(4)[s:e].to_numpy(zero_copy_only=False), _matrix(b.column(5)[s:e], e - s)
                if kind[s] == 0:
                    ids.append(own)
                    vecs.append(v)
                elif ids:
                    if len(ids) > 1:
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    bound = np.nan_to_num(b.column(6)[s:e].to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                    for cols in _met(vecs[0], ids[0], v, own, k, bound):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "d"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, d double")


def _known(x: DataFrame) -> DataFrame:
    return x.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null")


def _placed(vecs: DataFrame, c: Cells) -> DataFrame:
    """(cell, part, id, v): each vector in its part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, d = c.home(_matrix(b.column(1), b.num_rows))
            cell = c.number[pivot, c.rings_of(pivot, d)]
            part = _part(b.column(0).to_numpy(zero_copy_only=False), c.parts[cell]) if b.num_rows else cell
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(part, pa.int64()), b.column(0), b.column(1)], names=["cell", "part", "id", "v"])

    return vecs.mapInArrow(place, "cell long, part long, id long, v array<double>")


def _asked(queries: DataFrame, c: Cells, k: int) -> DataFrame:
    """(cell, part, id, v, bound): a copy of each query (vec_id, v[, bound]) for each part that it meets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bound = None if b.num_columns < 3 else b.column(2).to_numpy(zero_copy_only=False).astype(float)
            met = list(c.asked(_matrix(b.column(1), b.num_rows), k, bound))
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in met])
            cell = np.concatenate(met) if met else np.zeros(0, np.int64)
            parts = c.parts[cell]
            row, cell = np.repeat(row, parts), np.repeat(cell, parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            bounds = np.full(len(row), np.inf) if bound is None else bound[row]
            # Copies of a query are made some at a time.
            step = max(1, TILE // max(1, len(c.pivots[0])))
            for s in range(0, len(row), step):
                pick = pa.array(row[s : s + step])
                cols = [pa.array(cell[s : s + step]), pa.array(part[s : s + step], pa.int64()), b.column(0).take(pick), b.column(1).take(pick), pa.array(bounds[s : s + step])]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "part", "id", "v", "bound"])

    return queries.mapInArrow(ask, "cell long, part long, id long, v array<double>, bound double")


def nearest(vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, d, rank): the k nearest by squared distance (six digits) of each query, ties by id; all of them where there are fewer.

    ``vecs`` and ``queries`` have rows (vec_id, v); vectors have one length. Rows without an id or a vector aren't met; a query
    is met with itself if it is among the vectors; queries of one id are one query.
    """
    vecs, queries = _known(vecs), _known(queries).dropDuplicates(["vec_id"])
    c = cells(vecs)
    if c is None:
        return vecs.sparkSession.createDataFrame([], "query_id long, vec_id long, d double, rank int")
    placed, line = _placed(vecs, c), W.partitionBy("query_id").orderBy("d", "vec_id")
    best = lambda x: x.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    first = best(_search(placed, _asked(queries, c, k), k))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = queries.join(bounds, queries.vec_id == bounds.query_id).select("vec_id", "v", "bound")
    second = best(_search(placed, _asked(bounded, c, k), k))
    return best(first.unionByName(second).drop("rank"))


def within(vecs: DataFrame, queries: DataFrame, most: float) -> DataFrame:
    """(query_id, vec_id, d): all vectors within a squared distance of each query; only rings that may hold one are met."""
    vecs, queries = _known(vecs), _known(queries).dropDuplicates(["vec_id"])
    c = cells(vecs)
    if c is None:
        return vecs.sparkSession.createDataFrame([], "query_id long, vec_id long, d double")
    return _search(_placed(vecs, c), _asked(queries.withColumn("bound", F.lit(float(most))), c, 0), None)


def nearest_distance(vecs: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, d): the squared distance of each vector from the nearest query; null without queries. Here the queries lie in cells
    and the vectors ask."""
    near = nearest(queries, vecs, 1).select(F.col("query_id").alias("vec_id"), "d")
    return vecs.select("vec_id").join(near, "vec_id", "left")
