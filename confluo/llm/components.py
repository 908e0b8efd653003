"""Connected components by alternating large and small stars, each round cut in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import cut

#: Links that a task joins at once before the first round; copies of a node's minimum that its neighbours may meet.
CHUNK, SALTS = 1 << 20, 8


def forests(links: DataFrame) -> DataFrame:
    """Links of the same components, at most one for each node of a task's chunk: each to the least node its chunk joins it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def settled() -> pa.RecordBatch:
            got = [(x, root(x)) for x in list(above)]
            got = [g for g in got if g[0] != g[1]]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
            if len(above) > CHUNK:
                yield settled()
        yield settled()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long) that has a link; the component is its least node.

    Nothing is collected; a node with very many links meets them in grouped minima and in salted joins, never in one list.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
    edges = cut(forests(links.where("a <> b")).distinct())
    measure = lambda e: e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    total = measure(edges)
    for _ in range(rounds if total[0] else 0):
        down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.unionByName(down)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select("a", "m", salts)
        # Large star: each larger neighbour links to the node's least neighbour.
        large = down.select("a", "b", salt).join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each smaller neighbour, and the node, links to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
        edges = cut(large.join(low, "a").select(starred.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = measure(edges)
        if now == total:
            break
        total = now
    else:
        if total[0]:
            raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
