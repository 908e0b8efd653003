"""Running sums, last known values and next values along streams of any length: a prefix scan over segments.

A window function holds a stream in one task. Here rows are dealt by ranges of (stream, order), so a long stream is many
segments; each segment's sum, last or first value is one row; a window over these rows, at most as many as there are
segments, gives what a segment takes over from the ones before it or after it; and a window inside a segment does the rest.
Operators take ``parts``: None is the plain window, a number is that many segments of the whole table (``parts_for`` tells which).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.operators.shared import cut

#: Rows of a stream that one task may sort.
LONG = 1 << 22
SEG, CARRY = "__seg", "__carry"


def parts_for(df: DataFrame, key: str, rows: int = LONG) -> int | None:
    """None where no stream has more than ``rows`` rows, else the segments of ``rows`` rows that the table makes."""
    longest, total = df.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    return None if (longest or 0) <= rows else -(-total // rows)


def segments(df: DataFrame, key: str, order: list[Column], parts: int) -> DataFrame:
    """``df`` with its segment's number, ascending along (key, order); written once, as ranges are drawn from a sample."""
    return cut(df.repartitionByRange(parts, F.col(key), *order).withColumn(SEG, F.spark_partition_id()))


def _carried(s: DataFrame, key: str, partial: Column, across: Column) -> DataFrame:
    sums = s.groupBy(key, SEG).agg(partial.alias("__p"))
    return s.join(sums.select(key, SEG, across.alias(CARRY)), [key, SEG])


def running_sum(df: DataFrame, key: str, order: list[Column], value: Column, name: str, parts: int | None = None, itself: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its stream up to each row, the row included or not; 0 before the first."""
    upto = 0 if itself else -1
    line = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    if parts is None:
        return df.withColumn(name, F.coalesce(F.sum(value).over(line), F.lit(0)))
    before = F.sum("__p").over(W.partitionBy(key).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1))
    s = _carried(segments(df.withColumn("__x", value), key, order, parts), key, F.sum("__x"), F.coalesce(before, F.lit(0)))
    inside = W.partitionBy(key, SEG).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    return s.withColumn(name, F.coalesce(F.sum("__x").over(inside), F.lit(0)) + F.col(CARRY)).drop("__x", SEG, CARRY)


def last_known(df: DataFrame, key: str, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the last ``value`` that isn't null among the rows of its stream up to each row."""
    if parts is None:
        line = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(line))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(value).alias("x"))))
    before = F.last("__p", ignorenulls=True).over(W.partitionBy(key).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1))
    s = _carried(segments(df, key, [F.col(c) for c in order], parts), key, last, before["x"])
    inside = W.partitionBy(key, SEG).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return s.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(CARRY))).drop(SEG, CARRY)


def next_value(df: DataFrame, key: str, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``value`` of the next row of its stream, null at the end."""
    if parts is None:
        return df.withColumn(name, F.lead(value).over(W.partitionBy(key).orderBy(*order)))
    first = F.min(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(value).alias("x")))
    after = F.lead("__p").over(W.partitionBy(key).orderBy(SEG))
    s = _carried(segments(df, key, [F.col(c) for c in order], parts), key, first, after["x"])
    row = F.lead(F.struct(value)).over(W.partitionBy(key, SEG).orderBy(*order))
    return s.withColumn(name, F.when(row.isNotNull(), row[value]).otherwise(F.col(CARRY))).drop(SEG, CARRY)
