"""Tables that are written a micro-batch at a time: each batch has a folder of its own and a record that it is whole.

A batch that runs again, after a failure or with another plan, replaces its folders, and readers take committed batches only,
so every row is there once however often its batch ran. (foreachBatch alone is at least once.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

COMMITS = "commits"


def put(rows: DataFrame, root: str, name: str, batch: int, *by: str) -> str:
    """Write a table's rows of a batch, in folders by the columns ``by``; nobody reads them before the batch is committed."""
    path = f"{root}/{name}/batch={batch}"
    dealt = rows.repartition(*by) if by else rows  # one task a folder, so that none has many small files
    dealt.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def commit(spark: SparkSession, root: str, batch: int) -> None:
    """Record that all tables of a batch are there."""
    spark.range(1).select("id").coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/batch={batch}")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with its batch; empty where nothing was ever written."""
    whole = StructType([*schema.fields]).add("batch", LongType())
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def committed(spark: SparkSession, root: str, name: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All rows of committed batches, those before ``before`` if it is given, with the batch that wrote them."""
    done = _read(spark, f"{root}/{COMMITS}", StructType().add("id", LongType())).select("batch").distinct()
    rows = _read(spark, f"{root}/{name}", schema).join(F.broadcast(done), "batch", "left_semi")
    return rows if before is None else rows.where(F.col("batch") < before)


def two_channels(root: str, good: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows that are ``good`` go to the table 'data', all others, null verdicts too, to 'monitoring'; both of a
    batch become visible together."""

    def each(rows: DataFrame, batch: int) -> None:
        spark, fine = rows.sparkSession, F.coalesce(good, F.lit(False))
        kept = rows.persist()
        try:
            put(kept.where(fine), root, "data", batch)
            put(kept.where(~fine), root, "monitoring", batch)
            commit(spark, root, batch)
        finally:
            kept.unpersist()

    return each
