"""Request health: outcome counts by plugin and model, a minute or a stream, from one grouping-sets pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(ok: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * ok, total), 2), F.lit(0.0))


def _counts() -> list[Column]:
    fail = lambda kind: F.count_if(F.col("failure_type") == kind).alias(kind)
    return [F.count("*").alias("total"), F.count_if("success").alias("ok"), fail("parse_failure"), fail("timeout_failure"), fail("truncation_failure")]


def by(requests: DataFrame, *keys: str) -> DataFrame:
    return requests.groupBy(*keys).agg(*_counts()).withColumn("rate", percent(F.col("ok"), F.col("total")))


def breakdowns(requests: DataFrame) -> DataFrame:
    """By plugin, by model type and in all, in one pass."""
    g = requests.groupingSets([["plugin"], ["model_type"], []], "plugin", "model_type")
    return g.agg(*_counts()).withColumn("rate", percent(F.col("ok"), F.col("total")))


def per_minute(requests: DataFrame) -> DataFrame:
    m = requests.withColumn("minute", F.date_trunc("minute", "ts"))
    return by(m, "minute")


def outcome(finish: Column, error: Column) -> Column:
    return F.when(finish == "length", "truncation_failure").when(F.contains(F.lower(error), F.lit("timeout")), "timeout_failure").when(error.isNotNull(), "parse_failure")
