"""Content-type rules as a small dimension table, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type, kinds to emphasise and to play down, whether sentiment and participants are kept, strictness for actions,
#: frequency of notes.
RULES = [
    ("GENERAL_MEETING", "ACTION,DECISION,QUESTION,RISK", "KEY POINT", True, True, "very_high", "medium"),
    ("TECHNICAL_TALK", "KEY POINT,NOTES,QUESTION", "ACTION", False, True, "extreme", "high"),
    ("LECTURE_OR_TALK", "KEY POINT,NOTES", "ACTION,DECISION,QUESTION", False, True, "block", "very_high"),
    ("INTERVIEW", "NOTES,QUESTION,KEY POINT", "ACTION,DECISION", False, True, "extreme", "high"),
    ("PODCAST", "KEY POINT,NOTES", "ACTION,DECISION", False, True, "extreme", "high"),
    ("NEWS_UPDATE", "KEY POINT", "ACTION,DECISION,QUESTION,SENTIMENT", False, False, "block", "medium"),
    ("GAMEPLAY_COMMENTARY", "NOTES", "KEY POINT,ACTION,DECISION,QUESTION,RISK", False, False, "block", "very_high"),
    ("CUSTOMER_SUPPORT", "ACTION,QUESTION,DECISION,RISK", "KEY POINT,NOTES", True, True, "high", "low"),
    ("DEBATE", "KEY POINT,DECISION,QUESTION,RISK", "ACTION,NOTES", False, True, "very_high", "low"),
    ("UNKNOWN", "NOTES", "ACTION,DECISION,QUESTION,RISK", False, True, "block", "medium"),
]
_COLUMNS = "content_type string, emphasize string, deemphasize string, sentiment boolean, participants boolean, strictness string, notes string"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, _COLUMNS)


def weighed(insights: DataFrame, spark: SparkSession) -> DataFrame:
    """Insights with a weight by their type's rule: 1 emphasised, -1 played down, 0 else or without a rule."""
    j = insights.join(F.broadcast(rules(spark)), "content_type", "left")  # ten fixed rows
    has = lambda c: F.array_contains(F.split(F.coalesce(c, F.lit("")), ","), F.col("insight_type"))
    return j.withColumn("weight", F.when(has(F.col("emphasize")), 1).when(has(F.col("deemphasize")), -1).otherwise(0))


def filtered(insights: DataFrame, spark: SparkSession) -> DataFrame:
    """Insights without the kinds that their content type's rule turns off; a type without a rule keeps all."""
    j = insights.join(F.broadcast(rules(spark)), "content_type", "left")  # ten fixed rows
    off = ((F.col("insight_type") == "SENTIMENT") & ~F.coalesce("sentiment", F.lit(True))) | ((F.col("insight_type") == "PARTICIPANTS") & ~F.coalesce("participants", F.lit(True)))
    return j.where(~off)
