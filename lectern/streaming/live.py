"""Structured Streaming forms of two operators; extensions, since quizzes and records also arrive one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.quiz import topic_performance


def live_topic_performance(results: DataFrame) -> DataFrame:
    """Running performance per topic of a stream of results(topic, correct); write it in update or complete mode."""
    return topic_performance(results)


def windowed_performance(results: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per topic and window of event time; final once the watermark has passed it."""
    right = F.count_if("correct")
    return results.withWatermark(time, late).groupBy(F.window(time, window), "topic").agg(right.alias("correct"), F.count(F.lit(1)).alias("total"))


def first_questions(records: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Records whose fingerprint was not seen within the watermark; the state is bounded by it."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(["question_fingerprint"])
