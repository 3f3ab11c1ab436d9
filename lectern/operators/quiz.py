"""Grading of quizzes and performance per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

STRONG, FAIR = 80, 60


def is_correct(student: Column, expected: Column) -> Column:
    s = F.lower(strip(F.coalesce(student, F.lit(""))))
    return (s != "") & (s == F.lower(strip(F.coalesce(expected, F.lit("")))))


def band(percent: Column) -> Column:
    return F.when(percent >= STRONG, "green").when(percent >= FAIR, "amber").otherwise("red")


def message(percent: Column) -> Column:
    return F.when(percent >= STRONG, "excellent").when(percent >= FAIR, "solid").otherwise("more practice")


def shown_question(question_text: Column, question: Column, topic: Column, chosen: Column) -> tuple[Column, Column]:
    """Text and topic with their fallbacks."""
    return F.coalesce(question_text, question, F.lit("Question unavailable")), F.coalesce(topic, F.nullif(chosen, F.lit("")), F.lit("General"))


def score(results: DataFrame) -> DataFrame:
    right = F.count_if("correct")
    return results.agg(right.alias("score"), F.count(F.lit(1)).alias("total"), F.coalesce(F.try_divide(100.0 * right, F.count(F.lit(1))), F.lit(0.0)).alias("percent")).withColumn("message", message(F.col("percent")))


def topic_performance(results: DataFrame) -> DataFrame:
    right = F.count_if("correct")
    rows = results.groupBy(F.coalesce("topic", F.lit("General")).alias("topic")).agg(right.alias("correct"), F.count(F.lit(1)).alias("total"))
    rows = rows.withColumn("percent", 100.0 * F.col("correct") / F.col("total"))
    return rows.withColumn("band", band(F.col("percent")))


def weak_topics(results: DataFrame) -> DataFrame:
    return topic_performance(results).where(F.col("percent") < FAIR)


def progress(results: DataFrame, quiz: str, order: str) -> DataFrame:
    """The place of each question in its quiz, and how many there are."""
    w = Window.partitionBy(quiz)
    return results.withColumn("number", F.row_number().over(w.orderBy(order))).withColumn("of", F.count(F.lit(1)).over(w))
