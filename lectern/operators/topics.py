"""Subjects and topics by keyword, recurrence of topics over years, examples.

A vocabulary is a parameter: subject -> topic -> keywords, in order of precedence. Keywords match as substrings.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, contains_any

Vocabulary = dict[str, dict[str, list[str]]]


def read_vocabulary(path: str) -> Vocabulary:
    return json.loads(Path(path).read_text())


#: A small vocabulary for a start; hand a full one to the operators.
STARTER: Vocabulary = {
    "mathematics": {"algebra": ["equation", "polynomial"], "geometry": ["triangle", "circle"], "trigonometry": ["sin", "tan"]},
    "physics": {"mechanics": ["force", "momentum"], "waves": ["frequency", "lens"]},
    "chemistry": {"ions": ["ion", "acid"], "gases": ["mole", "gas"]},
    "biology": {"cells": ["cell", "nucleus"], "genetics": ["gene", "allele"]},
}


def lowered(text: Column) -> Column:
    """The form that keywords are sought in. Select it as a column first: it is then computed once, whatever the vocabulary's size."""
    return F.lower(collapse(text))


def subject_of(subject: Column, low: Column, vocabulary: Vocabulary) -> Column:
    """The given subject in lower case, else the first one with any keyword in the lowered text."""
    out = F.lit(None).cast("string")
    for name, topics in reversed(vocabulary.items()):
        out = F.when(contains_any(low, [w for words in topics.values() for w in words]), name).otherwise(out)
    return F.coalesce(F.nullif(F.lower(subject), F.lit("")), out)


def topic_scores(subject: Column, low: Column, vocabulary: Vocabulary) -> Column:
    """Array of (topic, score, rank) of the subject's topics with a positive number of keywords in the lowered text; empty for a null subject, null for one that the vocabulary lacks."""
    out, rank = F.when(subject.isNull(), F.expr("cast(array() as array<struct<topic:string,score:int,rank:int>>)")), 0
    for name, topics in vocabulary.items():
        rows = []
        for topic, words in topics.items():
            score = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
            rows.append(F.struct(F.lit(topic).alias("topic"), score.cast("int").alias("score"), F.lit(rank).alias("rank")))
            rank += 1
        out = out.when(subject == name, F.filter(F.array(*rows), lambda x: x["score"] > 0))
    return out


def classified(df: DataFrame, text: Column, vocabulary: Vocabulary, subject: Column | None = None) -> DataFrame:
    """df with subject, scores and topic; the text is cleaned once, the subject found once."""
    given = F.lit(None).cast("string") if subject is None else subject
    x = df.withColumn("__given", given).withColumn("__low", lowered(text)).withColumn("subject", subject_of(F.col("__given"), F.col("__low"), vocabulary))
    x = x.withColumn("scores", topic_scores(F.col("subject"), F.col("__low"), vocabulary))
    return x.withColumn("topic", primary_topic(F.col("scores"))).drop("__given", "__low")


def primary_topic(scored: Column) -> Column:
    """The topic of the highest score, ties in the vocabulary's order; unknown without one."""
    best = F.array_max(F.transform(scored, lambda x: F.struct(x["score"].alias("s"), (-x["rank"]).alias("r"), x["topic"].alias("t"))))
    return F.coalesce(best["t"], F.lit("unknown"))


def pattern_profile(records: DataFrame, recent: int = 3, weight: float = 1.5) -> DataFrame:
    """records(topic, year, ord): per topic frequency, years, recurrence, recent years and forecast score. The latest year is that of all records, the unknown topic's included."""
    latest = F.broadcast(records.agg(F.max("year").alias("latest")))
    rows = records.where("topic <> 'unknown'").groupBy("topic").agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("year")).alias("years_seen"), F.min("ord").alias("first")).crossJoin(latest)
    rows = rows.withColumn("recurrence", F.size("years_seen")).withColumn("recent_years", F.size(F.filter("years_seen", lambda y: y >= F.col("latest") - recent)))
    return rows.withColumn("forecast_score", F.round(F.log1p("frequency") + F.col("recurrence") + weight * F.col("recent_years"), 3)).drop("latest")


def top_profile(profile: DataFrame, k: int = 10) -> DataFrame:
    return profile.orderBy(F.desc("forecast_score"), "first").limit(k)


def forecast_examples(records: DataFrame, profile: DataFrame, topics: int = 5, per_topic: int = 2, most: int = 12) -> DataFrame:
    """The newest records of the best topics. A null year counts as 0. The window's limit per topic is applied before its shuffle too. records is read twice and
    the profile once, so store what is dear to compute."""
    best = profile.orderBy(F.desc("forecast_score"), "first").limit(topics)
    ranked = F.broadcast(best.select("topic", F.row_number().over(Window.orderBy(F.desc("forecast_score"), "first")).alias("topic_rank")))
    newest = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.coalesce("year", F.lit(0))), "ord"))
    return records.join(ranked, "topic").withColumn("example", newest).where(F.col("example") <= per_topic).orderBy("topic_rank", "example").limit(most)
