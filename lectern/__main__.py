"""python -m lectern search|segment|generate|forecast ...: thin command line over the operators."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import search, segment, topics
from lectern.plans import generate
from lectern.sources import files


def _generator(name: str | None):
    """The function that module:function names."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _records(spark: SparkSession, path: str, vocabulary: topics.Vocabulary) -> DataFrame:
    """Question records with subject and topic; the id gives the order."""
    x = topics.classified(files.read_jsonl(spark, path, schemas.QUESTION), F.col("question_text"), vocabulary, F.col("metadata.subject"))
    return x.withColumn("year", F.col("metadata.year")).withColumn("ord", F.col("question_id")).withColumn("question_type", F.coalesce(F.nullif("question_type", F.lit("")), F.lit("standard")))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("search", help="BM25 over question records (JSON lines)")
    p.add_argument("records")
    p.add_argument("query")
    p.add_argument("--count", type=int, default=8)
    p = commands.add_parser("segment", help="documents (JSON) to question records (JSON lines)")
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--document")
    p.add_argument("--strict", action="store_true")
    for name, text in (("generate", "new questions from past ones"), ("forecast", "topics of the next paper")):
        p = commands.add_parser(name, help=text)
        p.add_argument("records")
        p.add_argument("subject")
        p.add_argument("--type", default="standard")
        p.add_argument("--vocabulary", help="JSON: subject to topic to keywords")
        p.add_argument("--generator", help="module:function that takes a model and a prompt and returns text")
        p.add_argument("--models", nargs="+", default=["default"])
        p.add_argument("--out", help="folder for the latest answer")
        if name == "generate":
            p.add_argument("--topic", default="")
            p.add_argument("--count", type=int, default=5)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if a.command == "search":
        records = files.read_jsonl(spark, a.records, schemas.QUESTION)
        search.search(records, "question_id", F.col("question_text"), a.query, a.count).join(records, "question_id").orderBy(F.desc("score"), "question_id").show(a.count, truncate=False)
    elif a.command == "segment":
        docs = files.read_documents(spark, a.documents, schemas.DOCUMENT)
        docs = docs.where(F.col("document_id") == a.document) if a.document else docs
        good = docs.where("error is null")
        lines = segment.document_lines(good).join(good.select("document_id", F.col("source.canonical_path").alias("path")), "document_id")
        records = segment.flatten_v2(segment.segment_v2(lines, a.strict))
        files.write_jsonl(records, a.out)
        segment.segmentation_report(docs, files.read_jsonl(spark, a.out, schemas.QUESTION)).orderBy("document_id").show(truncate=False)
    else:
        vocabulary = topics.read_vocabulary(a.vocabulary) if a.vocabulary else topics.STARTER
        records, text = _records(spark, a.records, vocabulary), F.col("question_text")
        if a.command == "generate":
            envelope = generate.generate(records, text, _generator(a.generator), a.models, a.subject, a.type, a.topic, a.count)
        else:
            envelope = generate.forecast(records, text, _generator(a.generator), a.models, a.subject, a.type)
        if a.out:
            generate.write_latest(spark, envelope, a.out)
        print(json.dumps(envelope, ensure_ascii=False, default=str, indent=1))


if __name__ == "__main__":
    main()
