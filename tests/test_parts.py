"""Sources, sinks, command line, streams, and the plans that are wanted."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import __main__ as command
from lectern import schemas
from lectern.operators import files, questions, search, segment, topics
from lectern.plans import generate
from lectern.plans import queries as Q
from lectern.plans.storage import package
from lectern.sources import docx
from lectern.sources import files as sources
from lectern.streaming import live

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    """The plan before adaptive changes, if it has run."""
    text = plan(df)
    return text.split("== Initial Plan ==")[-1]


@data
def test_topics_clean_a_text_once(spark):
    text = plan(Q.queries()["primary_topic"](spark, DATA))
    assert text.count("regexp_replace(regexp_replace(") <= 1 and text.count("Scan parquet") == 1


@data
def test_normal_forms_are_made_once(spark):
    text = plan(Q.queries()["source_rows"](spark, DATA))
    assert text.count("ArrowEvalPython") <= 1
    assert plan(Q.queries()["fingerprint"](spark, DATA)).count("ArrowEvalPython") == 1


@data
def test_forecast_reads_its_tables_once(spark):
    text = initial(Q.queries()["forecast_examples"](spark, DATA))
    assert text.count("Scan parquet") <= 3 and "lineitem" not in text


@data
def test_search_is_one_pass(spark, monkeypatch):
    """The result is rows; the only scan of the texts is that of the write."""
    got = Q.queries()["bm25_search_filtered"](spark, DATA)
    assert "parquet" not in plan(got) and got.count() == 20


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert search.search(docs, "doc_id", F.col("text"), "?!", 5).count() == 0
    assert search.search(docs, "doc_id", F.col("text"), "zzz", 5).count() == 0
    assert search.search(docs.limit(0), "doc_id", F.col("text"), "a", 5).count() == 0
    assert [r.doc_id for r in search.search(docs, "doc_id", F.col("text"), "A", 5).collect()] == [1]


def test_unknown_subject_has_no_topic(spark):
    docs = spark.createDataFrame([(1, "a cell", "Geology"), (2, "a cell", None), (3, None, None)], "id long, text string, given string")
    rows = {r.id: (r.subject, r.topic) for r in topics.classified(docs, F.col("text"), topics.STARTER, F.col("given")).collect()}
    assert rows == {1: ("geology", "unknown"), 2: ("biology", "cells"), 3: (None, "unknown")}


def test_search_does_not_repair_what_it_cleans(spark):
    """Ten characters with a wrongly decoded one: a repair would make them fewer."""
    r = spark.createDataFrame([("1", "12345 Â½ x"), ("2", "  \u00a0 short  ")], "question_id string, question_text string")
    assert [x.question_id for x in questions.usable(r).collect()] == ["1"]


def test_package_variants():
    body = "<w:p><w:r><w:t>One</w:t><w:cr/><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.MAIN, f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    texts = [docx.extract(out.getvalue(), {}, breaks=b)["blocks"][0]["text"] for b in (None, docx.WITHOUT_RETURNS, {})]
    assert texts == ["One\ntwo\tx", "Onetwo\tx", "Onetwox"]


def test_preview_of_a_package(spark):
    content = package(["One", "two", "three"], ["a", "b"], "top")
    resolved = spark.createDataFrame([("loose_file", "x 2020.docx", "x 2020.docx", ".docx", content, None), ("loose_file", "y.docx", "y.docx", ".docx", b"", None)], "canonical_source_type string, canonical_path string, canonical_filename string, canonical_extension string, content binary, error string")
    got = docx.extract_documents(resolved)
    assert sorted(r.status for r in got.collect()) == ["error", "ok"]
    r = docx.inspect(got.where("status = 'ok'").select("document.*"), paragraphs=2, rows=1, parts=1).first()
    assert [p.text for p in r.paragraphs] == ["One", "two"] and r.tables == [[["a", "b"]]] and r.headers == {"word/header1.xml": ["top"]}


def test_sinks(spark, tmp_path):
    rows = [("d1", 'a "quoted", text', None), ("d2", "two\nlines", 3)]
    df = spark.createDataFrame(rows, "document_id string, t string, n int")
    sources.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, sources.read_csv(spark, f"file://{tmp_path}/c", df._schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).collect())) == rows
    sources.write_jsonl(df, f"file://{tmp_path}/l")
    lines = [json.loads(x) for f in (tmp_path / "l").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["document_id"] for x in lines) == ["d1", "d2"] and any(x["n"] is None and "n" in x for x in lines)
    sources.write_json_per_document(df, f"file://{tmp_path}/d", "document_id")
    (tmp_path / "d" / "__document=d1" / "bad.json").write_text("{no")
    sources.write_json_per_document(df, f"file://{tmp_path}/e")
    assert sorted(json.loads(f.read_text())["document_id"] for f in (tmp_path / "e").glob("*.json") if f.stat().st_size) == ["d1", "d2"]
    back = sources.read_documents(spark, f"file://{tmp_path}/d", "document_id string, t string, n int").collect()
    assert sorted((r.document_id or "", r.error is None) for r in back) == [("", False), ("d1", True), ("d2", True)]
    assert json.loads(sources.as_json_array(df).first()["json"])[0].keys() == {"document_id", "t", "n"}


def test_sample_questions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "q1", "competition": "c", "subject": "Physics", "topic": "t", "difficulty": 2, "tags": ["x"]}, {"id": "q2"}]))
    got = sources.usable_fields(sources.read_json_documents(spark, f"file://{tmp_path}/s.json", schemas.SAMPLE_QUESTION)).collect()
    assert [tuple(r) for r in got] == [("q1", "c", "Physics", "t", 2), ("q2", None, None, None, None)]


def test_patterns_are_a_short_list(spark):
    docs = spark.createDataFrame([(1, "ab")], "ord long, t string")
    many = spark.range(files.MOST_PATTERNS + 1).select(F.col("id").cast("string").alias("pattern"), F.col("id").cast("int").alias("rank"))
    with pytest.raises(ValueError, match="patterns"):
        files.best_per_pattern(docs, F.col("t"), many, F.lit(0))


def documents(tmp_path):
    blocks = ["ROUND 1", "PHYSICS", "1. What is a force?", "ANSWER: a push", "2. Name a lens", "ANSWER: convex"]
    doc = {"document_id": "d", "sha256": "s", "source": {"canonical_path": "x/contest 2019.docx"}, "blocks": [{"type": "paragraph", "text": t, "images": []} for t in blocks]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.json").write_text(json.dumps(doc))
    (tmp_path / "docs" / "e.json").write_text('{"document_id": ')


def stub(model, prompt):
    assert "Patterns of past papers" in prompt and "1. " in prompt
    return json.dumps({"questions": [{"question": "new"}], "forecast": [{"topic": "mechanics"}]})


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    documents(tmp_path)
    monkeypatch.setattr(command, "_generator", lambda name: stub)
    command.main(["segment", f"file://{tmp_path}/docs", f"file://{tmp_path}/records"])
    shown = capsys.readouterr().out
    assert "|ok " in shown and "|error " in shown
    command.main(["search", f"file://{tmp_path}/records", "lens", "--count", "1"])
    assert "Name a lens" in capsys.readouterr().out
    for name in ("generate", "forecast"):
        command.main([name, f"file://{tmp_path}/records", "physics", "--out", f"file://{tmp_path}/out"])
        got = json.loads(capsys.readouterr().out)
        assert got["mode"] == name and got["result"]
        assert list((tmp_path / "out" / f"latest_{name}").glob("part-*"))


def test_generator_by_name():
    assert command._generator(None) is None and command._generator("json:loads") is json.loads
    assert generate.questions_of({"result": {"questions": [1]}}) == [1] and generate.questions_of([2]) == [2] and generate.questions_of("x") == []
    assert generate.question_type("problem_of_the_day") == "problem_of_day"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"topic": "a", "correct": True, "ts": "2024-01-01T10:00:00", "question_fingerprint": "f"}, {"topic": "a", "correct": False, "ts": "2024-01-01T10:10:00", "question_fingerprint": "f"}, {"topic": "b", "correct": True, "ts": "2024-01-01T11:10:00", "question_fingerprint": "g"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda: spark.readStream.schema("topic string, correct boolean, ts timestamp, question_fingerprint string").json(f"file://{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r.topic: (r.correct, r.total, r.band) for r in run(live.live_topic_performance(read()), "complete", "live")} == {"a": (1, 2, "red"), "b": (1, 1, "green")}
    assert sorted((r.topic, r.total) for r in run(live.windowed_performance(read()), "complete", "windows")) == [("a", 2), ("b", 1)]
    assert sorted(r.question_fingerprint for r in run(live.first_questions(read()), "append", "first")) == ["f", "g"]


def test_segmentation_report(spark):
    docs = spark.createDataFrame([("d", None), ("e", "JSONDecodeError: x"), ("f", None)], "document_id string, error string")
    lines = spark.createDataFrame([("d", 1, "What?")], "document_id string, block int, text string").withColumn("images", F.expr(f"cast(array() as {schemas.IMAGES})"))
    got = {r.document_id: (r.status, r.questions) for r in segment.segmentation_report(docs, segment.flatten_v2(segment.segment_v2(lines))).collect()}
    assert got == {"d": ("ok", 1), "e": ("error", 0), "f": ("ok", 0)}
