import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import files, questions, quiz, segment, topics
from lectern.plans import generate
from lectern.schemas import IMAGES
from lectern.sources import docx
from lectern.sources import files as sources


def lines(spark, texts):
    return spark.createDataFrame([("d", k, x) for k, x in enumerate(texts, 1)], "document_id string, block int, text string").withColumn("images", F.expr(f"cast(array() as {IMAGES})"))


@pytest.mark.parametrize(
    ("texts", "expected"),
    [
        (["ROUND 1", "PHYSICS", "1. What is x?", "ANSWER: 5", "CHEMISTRY", "2. Name y.", "ANSWER: z"], [("What is x?", "5", "physics", 3, 5), ("Name y.", "z", "physics", 6, 7)]),
        (["What is x?", "Give two.", "ANS: 1", "Which y?"], [("What is x? Give two.", "1", None, 1, None), ("Which y?", None, None, 4, None)]),
        (["ROUND 4: TRUE OR FALSE", "Consider gases.", "1. They expand.", "ANS: TRUE"], [("Consider gases. They expand.", "TRUE", None, 3, 4)]),
        (["ROUND 5: RIDDLES", "1. I glow.", "Who am I?"], [("I glow. Who am I?", None, None, 2, 3)]),
        (["1. Find x.", "SOLUTION: s", "more"], [("Find x. more", None, None, 1, 3)]),
    ],
)
def test_segment_v2(spark, texts, expected):
    rows = segment.flatten_v2(segment.segment_v2(lines(spark, texts))).orderBy("question_id").collect()
    assert [(r.question_text, r.answer, r.metadata.subject, r.source.start_block, r.source.end_block) for r in rows] == expected


def test_segment_v1(spark):
    rows = segment.segment_v1(lines(spark, ["Speed Race", "What is x?", "Round 2", "What is y?", "SOLUTION", "because", "of it", "A: 4"])).orderBy("question_id").collect()
    assert [(r.question_text, r.metadata.section_type, r.answer, r.solution, r.source.end_block) for r in rows] == [("What is x?", "speed_race", None, None, 2), ("What is y?", None, "4", "because of it", 8)]


def test_canonicals(spark):
    inv = spark.createDataFrame([("h", "Copy of x.docx", ".docx", "a/Copy of x.docx", 0), ("h", "x.docx", ".docx", "a/x.docx", 1)], "sha256 string, filename string, extension string, relative_path string, ord long")
    assert files.canonical_files(inv).first()["canonical_path"] == "a/x.docx"
    cand = spark.createDataFrame([("h", "loose_file", "x (2).docx", ".docx", 1, "x (2).docx", 0), ("h", "archive_member", "x.docx", ".docx", 1, "a.zip::x.docx", 1)], "sha256 string, source_type string, filename string, extension string, size_bytes long, source_path string, ord long")
    assert files.unified_corpus(cand).first()["canonical_source_type"] == "loose_file"


def test_conflict_counts_blank_answers(spark):
    rows = [(str(k), "standard", "What is it?", a, None, k) for k, a in enumerate(("5", " "))]
    r = spark.createDataFrame(rows, "question_id string, question_type string, question_text string, answer string, solution string, ord long")
    p = questions.prepared(r.withColumn("metadata", F.struct(F.lit(1).alias("year"))).withColumn("source", F.struct(F.lit("d").alias("document_id"), F.lit(1).alias("start_block"), F.lit(1).alias("end_block"))))
    assert questions.answer_conflicts(p).first()["answers"] == 2
    assert [(x.answer, x["count"]) for x in questions.canonical_questions(p).first()["answer_variants"]] == [("5", 1)]


def test_profile_and_quiz(spark):
    rows = [("t", 2019, 0), ("t", 2021, 1), ("t", 2021, 2), ("unknown", 2022, 3)]
    p = topics.pattern_profile(spark.createDataFrame(rows, "topic string, year int, ord long")).first()
    assert (p["recurrence"], p["recent_years"], p["forecast_score"]) == (2, 2, 6.386)
    s = spark.createDataFrame([("approximately",)], "x string")
    assert s.select(topics.subject_of(F.lit(None).cast("string"), F.col("x"), {"mathematics": {"a": ["ap"]}})).first()[0] == "mathematics"
    g = spark.createDataFrame([(" Gold ", "gold"), ("", "")], "a string, b string").select(quiz.is_correct(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in g] == [True, False]
    r = spark.createDataFrame([("a", k < 4) for k in range(5)] + [("b", k < 3) for k in range(5)] + [("c", k < 1) for k in range(2)], "topic string, correct boolean")
    assert {x.topic: x.band for x in quiz.topic_performance(r).collect()} == {"a": "green", "b": "amber", "c": "red"}
    assert [x.topic for x in quiz.weak_topics(r).collect()] == ["c"]
    assert quiz.score(r.limit(0)).first()["percent"] == 0


def package(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:r="{docx.R[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>')
        z.writestr("word/media/i.png", b"x")
    return out.getvalue()


def test_docx_in_archive(spark, tmp_path):
    doc = package('<w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><a:blip r:embed="r1"/></w:r></w:p>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a 2019.docx").write_bytes(doc)
    (tmp_path / "in" / "~$a.docx").write_bytes(b"")
    (tmp_path / "in" / "bad.docx").write_bytes(b"bad")
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("sub/b.docx", doc)
    root = str(tmp_path / "in")
    inv = sources.inventory(spark, root)
    assert sorted(r.filename for r in inv.collect()) == ["a 2019.docx", "bad.docx", "z.zip"]
    members = sources.archive_inventory(sources.archive_members(spark, root))
    cand = files.loose_candidates(inv).unionByName(files.archive_candidates(members)).withColumn("ord", F.monotonically_increasing_id())
    corpus = files.unified_corpus(cand)
    assert {r.canonical_path: r.source_count for r in corpus.collect()} == {"a 2019.docx": 2, "bad.docx": 1}
    rows = docx.extract_documents(sources.resolve(corpus, spark, root)).collect()
    assert sorted(r.status for r in rows) == ["error", "ok"]
    d = next(r.document for r in rows if r.status == "ok")
    assert [b.type for b in d.blocks] == ["paragraph", "table", "paragraph"]
    assert d.blocks[0].text == "One\ttwo"
    assert d.blocks[2].images[0].target == "media/i.png"
    assert d.metadata_hints.years_from_path == ["2019"]
    assert docx.extract(doc, {}, "single")["blocks"][2]["images"][0]["target"] == "word/media/i.png"


def test_generator_retries():
    seen, waits = [], []

    def flaky(model, prompt):
        seen.append(model)
        if len(seen) < 5:
            raise RuntimeError("503 busy")
        return 'here {"questions": [1]}'

    assert generate.questions_of(generate.rescue(generate.call(flaky, ["a", "b"], "p", waits.append))) == [1]
    assert seen == ["a", "a", "a", "b", "b"] and waits == [1, 2, 1]
    with pytest.raises(RuntimeError):
        generate.call(None, ["a"], "p")
