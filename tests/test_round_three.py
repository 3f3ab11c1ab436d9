"""What the third round of review found."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import TOKEN
from lectern.operators import search, segment
from lectern.schemas import IMAGES

TEXTS = ["b a b", "", None, "A a-a, A b2 ’ é zz zz zz", "zz", "…", "a " * 3000 + "b"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_postings_are_counted_without_a_shuffle(docs):
    counted = search._counted(docs, "doc_id", F.col("text"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    words = [re.findall(TOKEN, (t or "").lower()) for t in TEXTS]
    assert {(r.key, r.dl, r.term, r.tf) for r in counted.where("term is not null").collect()} == {(k, len(w), t, n) for k, w in enumerate(words) for t, n in Counter(w).items()}
    assert sorted((r.key, r.dl) for r in counted.where("term is null").collect()) == [(k, len(w)) for k, w in enumerate(words)]


def test_stored_index_is_sorted_by_numbers_and_finds_what_search_finds(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    search.write_index(docs, "doc_id", F.col("text"), path)
    codes = [r.code for r in spark.read.parquet(f"{path}/postings").coalesce(1).select("code", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).orderBy("f", "k").collect()]
    files = [r.f for r in spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("f")).distinct().collect()]
    assert sum(a > b for a, b in zip(codes, codes[1:])) < len(files)
    assert spark.read.parquet(f"{path}/statistics").collect() == [(len(TEXTS), sum(len(re.findall(TOKEN, (t or "").lower())) for t in TEXTS))]
    for query in ("a b", "zz", "b2 a-a nothing", "nothing", "?!"):
        rounded = [[(r[0], round(r[1], 9)) for r in x.collect()] for x in (search.search_index(spark, path, query, 20), search.search(docs, "doc_id", F.col("text"), query, 20))]
        assert rounded[0] == rounded[1]


def test_index_of_nothing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    search.write_index(docs.limit(0), "doc_id", F.col("text"), path)
    assert spark.read.parquet(f"{path}/statistics").collect() == [(0, 0)]
    assert search.search_index(spark, path, "a b").collect() == []


def test_no_window_goes_through_the_rest_of_a_document_for_each_line(spark):
    """A frame from the next line to the last is computed anew for each line, with the square of a document's length."""
    lines = spark.createDataFrame([("d", 1, "What?")], "document_id string, block int, text string").withColumn("images", F.expr(f"cast(array() as {IMAGES})"))
    plan = segment.segment_v2(lines)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, 1, unboundedfollowing" not in plan
    assert plan.count("windowspecdefinition") and sum("Window [" in x for x in plan.splitlines()) <= 8
