"""The window plan of the second grammar against the fold, on random soups of lines."""

import random

from fold import folded
from pyspark.sql import functions as F

from lectern.operators import segment
from lectern.schemas import IMAGES

LINES = [
    "ROUND 1", "Round 2: Riddles", "ROUND 4: TRUE OR FALSE", "PRE C 3 ROUND 5: RIDDLE", "ROUND 3: Speed Race", "ROUND 2", "CONTEST 7", "PRE C 9", "PHYSICS", "maths 2", "1. Find x", "2) Name it", "12 V battery", "a) first", "b) next part",
    "c. more", "ANSWER: 5", "Ans", "A ball falls", "A", "SOLUTION: because", "solution", "Who am I?", "who am i then", "What is y?", "Give two", "Is it?", "Arrange the ions", "plain text", "It glows.", "3. Arrange", "a. Why?", "  ", "Consider gases",
]
FIELDS = "kind ordinal group number question answer solution start_block end_block group_type year contest round subject prompt group_start group_end".split()


def key(r):
    get = r.get if isinstance(r, dict) else lambda f: r[f]
    images = None if get("kind") == "group" else tuple(x["relationship_id"] for x in get("images") or ())
    return tuple(None if (v := get(f)) is None else v for f in FIELDS) + (images,)


def test_window_plan_equals_the_fold(spark):
    rng = random.Random(5)
    rows = []
    for d in range(400):
        weights = [rng.choice((1, 1, 6)) for _ in LINES]
        for k, x in enumerate(rng.choices(LINES, weights, k=rng.randrange(1, 30)), 1):
            rows.append((f"d{d}", 2 * k, x, [(f"r{k}", None)] if rng.random() < 0.3 else [], rng.choice(("a/physics 2019.docx",)) if d % 3 else ""))
    lines = spark.createDataFrame(rows, f"document_id string, block int, text string, images {IMAGES}, path string").where("trim(text) <> ''")
    for strict in (False, True):
        documents = {}
        for r in segment.classified(lines, strict).collect():
            documents.setdefault(r.document_id, []).append(r)
        want = {d: sorted(map(key, folded(x)), key=repr) for d, x in documents.items()}
        got = {d: [] for d in want}
        for r in segment.segment_v2(lines, strict).collect():
            got[r.document_id].append(key(r))
        for d in want:
            assert sorted(got[d], key=repr) == want[d], [r.text for r in sorted(documents[d], key=lambda r: r.block)]


def test_plan_has_one_shuffle(spark):
    lines = spark.createDataFrame([("d", 1, "What?")], "document_id string, block int, text string").withColumn("images", F.expr(f"cast(array() as {IMAGES})"))
    plan = segment.segment_v2(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_documents_without_groups_have_zeros(spark):
    lines = spark.createDataFrame([("d", 1, "ROUND 1"), ("e", 1, "What?")], "document_id string, block int, text string").withColumn("images", F.expr(f"cast(array() as {IMAGES})"))
    got = {r.document_id: tuple(r)[1:] for r in segment.segment_stats(segment.segment_v2(lines), lines).collect()}
    assert got == {"d": (0, 0, 0), "e": (1, 0, 1)}
