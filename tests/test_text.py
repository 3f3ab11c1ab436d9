from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_scalars(spark):
    assert one(spark, " a b\t\n c ", T.clean) == "a b c"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "a - b ( c ) , d [ e ] !", T.normalize) == "a-b(c),d[e]!"
    assert one(spark, "ﬁ – X", T.normalize) == "fi-x"
    assert one(spark, "Newton's half-life x_2", T.tokens) == ["newton's", "half-life", "x", "2"]
    assert one(spark, "Contest 1_2021.docx nsmq2020 NSMQ 2020/x", T.years) == ["2020"]
    assert one(spark, "a/b/My.File.DOCX", T.extension) == ".docx"
    assert one(spark, '```json {"a":1} ```', T.rescue_json) == '{"a":1}'
    assert one(spark, "no", T.rescue_json) is None
    assert one(spark, "1536", lambda c: T.format_bytes(c.cast("long"))) == "1.50 KB"
    assert one(spark, " ", T.clean_answer) == ""


def test_lines(spark):
    for line, answer in (("Arrange the ions", "rrange the ions"), ("A ball falls", "ball falls"), ("a) first part", ") first part"), ("ANSWER: 5", "5"), ("ANS = 3", "3"), ("What", None)):
        assert one(spark, line, lambda c: L.v2_fields(c)["answer"]) == answer
    for line, number in (("1. What", "1"), ("12 V battery", "12"), ("1.What", None), ("e.g. iron", "e"), ("b)x", "b")):
        assert one(spark, line, lambda c: L.v2_fields(c)["item_number"]) == number
    assert one(spark, "Round 3b: Speed Race", lambda c: L.v2_fields(c)["round"]) == "3B"
    assert one(spark, "ROUND 6", lambda c: L.v2_fields(c)["is_round"]) is False
    assert one(spark, "A ball", lambda c: L.v2_fields(c, strict=True)["answer"]) == "ball"
    assert one(spark, "Arrange", lambda c: L.v2_fields(c, strict=True)["answer"]) is None
