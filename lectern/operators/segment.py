"""Documents' lines to questions, as two relational plans.

v1: what a line is depends on it alone, so that questions are runs of lines between starts, and context is carried forward by windows.
v2: a group, once it has an item, keeps one open until it ends. So a group has two phases, and the role of each line follows from
where its first standalone question (s0) and its first item (p) are; numbers of items and questions are running counts. A window over a document's
lines is one shuffle by document, and the longest document bounds a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import lines as L
from lectern.functions.text import clean, collapse, filled, first_year, subject_hint
from lectern.schemas import IMAGES


def document_lines(documents: DataFrame) -> DataFrame:
    """Paragraphs of documents(document_id, blocks) as lines: number of the block among all blocks, collapsed text; empty ones are left out."""
    rows = documents.select("document_id", F.posexplode("blocks").alias("pos", "b"))
    rows = rows.where((F.col("b.type") == "paragraph") & filled(F.col("b.text")))
    return rows.select("document_id", (F.col("pos") + 1).alias("block"), collapse(F.col("b.text")).alias("text"), F.col("b.images").alias("images"))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of plain texts in the same form."""
    rows = docs.select(F.col(key).cast("string").alias("document_id"), F.posexplode(F.split(text, "\n")).alias("pos", "t")).where(filled(F.col("t")))
    return rows.select("document_id", (F.col("pos") + 1).alias("block"), collapse(F.col("t")).alias("text"), F.expr(f"cast(array() as {IMAGES})").alias("images"))


def _document() -> tuple:
    """Windows over a document's lines: in order, and up to each line."""
    doc = Window.partitionBy("document_id").orderBy("block")
    return doc, doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried_v1(lines: DataFrame) -> DataFrame:
    """Lines with their kind and the context of the first grammar that holds at them: c_round(round, label), c_contest(contest, label), c_section(v), c_preamble(v), c_subject."""
    _, so_far = _document()
    c = F.col("text")
    x = lines.withColumn("kind", L.v1_kind(c))
    kind = F.col("kind")
    rnd = F.when(kind == "ROUND", F.struct(F.regexp_extract(c, L.V1_ROUND, 1).cast("int").alias("round"), F.regexp_extract(c, L.V1_ROUND, 2).alias("label")))
    contest = F.when(kind == "CONTEST", F.struct(F.regexp_extract(c, L.V1_CONTEST, 1).cast("int").alias("contest"), c.alias("label")))
    # Structs, so that a reset to null is carried like a value.
    section = F.when(kind == "ROUND", F.struct(F.lit(None).cast("string").alias("v"))).when(kind == "SPECIAL", F.struct(L.v1_section(c).alias("v")))
    preamble = F.when(kind.isin("ROUND", "CONTEST"), F.struct(F.lit(None).cast("string").alias("v"))).when(kind == "PREAMBLE", F.struct(F.nullif(F.trim(F.regexp_extract(c, L.V1_PREAMBLE, 1)), F.lit("")).alias("v")))
    carried = {"c_round": rnd, "c_contest": contest, "c_section": section, "c_preamble": preamble, "c_subject": F.when(kind == "SUBJECT", L.v1_subject(c))}
    return x.select("*", *(F.last(v, ignorenulls=True).over(so_far).alias(k) for k, v in carried.items()))


def segment_v1(lines: DataFrame, competition: str = "quiz") -> DataFrame:
    """One row per question of the first grammar."""
    doc, so_far = _document()
    c, kind = F.col("text"), F.col("kind")
    x = carried_v1(lines)
    closes = kind.isin("ROUND", "CONTEST", "SPECIAL")
    x = x.withColumn("q", F.sum((kind == "Q").cast("int")).over(so_far)).withColumn("closed", F.last(F.when(kind == "Q", False).when(closes, True), ignorenulls=True).over(so_far))
    x = x.withColumn("last_block", F.max("block").over(Window.partitionBy("document_id"))).withColumn("next_end", F.min(F.when((kind == "Q") | closes, F.col("block"))).over(doc.rowsBetween(1, Window.unboundedFollowing)))
    x = x.where("q > 0 and not closed")
    own = Window.partitionBy("document_id", "q").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("mode", F.coalesce(F.last(F.when(kind == "SOLUTION", True).when(kind.isin("Q", "ANSWER"), False), ignorenulls=True).over(own), F.lit(False)))
    said = F.when(kind == "SOLUTION", F.nullif(F.trim(F.regexp_extract(c, L.V1_SOLUTION, 1)), F.lit("")))
    x = x.withColumn("said", said).withColumn("solution_run", F.count("said").over(own))
    last_run = F.max("solution_run").over(Window.partitionBy("document_id", "q"))
    x = x.withColumn("last_run", last_run)
    part = F.when((F.col("solution_run") == F.col("last_run")) & F.col("said").isNotNull(), F.col("said")).when((F.col("solution_run") == F.col("last_run")) & (kind == "OTHER") & F.col("mode"), c)
    text = F.when(kind == "Q", L.strip_question_marker(c)).when((kind == "OTHER") & ~F.col("mode"), c)
    pick = lambda v: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("block", v.alias("v"))))), lambda y: y["v"])
    start = lambda v: F.max(F.when(kind == "Q", v))
    rows = x.groupBy("document_id", "q").agg(
        start(F.col("c_round")).alias("r"), start(F.col("c_contest")).alias("k"), start(F.col("c_subject")).alias("subject"), start(F.col("c_section.v")).alias("section_type"), start(F.col("c_preamble.v")).alias("preamble"),
        pick(text).alias("texts"), F.max_by(F.when(kind == "ANSWER", F.trim(F.regexp_extract(c, L.V1_ANSWER, 2))), F.when(kind == "ANSWER", F.col("block"))).alias("answer"),
        pick(part).alias("solutions"), F.flatten(pick(F.when(kind.isin("Q", "OTHER"), F.col("images")))).alias("images"),
        start(F.col("block")).alias("start_block"), F.min(F.coalesce(F.when(kind == "Q", F.col("next_end") - 1), F.when(kind == "Q", F.col("last_block")))).alias("end_block"),
    )
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("q"))
    return rows.select(
        F.format_string("%s_q%04d", "document_id", number).alias("question_id"), F.lit(competition).alias("competition"),
        F.struct(F.lit(None).cast("int").alias("year"), F.col("k.contest").alias("contest"), F.col("k.label").alias("contest_label"), F.col("r.round").alias("round"), F.col("r.label").alias("round_label"), "subject", "section_type").alias("metadata"),
        "preamble", collapse(F.array_join(F.filter("texts", lambda t: t != ""), " ")).alias("question_text"), "answer", F.nullif(F.array_join("solutions", " "), F.lit("")).alias("solution"), "images",
        F.struct("document_id", "start_block", "end_block").alias("source"), F.lit("candidate").alias("parser_status"),
    )


V2_COLUMNS = (
    f"document_id string, group int, kind string, ordinal int, number string, question string, answer string, solution string, images {IMAGES}, start_block int, end_block int, "
    "group_type string, year int, contest int, round string, subject string, prompt string, group_start int, group_end int"
)


def classified(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines with the fields of the second grammar, whether they are an answer or a solution, and year and subject that the document's path names."""
    path = F.col("path") if "path" in lines.columns else F.lit("")
    x = lines.select("document_id", "block", "images", first_year(path).alias("path_year"), subject_hint(path).alias("path_subject"), clean(F.col("text")).alias("text"))
    f = L.v2_fields(F.col("text"), strict, cleaned=True)
    return x.select("*", *(v.alias(k) for k, v in f.items()), F.col("text").rlike(L.answer_pattern(strict)).alias("is_answer"), F.col("text").rlike(L.SOLUTION).alias("is_solution"))


def _grouped(x: DataFrame) -> DataFrame:
    """Content lines of classified() with their group (seg, numbered from its header), its last block and the context that holds in it."""
    block = F.col("block")
    header = F.col("is_round") | F.col("is_contest")
    # Backwards, as a frame that ends with the document would be gone through again for each line.
    back = Window.partitionBy("document_id").orderBy(F.desc("block"))
    x = x.withColumn("header", header)
    closed = F.last(F.when(F.col("header"), block), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)) - 1
    x = x.withColumn("group_end", F.coalesce(closed, F.max("block").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    _, so_far = _document()
    # A struct, so that a round without a special section resets it.
    context = {
        "c_contest": F.when(F.col("is_round"), F.col("round_contest")).when(F.col("is_contest"), F.col("contest")),
        "c_round": F.when(F.col("is_round"), F.col("round")),
        "c_section": F.when(F.col("is_round"), F.struct(F.col("round_section").alias("v"))),
        "c_subject": F.when(~F.col("header"), F.col("subject")),
    }
    x = x.select("*", F.sum(F.col("header").cast("int")).over(so_far).alias("seg"), *(F.last(v, ignorenulls=True).over(so_far).alias(k) for k, v in context.items()))
    x = x.where(~F.col("header") & F.col("subject").isNull())
    # Within a group only the subject can change.
    return x.select(
        "document_id", "seg", "block", "text", "images", "path_year", "item_number", "is_answer", "is_solution", "is_question", "is_who", "group_end", F.coalesce("c_section.v", F.lit("standard")).alias("type"),
        F.col("c_contest").alias("contest"), F.col("c_round").alias("round"), F.coalesce("c_subject", "path_subject").alias("subject"),
    )


def _group() -> tuple:
    """Windows over a group's lines: all, up to each line and before it. All are in one order, so that lines are sorted once."""
    order = Window.partitionBy("document_id", "seg").orderBy("block")
    return (order.rowsBetween(Window.unboundedPreceding, k) for k in (Window.unboundedFollowing, Window.currentRow, -1))


def _roles(x: DataFrame) -> DataFrame:
    """_grouped() with c1, the block of the group's first line, the subject there, and the role of each line: item, text, answer and solution from the first item on
    (phase B, from block p); before it alone (text of standalone questions), answer, solution, overwrite (a prompt that replaces what was there) and prompt."""
    whole, so_far, _ = _group()
    block, item, asks, who = F.col("block"), F.col("item_number").isNotNull(), F.col("is_question"), (F.col("type") == "riddle") & F.col("is_who")
    least = lambda condition: F.min(F.when(condition, block)).over(whole)
    first = F.first(F.struct("block", "subject", (~item & asks).alias("asks"))).over(so_far)
    x = x.select("*", first.alias("f"), least(~item & asks & ~who).alias("asked_first"), least(item & ~F.col("is_answer")).alias("item_first"), least(item & F.col("is_answer")).alias("either_first"))
    # The first line alone may ask who it is; an item that is an answer too counts unless a question stands before it.
    x = x.withColumn("c1", F.col("f.block")).withColumn("subject", F.col("f.subject")).withColumn("s0", F.least("asked_first", F.when(F.col("f.asks"), F.col("f.block"))))
    x = x.withColumn("p", F.least("item_first", F.when(F.coalesce(F.col("either_first") <= F.col("s0"), F.lit(True)), F.col("either_first")))).drop("f", "asked_first", "item_first", "either_first")
    riddle_end = who & (block > F.col("c1"))
    late, standing = F.coalesce(block >= F.col("p"), F.lit(False)), F.coalesce(block > F.col("s0"), F.lit(False))
    target = (late & (block > F.col("p"))) | (~late & standing)
    role = (
        F.when(target & F.col("is_answer"), "answer").when(target & F.col("is_solution"), "solution").when(late & item, "item").when(late, "text")
        .when(riddle_end, "overwrite").when(block >= F.col("s0"), "alone").otherwise("prompt")
    )
    x = x.withColumn("late", late).withColumn("role", role)
    role = F.col("role")
    count = lambda condition: F.sum(condition.cast("int")).over(so_far)
    x = x.select(
        "*", F.min(F.when((role == "alone") & (block > F.col("s0")), block)).over(whole).alias("premise"), F.max(F.when(role == "overwrite", block)).over(whole).alias("replaced"),
        count(~F.col("late") & (role == "answer")).alias("answers"), count(role == "item").alias("items"),
    )
    # In a group of true or false whose first line is a question, the next text is the premise.
    premise = (F.col("type") == "true_false") & (F.col("s0") == F.col("c1")) & (block == F.col("premise"))
    return x.withColumn("role", F.when(premise, "prompt").otherwise(role)).drop("premise")


def segment_v2(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of V2_COLUMNS: one per group, item (kind item) and question without a number (kind alone)."""
    # Lines are dealt out as they are, and what they are is found afterwards: less is shuffled, and the code that makes them and that which classifies them are
    # compiled apart, as both in one method are too long for the JVM to compile. Texts of items, answers and solutions are taken from a line when its role is known.
    x = _roles(_grouped(classified(lines.repartition("document_id"), strict)))
    _, so_far, before = _group()
    block, role, late, text = F.col("block"), F.col("role"), F.col("late"), F.col("text")
    asks = (role == "alone") & F.col("is_question")
    # A question starts a new one if the last one was answered since it was asked.
    x = x.withColumn("asked", F.last(F.when(asks, F.col("answers")), ignorenulls=True).over(before))
    x = x.withColumn("starts", F.coalesce(((role == "alone") & (block == F.col("s0"))) | (asks & (F.col("answers") > F.col("asked"))), F.lit(False)))
    x = x.withColumn("nth", F.sum(F.col("starts").cast("int")).over(so_far))
    x = x.withColumn("own", F.when(late, "item").when(role.isin("prompt", "overwrite"), "group").otherwise("alone"))
    x = x.withColumn("place", F.when(late, F.col("items")).when(F.col("own") == "alone", F.col("nth")).otherwise(0))
    # The first line stands for its group too.
    both = F.when((block == F.col("c1")) & (F.col("own") != "group"), F.array(F.struct("own", "place"), F.struct(F.lit("group").alias("own"), F.lit(0).cast("long").alias("place")))).otherwise(F.array(F.struct("own", "place")))
    x = x.select("*", F.explode(both).alias("k")).select("*", F.col("k.own").alias("kind"), F.col("k.place").cast("int").alias("ordinal"))
    kind = F.col("kind")
    taken = L.v2_fields(text, strict, cleaned=True)
    piece = (
        F.when(kind == "group", F.when(role.isin("prompt", "overwrite") & F.coalesce(block >= F.col("replaced"), F.lit(True)), text))
        .when(role == "item", taken["item_text"]).when(role.isin("text", "alone"), text)
    )
    shown = (kind == "item") & role.isin("item", "text") & ~((F.col("type") == "riddle") & F.col("is_who") & (role == "text"))
    in_order = lambda v: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("block", v.alias("v"))))), lambda y: y["v"])
    last = lambda name: F.max_by(name, F.when(role == name, block))
    begins = F.when((kind == "group") | (role == "item") | F.col("starts"), block)
    x = x.select("*", piece.alias("piece"), *(F.when(role == name, taken[name]).alias(name) for name in ("answer", "solution")), F.when(shown, F.col("images")).alias("shown"), begins.alias("begins"))
    rows = x.groupBy("document_id", "seg", "kind", "ordinal").agg(
        F.max(F.when(role == "item", F.col("item_number"))).alias("number"), F.array_join(in_order(F.col("piece")), " ").alias("joined"), last("answer").alias("answer"), last("solution").alias("solution"),
        F.flatten(in_order(F.col("shown"))).alias("images"), F.min("begins").alias("begins"),
        F.first(F.struct("type", "contest", "round", "subject")).alias("g"), F.first("path_year").alias("year"), F.min("c1").alias("group_start"), F.max("group_end").alias("group_end"),
    )
    kind, inner = F.col("kind"), F.col("kind") != "group"
    # Items come last in this order, so that what follows one is the next item.
    order = Window.partitionBy("document_id", "seg").orderBy("kind", "ordinal")
    prompt = F.max(F.when(kind == "group", F.nullif("joined", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select("*", prompt.alias("prompt"), F.coalesce(F.lead("begins").over(order) - 1, F.col("group_end")).alias("ends"))
    rows = rows.withColumn("group", F.dense_rank().over(Window.partitionBy("document_id").orderBy("seg")))
    only = lambda condition, c: F.when(condition, F.col(c))
    return rows.select(
        "document_id", "group", "kind", only(inner, "ordinal").alias("ordinal"), only(kind == "item", "number").alias("number"), only(inner, "joined").alias("question"), only(inner, "answer").alias("answer"), only(inner, "solution").alias("solution"),
        only(inner, "images").alias("images"), only(inner, "begins").alias("start_block"), only(kind == "item", "ends").alias("end_block"), F.col("g.type").alias("group_type"), "year",
        F.col("g.contest").alias("contest"), F.col("g.round").alias("round"), F.col("g.subject").alias("subject"), "prompt", "group_start", "group_end",
    )


def flatten_v2(segments: DataFrame, competition: str = "quiz") -> DataFrame:
    """Question records of segment_v2(): items carry their group's prompt before their text."""
    item = F.col("kind") == "item"
    text = F.when(item & (F.coalesce("prompt", F.lit("")) != ""), clean(F.concat_ws(" ", "prompt", "question"))).when(item & (F.col("group_type") != "riddle"), F.col("question")).otherwise(clean(F.col("question")))
    return segments.where("kind <> 'group'").select(
        F.format_string("%s_g%04d_%s%03d", "document_id", "group", F.when(item, "q").otherwise("s"), "ordinal").alias("question_id"), F.lit(competition).alias("competition"),
        F.col("group_type").alias("question_type"), F.struct("year", "contest", "round", "subject").alias("metadata"), "prompt", text.alias("question_text"), "answer", "solution",
        F.when(item, F.col("images")).otherwise(F.expr(f"cast(array() as {IMAGES})")).alias("images"), F.struct("document_id", "start_block", "end_block").alias("source"),
    )


def segment_stats(segments: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Counts per document; documents(document_id, ...) that have no group get zeros if they are given."""
    names = ("groups", "numbered_items", "standalone_questions")
    rows = segments.groupBy("document_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in zip(("group", "item", "alone"), names, strict=True)))
    if documents is None:
        return rows
    all_ = documents.select("document_id").distinct().join(rows.withColumnRenamed("document_id", "__id"), F.col("document_id") == F.col("__id"), "left")
    return all_.select("document_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def segmentation_report(documents: DataFrame, records: DataFrame) -> DataFrame:
    """status, document_id, questions, error per row of documents(document_id, error, ...): one that could not be read is a row with its error, and ends nothing."""
    counts = records.groupBy(F.col("source.document_id").alias("__id")).agg(F.count(F.lit(1)).alias("n"))
    return documents.select("document_id", "error").join(counts, F.col("document_id") == F.col("__id"), "left").select(
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "document_id", F.coalesce("n", F.lit(0)).alias("questions"), "error"
    )
