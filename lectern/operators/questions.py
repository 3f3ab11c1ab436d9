"""Questions: canonical records, variants and conflicts of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_answer, collapse, fingerprint_of, normalize

SHOWN = ["question_id", "question_type", "question_text", "answer", "solution"]


def _truthy(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def prepared(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """records(question_id, question_type, question_text, answer, solution, metadata, source, ord) with the columns that grouping needs."""
    return records.withColumn("normalized_question", normalize(F.col("question_text"), ascii_only)).withColumn(
        "question_fingerprint", fingerprint_of(F.col("question_type"), F.col("normalized_question"))
    ).withColumn("norm_answer", F.when(_truthy("answer"), clean_answer(F.col("answer"), ascii_only)))


def canonical_rank() -> Column:
    """The best record of a group: with an answer, with a solution, with the longer text; the first in input order."""
    return F.struct(_truthy("answer").alias("a"), _truthy("solution").alias("s"), F.length(F.coalesce("question_text", F.lit(""))).alias("n"), (-F.col("ord")).alias("o"))


def canonical_questions(p: DataFrame) -> DataFrame:
    """One record per fingerprint of prepared(): the best one, counts, lineage, variants of metadata and answers. p is read twice: see conflict_report()."""
    keep = [c for c in p.columns if c not in ("question_fingerprint", "norm_answer", "ord")]
    source = F.struct("ord", "question_id", F.col("source.document_id").alias("document_id"), F.col("source.start_block").alias("start_block"), F.col("source.end_block").alias("end_block"), "metadata")
    rows = p.groupBy("question_fingerprint").agg(
        F.max_by(F.struct(*keep), canonical_rank()).alias("best"), F.count(F.lit(1)).cast("int").alias("duplicate_count"), F.array_sort(F.collect_list(source)).alias("s"),
        F.count_if(_truthy("solution")).cast("int").alias("solution_count"),
    )
    rows = rows.select(
        "question_fingerprint", "best.*", "duplicate_count", F.col("duplicate_count").alias("source_count"), F.transform("s", lambda x: x.dropFields("ord")).alias("sources"),
        F.array_distinct(F.transform("s", lambda x: x["metadata"])).alias("metadata_variants"), "solution_count",
    )
    variants = answer_variants(p).groupBy("question_fingerprint").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "answer"))).alias("v"))
    variants = variants.select(F.col("question_fingerprint").alias("f"), F.transform("v", lambda x: F.struct(x["answer"].alias("answer"), (-x["m"]).alias("count"))).alias("v"))
    return rows.join(variants, F.col("question_fingerprint") == F.col("f"), "left").withColumn("answer_variants", F.coalesce("v", F.expr("cast(array() as array<struct<answer: string, count: bigint>>)"))).drop("f", "v")


def answer_variants(p: DataFrame) -> DataFrame:
    """Counts of the normalised answers of each fingerprint; an answer that is empty once normalised is left out."""
    return p.where("norm_answer <> ''").groupBy("question_fingerprint", F.col("norm_answer").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def answer_conflicts(p: DataFrame) -> DataFrame:
    """Fingerprints with more than one normalised answer; here an answer of blanks counts as one."""
    return p.where("norm_answer is not null").groupBy("question_fingerprint").agg(F.min("norm_answer").alias("lo"), F.max("norm_answer").alias("hi"), F.countDistinct("norm_answer").alias("answers")).where("lo <> hi").select("question_fingerprint", "answers")


def conflict_report(p: DataFrame) -> DataFrame:
    """question_fingerprint, question, answer_variants, sources of each conflict: the canonical text, the counted answers without blanks, all records.

    p is read three times: hand it in as stored(), without normalized_question, so that texts are normalised once.
    """
    conflicts = answer_conflicts(p).select(F.col("question_fingerprint").alias("f"))
    rows = canonical_questions(p.join(conflicts, F.col("question_fingerprint") == F.col("f"), "left_semi"))
    return rows.select("question_fingerprint", F.col("question_text").alias("question"), "answer_variants", "sources")


def source_rows(p: DataFrame) -> DataFrame:
    """The records of each fingerprint as rows, for groups too large for one array."""
    return p.select("question_fingerprint", "ord", "question_id", F.col("source.document_id").alias("document_id"), F.col("source.start_block").alias("start_block"), F.col("source.end_block").alias("end_block"), "metadata")


def duplicate_report(canonical: DataFrame) -> DataFrame:
    return canonical.where("duplicate_count > 1").select("question_fingerprint", F.col("duplicate_count").alias("count"), F.col("question_text").alias("canonical_question"), "question_type", "sources")


def dedup_summary(p: DataFrame) -> DataFrame:
    groups = p.groupBy("question_fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("unique_questions"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def in_corpus_order(records: DataFrame) -> DataFrame:
    year = F.coalesce(F.nullif(F.col("metadata.year"), F.lit(0)), F.lit(9999))
    return records.orderBy(year, F.coalesce("question_type", F.lit("")), F.coalesce("question_text", F.lit("")), "question_id")


def usable(records: DataFrame, least: int = 10) -> DataFrame:
    return records.where(F.length(collapse(F.col("question_text"))) >= least)
