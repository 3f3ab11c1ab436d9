"""Cleaning of a corpus in five stages, each of them an operator of lectern.llm, over documents(doc_id, text, lang, source, n_chars).

1. language: documents for which no language is likelier than all others together go, those without a letter among them; if no language was
   learned, texts with letters stay.
2. toxicity: documents that score at least TOXIC go; clean ones stay.
3. near_duplicates: of each group one document stays, that with the smallest doc_id (5-word shingles, similarity of 0.8 or more).
4. decontamination: documents that overlap a benchmark item go.
5. encoding: what is left is encoded, and its encoding decoded; ids and decoded text are returned beside their digests.

Stages 1 to 4 return the columns of documents, the last one what it makes of them. Decisions bear a doc_id: rows with a null doc_id go in stage 1 and 2 by
their text, and otherwise stay. Rows that repeat a doc_id are one document, and stay or go together. run() deletes what a stage wrote once the next one is
written; what it returns reads the last of these tables. An empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, neardup, pieces, toxicity
from lectern.llm.common import discard, materialise, scratch
from lectern.llm.textvec import chunks

TOXIC = toxicity.THRESHOLD


def _filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of docs whose text passes keep(column of texts) -> mask, in one pass and without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, langid.ROWS):
                part = batch.slice(lo, langid.ROWS)
                yield part.filter(keep(part.column(at)))
            pa.default_memory_pool().release_unused()

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if not model.langs:
        return _filtered(docs, lambda texts: pa.array([langid.has_letter(x) for x in texts.to_pylist()], pa.bool_()))
    shared = spark.sparkContext.broadcast(model)
    return _filtered(docs, lambda texts: pa.array([langid.accepted(x, p) for x, p in zip(*shared.value.predict(texts.to_pylist()), strict=True)], pa.bool_()))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _filtered(docs, lambda texts: pa.array([bool(p < TOXIC) for _, data, offs in chunks(texts) for p in shared.value.score(data, offs)], pa.bool_()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs, k=5, percent=80).where("doc_id is not null and not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = hit.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(hit, F.col("doc_id") == F.col("__gone"), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs, pieces.default_model(), with_ids=True)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: No stage but the fourth could be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
            if before is not None:
                discard(before)
            before = docs
        keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
