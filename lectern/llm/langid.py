"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, smallest_hashes
from lectern.llm.textvec import U

#: log2 of the number of feature buckets of each order.
BITS = 15
ORDERS = (1, 2, 3)
#: The fit uses at most so many labelled documents, those with the smallest hashes of their ids, with whole texts.
TRAIN_ROWS = 20_000
#: Buckets that are sent to the driver together, as one row per language.
TOGETHER = 1 << 12
#: Characters scored at a time; a longer text is worked off piece by piece, each with the two characters before it.
PIECE = 1 << 18
LEAD = max(ORDERS) - 1
#: Rows that are turned into Python strings at a time.
ROWS = 512

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    if not _fold:
        table = np.full(0x110000, 32, dtype=np.uint32)
        letters = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
        table[letters] = letters
        _fold.append(table)
    return _fold[0]


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each character (orders one after the other in one space)."""
    c = codes.astype(U)
    h = np.zeros(len(c), dtype=U)
    for k, n in enumerate(ORDERS):
        h = h * U(0x9E3779B97F4A7C15) + (c if k == 0 else np.concatenate((np.full(n - 1, 32, U), c[: 1 - n]))[: len(c)]) + U(n)
        yield ((h * U(0xD6E8FEB86659FD93)) >> U(64 - BITS)).astype(np.int64) + (k << BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pieces(texts: list[str | None], piece: int = PIECE) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """(folded code points, text of each run, start of each run) of about `piece` characters.

    Each run starts with the LEAD characters before it, spaces at the start of a text: they are context, and no n-gram that ends at them counts.
    """
    runs: list[str] = []
    whose: list[int] = []
    size = 0

    def flush():
        codes = fold_table()[np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        return codes, whose, np.concatenate(([0], np.cumsum([len(r) for r in runs])[:-1])).astype(np.int64)

    for i, text in enumerate(texts):
        if not text:
            continue
        low = " " * LEAD + text.lower()
        for at in range(LEAD, len(low), piece):
            run = low[at - LEAD : at + piece]
            runs.append(run)
            whose.append(i)
            size += len(run)
            if size >= piece:
                yield flush()
                runs, whose, size = [], [], 0
    if runs:
        yield flush()


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log probabilities of the languages
    weight: np.ndarray  # log probabilities: bucket, language

    def predict(self, texts: list[str | None], piece: int = PIECE) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; `und` and 0 for a null text or one without a letter. Ties: the first by name."""
        total, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        for codes, whose, at in pieces(texts, piece):
            np.logical_or.at(letters, whose, np.logical_or.reduceat(codes != 32, at))
            if not self.langs:
                continue
            part = 0
            for bucket in grams(codes):
                value = self.weight[bucket]
                for k in range(LEAD):
                    value[at + k] = 0
                part = part + np.add.reduceat(value, at, axis=0)
            np.add.at(total, whose, part)
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if self.langs:
            total += self.prior
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i in np.flatnonzero(letters):
                langs[i], score[i] = self.langs[best[i]], p[i]
        return langs, score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        own = batch.column(0).to_pylist()
        for codes, whose, at in pieces(batch.column(1).to_pylist()):
            counted = np.ones(len(codes), dtype=bool)
            for k in range(LEAD):
                counted[at + k] = False
            names, of = np.unique([own[i] for i in whose], return_inverse=True)
            lang = np.repeat(of, np.diff(np.append(at, len(codes))))[counted]
            for bucket in grams(codes):
                key, n = np.unique(lang * (len(ORDERS) << BITS) + bucket[counted], return_counts=True)
                for i, name in enumerate(names):
                    a, b = np.searchsorted(key, (i * (len(ORDERS) << BITS), (i + 1) * (len(ORDERS) << BITS)))
                    if name not in counts:
                        counts[name] = np.zeros(len(ORDERS) << BITS, dtype=np.int64)
                    counts[name][key[a:b] - i * (len(ORDERS) << BITS)] += n[a:b]
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.record_batch([pa.array([str(name)] * len(some)), pa.array(some), pa.array(row[some])], names=["lang", "bucket", "n"])


def _row(part: pd.DataFrame) -> pd.DataFrame:
    row = np.zeros(TOGETHER, dtype=np.int64)
    row[part["bucket"].to_numpy(int) % TOGETHER] = part["n"].to_numpy(np.int64)
    return pd.DataFrame({"lang": part["lang"].iloc[:1], "chunk": part["chunk"].iloc[:1], "counts": [row.tobytes()]})


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labelled: doc_id, text, lang; rows with a null text or lang are left out. No row at all gives a model without languages, which says `und`.

    All languages of the sample are learned; the model and what is sent to the driver take 0.8 MB a language.
    """
    spark = labelled.sparkSession
    known = labelled.where("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    with scratch(spark):
        ids = smallest_hashes(known.select("doc_id", "lang"), "doc_id", train_rows).collect()
    docs: dict[str, int] = {}
    sample = known.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted({r.doc_id for r in ids}) or [-1]], "id long")), F.col("doc_id") == F.col("id"), "left_semi")
    for r in sample.groupBy("lang").count().collect():
        docs[r["lang"]] = r["count"]
    langs = sorted(docs)
    counts = np.zeros((len(langs), len(ORDERS) << BITS))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        rows = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        rows = rows.select("lang", F.floor(F.col("bucket") / TOGETHER).cast("int").alias("chunk"), "bucket", "n")
        for r in rows.groupBy("lang", "chunk").applyInPandas(_row, "lang string, chunk int, counts binary").collect():
            counts[place[r["lang"]], r["chunk"] * TOGETHER : (r["chunk"] + 1) * TOGETHER] = np.frombuffer(r["counts"], np.int64)
    smooth = counts + 0.5
    weight = np.empty_like(smooth)
    for k in range(len(ORDERS)):
        part = slice(k << BITS, (k + 1) << BITS)
        weight[:, part] = np.log(smooth[:, part] / smooth[:, part].sum(axis=1, keepdims=True)) if langs else 0
    prior = np.log(np.array([docs[x] for x in langs], float) / max(1, sum(docs.values()))) if langs else np.zeros(0)
    return Model(langs, prior, np.ascontiguousarray(weight.T))


#: A text whose best language is not likelier than all others together is rejected where languages decide.
CERTAIN = 0.5


def accepted(lang: str, score: float) -> bool:
    """Whether a prediction names a language and is surer of it than not."""
    return lang != "und" and score > CERTAIN


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text, ...), repeated rows and null ids included.

    A null text, an empty one and one without a letter are `und` with score 0; a letter is what str.isalpha says. A long text is scored in
    pieces that overlap, with the same result. Ties go to the first language by name. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                langs, p = shared.value.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def op2_naive_bayes_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out_of_fit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit(docs.where(~out_of_fit))
    return identify(docs, model).select("doc_id", F.coalesce(out_of_fit, F.lit(False)).alias("held_out"), "lang_pred", "score")
