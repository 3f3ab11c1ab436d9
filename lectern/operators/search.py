"""Full-text search with BM25. Statistics are those of the whole corpus; filters apply afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import TOKEN, tokens
from lectern.operators import topics
from lectern.sources.shared import delete, new_path

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf), the inverted index; write it once and search it often."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(key, F.size(tokens(text)).cast("long").alias("dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def query_terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(TOKEN, query.lower())))


def _times(array: str, word: str) -> Column:
    return F.size(F.filter(array, lambda x: x == word)).cast("long")


def _frequencies(docs: DataFrame, key: str, text: Column, terms: list[str], keep: Column | None = None) -> DataFrame:
    """key, dl, tf0, tf1, ... and, if asked for, the flag keep."""
    flag = [] if keep is None else [keep.alias("__keep")]
    want = F.array(*map(F.lit, terms))
    tok = docs.select(key, *flag, tokens(text).alias("t"))
    hit = tok.select(key, *(["__keep"] if flag else []), F.size("t").cast("long").alias("dl"), F.filter("t", lambda x: F.array_contains(want, x)).alias("hit"))
    return hit.select(key, *(["__keep"] if flag else []), "dl", *(_times("hit", w).alias(f"tf{k}") for k, w in enumerate(terms)))


def _total(df: list[Column], n: Column, avgdl: Column) -> Column:
    total = F.lit(0.0)
    for k, d in enumerate(df):
        tf = F.col(f"tf{k}")
        idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(avgdl, F.lit(1.0))))).otherwise(0.0)
    return total


def scores(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """(key, score) of documents with a term of the query, in one pass over the texts.

    The query is a handful of terms, so that each document is reduced to its length and its frequency of each term where it is read;
    only two aggregates leave the scan: the statistics, and then the scores. No postings are shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, score double")
    per = _frequencies(docs, key, text, terms)
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    both = per.crossJoin(F.broadcast(stats))
    total = _total([F.col(f"df{k}") for k in range(len(terms))], F.col("n"), F.col("avgdl"))
    # A filter on the frequencies would be pushed below their projection and tokenise each text again per term; a score needs the statistics and is not.
    return both.select(key, total.alias("score")).where("score > 0")


def scores_from_index(index: DataFrame, sizes: DataFrame, key: str, query: str) -> DataFrame:
    """The same from a stored index: only the postings of the query's terms are read and joined."""
    # A filter and no join: it is pushed below the grouping of an index that is made here, so that other terms are not shuffled.
    mine = index.where(F.col("term").isin(query_terms(query))).select(key, "term", "tf")
    df = F.broadcast(mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    part = mine.join(df, "term").join(sizes, key).crossJoin(F.broadcast(corpus_stats(sizes)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    return part.groupBy(key).agg(F.sum(one).alias("score"))


def search(docs: DataFrame, key: str, text: Column, query: str, k: int = 8, keep: Column | None = None) -> DataFrame:
    """The k best documents; keep is a filter that does not change the statistics. Equal scores: smaller key first.

    One pass over the texts: documents with a term of the query are written with their frequencies, and the statistics of all are observed meanwhile. The
    result is k rows.
    """
    spark, terms = docs.sparkSession, query_terms(query)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, score double"
    if not terms or not k:
        return spark.createDataFrame([], schema)
    per = _frequencies(docs, key, text, terms, F.coalesce(F.lit(True) if keep is None else keep, F.lit(False)))
    seen, path = Observation(), new_path(spark, "search")
    per = per.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"), *(F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(terms))))
    # The filter is on a sum that is not split into the frequencies, which would tokenise each text again.
    per.where("__keep").where(F.greatest(F.lit(0), *(F.col(f"tf{j}") for j in range(len(terms)))) > 0).write.parquet(path)
    stats = seen.get
    n = stats.get("n") or 0
    df = [F.lit(stats.get(f"df{j}") or 0) for j in range(len(terms))]
    total = _total(df, F.lit(n), F.lit(float((stats.get("dl") or 0) / max(n, 1))))
    best = spark.read.parquet(path).select(key, total.alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(k).collect()
    delete(spark, path)
    return spark.createDataFrame([tuple(r) for r in best], schema)


def retrieve(records: DataFrame, query: str, vocabulary: topics.Vocabulary, k: int = 8, subject: str | None = None, kind: str | None = None, key: str = "question_id") -> DataFrame:
    """The best records of records(question_text, question_type, metadata.subject, ...) with _retrieval_score (4 digits), _subject and _topic.

    subject is that which a record has or its text suggests; a record without a type is of the standard one. Both filters leave the statistics alone.
    Equal scores: smaller key first, as keys compare, so that numbers in texts are no order of numbers.
    """
    x = topics.classified(records, F.col("question_text"), vocabulary, F.col("metadata.subject"))
    keep = F.lit(True)
    if subject is not None:
        keep = keep & (F.col("subject") == subject)
    if kind is not None:
        keep = keep & (F.coalesce(F.nullif(F.col("question_type"), F.lit("")), F.lit("standard")) == kind)
    best = search(x, key, F.col("question_text"), query, k, keep)
    best = best.select(F.col(key).alias("__key"), "score")
    rows = records.join(F.broadcast(best), F.col(key) == F.col("__key"))
    rows = topics.classified(rows, F.col("question_text"), vocabulary, F.col("metadata.subject"))
    return rows.orderBy(F.desc(F.round("score", 9)), key).select(*records.columns, F.round("score", 4).alias("_retrieval_score"), F.col("subject").alias("_subject"), F.col("topic").alias("_topic"))


#: Parts of the terms, and of the keys, that postings of a stored index are dealt out by.
PARTS, SLICES = 64, 8

#: The code of a row that stands for a document.
DOCUMENT = -1


def _counted(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, dl, term, tf), and a row without a term for each document. A document's tokens are sorted and counted in its row, so that nothing is shuffled for it."""
    tok = docs.select(F.col(key).alias("key"), F.sort_array(tokens(text)).alias("t")).select("key", "t", F.size("t").alias("n"))
    # Where a run of equal tokens begins; -1 is the document's row.
    starts = F.filter(F.sequence(F.lit(-1), F.col("n") - 1), lambda i: (i <= 0) | (F.get("t", i) != F.get("t", i - 1)))
    run = lambda i, j: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("starts", j + 1), F.col("n")) - i).cast("long").alias("tf"))
    rows = tok.select("key", "t", "n", starts.alias("starts")).select("key", F.col("n").cast("long").alias("dl"), F.explode(F.transform("starts", run)).alias("x"))
    return rows.select("key", "dl", "x.term", "x.tf")


def write_index(docs: DataFrame, key: str, text: Column, path: str) -> None:
    """Postings (code, term, key, tf, dl) in the order of code, a number of the term, in each file, and the statistics. No two documents have one key.

    One pass over the texts and one shuffle. Numbers sort without comparing rows. A row per document (DOCUMENT) is written too, and the statistics are taken of these.
    """
    rows = _counted(docs, key, text).withColumn("code", F.coalesce(F.crc32("term"), F.lit(DOCUMENT).cast("long")))
    rows = rows.repartition(F.pmod("code", F.lit(PARTS)), F.pmod(F.xxhash64("key"), F.lit(SLICES))).sortWithinPartitions("code")
    # A dictionary of keys would not pay.
    rows.select("code", "term", "key", "tf", "dl").write.mode("overwrite").option("parquet.enable.dictionary#key", "false").parquet(f"{path}/postings")
    sizes = docs.sparkSession.read.parquet(f"{path}/postings").where(F.col("code") == DOCUMENT)
    sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{path}/statistics")


def search_index(spark: SparkSession, path: str, query: str, k: int = 8) -> DataFrame:
    """key, score of the k best documents of a stored index: only pages that may hold one of the query's terms are read."""
    terms = query_terms(query)
    stats = spark.read.parquet(f"{path}/statistics").first()
    rows = spark.read.parquet(f"{path}/postings")
    if not terms:
        return rows.select("key", F.lit(0.0).alias("score")).limit(0)
    import zlib

    mine = rows.where(F.col("code").isin(sorted({zlib.crc32(t.encode()) for t in terms})) & F.col("term").isin(terms))
    df = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not df:
        return mine.select("key", F.lit(0.0).alias("score"))
    d = F.create_map(*(F.lit(x) for pair in df.items() for x in pair))[F.col("term")]
    avgdl = max(1.0, stats["tokens"] / max(1, stats["n_docs"]))
    one = F.log(1 + (F.lit(stats["n_docs"]) - d + 0.5) / (d + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return mine.groupBy("key").agg(F.sum(one).alias("score")).orderBy(F.desc(F.round("score", 9)), "key").limit(k)
