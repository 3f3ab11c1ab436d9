"""Token counts as rollups that signed changes maintain.

A batch of changes is summed per source, language and tokenizer version before it is stored, so that a rollup's state is a few rows per batch.
A batch is committed by a small file that bears its name and names the folder of its sums. That file is created exclusively, after the sums
are written: of several writers of a batch one succeeds, and a batch that is applied again, or whose job was restarted, changes nothing. Totals are sums
over the committed batches. (Object stores that offer no exclusive creation need one writer per batch.)
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import delete, materialise, new_path, scratch
from lectern.llm.pieces import encode_pieces

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/commits"))

    def _commit(self, batch_id: str):
        return self._path(f"{self.path}/commits/{quote(batch_id, safe='')}")

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._commit(batch_id))

    def _create(self, batch_id: str, content: bytes) -> bool:
        """Whether the commit file was not there and is now."""
        where = self._commit(batch_id)
        if self._fs.getUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates afterwards; the operating system does both at once.
            try:
                with open(where.toUri().getPath(), "xb") as f:
                    f.write(content)
                return True
            except FileExistsError:
                return False
        try:
            out = self._fs.create(where, False)
        except Exception:
            if self._fs.exists(where):
                return False
            raise
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return True

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits changes(action, source, lang, tokenizer_version, n_tokens, old_tokens), returns whether it was new.

        insert adds a document and its tokens, delete takes both away, revise replaces old_tokens by n_tokens. A null count is 0; null keys are a group of
        their own; other actions are an error, and nothing is committed. Repeated rows count each. An empty batch is committed too. Other columns are ignored.
        """
        if self.committed(batch_id):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        docs = F.when(F.col("action") == "insert", 1).when(F.col("action") == "delete", -1).when(F.col("action") == "revise", 0).otherwise(F.raise_error(F.lit("unknown action")).cast("int"))
        tokens = F.when(F.col("action") == "insert", n).when(F.col("action") == "delete", -n).otherwise(n - old)
        sums = changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        name = uuid.uuid4().hex
        sums.coalesce(1).write.parquet(f"{self.path}/sums/{name}")
        done = self._create(batch_id, name.encode())
        if not done:
            delete(self.spark, f"{self.path}/sums/{name}")
        return done

    def _names(self) -> list[str]:
        """Folders of sums that commit files name. A file without a whole name is of a writer that was lost within its commit, which is an error to be looked at."""
        names = []
        for status in self._fs.listStatus(self._path(f"{self.path}/commits")):
            if status.getPath().getName().startswith("."):
                continue
            stream = self._fs.open(status.getPath())
            try:
                name = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if len(name) != 32:
                raise RuntimeError(f"the commit {status.getPath().getName()} is not whole: delete it and apply its batch again")
            names.append(name)
        return names

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups whose documents are all gone are left out."""
        paths = [f"{self.path}/sums/{name}" for name in self._names()]
        stored = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = stored.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def inserted(docs: DataFrame, model_path: str, version: str) -> DataFrame:
    """Changes that insert docs(doc_id, text, source, lang) with the counts of a piece model: doc_id and the columns that apply() takes.

    Begin and end ids are counted. Rows that repeat a doc_id are inserted once each.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    counted = encode_pieces(keyed, model_path, carry=("source", "lang"))
    return counted.select("doc_id", F.lit("insert").alias("action"), "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def count(pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern)).cast("long")


#: Tokenizer versions of the query that SQL can count too. The first counted words between single spaces and was revised to any white space.
BLANK, SPACED = "[^ ]+", "[^\\x20\\x09-\\x0D]+"


def op5_delta_rollups(spark, sf_dir: str) -> DataFrame:
    """Loads all documents under words-1 and revises those counts, adds bytes-1 (UTF-8 bytes are the tokens), takes down documents of fewer than five words and brings them back, replays batches, and returns the totals of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    path = new_path(spark, "rollup")
    with scratch(spark) as keep:
        counted = materialise(docs.select("source", "lang", count(BLANK).alias("blank"), count(SPACED).alias("spaced"), size.alias("bytes")), "counts")
        rollup = TokenRollup(spark, path)

        def changes(rows: DataFrame, action: str, version: str, n: str, old: str | None = None) -> DataFrame:
            return rows.select(F.lit(action).alias("action"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

        short = counted.where("spaced < 5")
        batches = [
            ("load", changes(counted, "insert", "words-1", "blank")),
            ("revise", changes(counted.where("blank <> spaced"), "revise", "words-1", "spaced", "blank")),
            ("load", changes(counted, "insert", "words-1", "blank")),
            ("second version", changes(counted, "insert", "bytes-1", "bytes")),
            ("takedown", changes(short, "delete", "words-1", "spaced").unionAll(changes(short, "delete", "bytes-1", "bytes"))),
            ("takedown", changes(short, "delete", "words-1", "spaced")),
            ("back again", changes(short, "insert", "words-1", "spaced").unionAll(changes(short, "insert", "bytes-1", "bytes"))),
        ]
        for name, rows in batches:
            rollup.apply(name, rows)
        out = materialise(rollup.totals(), "totals")
        keep.append(out)
    delete(spark, path)
    return out


OP5_SQL = """
with counted as (
  select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as spaced, strlen(coalesce(text, '')) as bytes from documents)
select source, lang, 'words-1' as tokenizer_version, count(*)::bigint as n_docs, sum(spaced)::bigint as n_tokens from counted group by source, lang
union all
select source, lang, 'bytes-1', count(*)::bigint, sum(bytes)::bigint from counted group by source, lang
"""
