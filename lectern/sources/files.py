"""Scans of file trees and archives, tables, and the sinks of the batch."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import basename, extension, year_hint
from lectern.sources.shared import write_file

# Suffixes of the files that are taken in.
SUFFIXES = (".docx", ".doc", ".pdf", ".xls", ".zip")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content, relative_path, filename and extension of the files under root; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = F.expr("substring(__p, instr(__p, __root) + length(__root) + 1)")
    x = files.withColumn("__p", path).withColumn("__root", F.lit(top)).withColumn("relative_path", relative)
    return x.select("path", "length", "content", "relative_path", basename(F.col("relative_path")).alias("filename"), extension(F.col("relative_path")).alias("extension"))


def inventory(spark: SparkSession, root: str, suffixes=SUFFIXES) -> DataFrame:
    files = scan(spark, root)
    keep = ~F.col("filename").startswith("~$") & F.col("extension").isin(*suffixes)
    return files.where(keep).select("filename", "extension", F.col("length").alias("size_bytes"), "relative_path", F.sha2("content", 256).alias("sha256"))


def _members(with_content: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["relative_path"], part["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for place, info in enumerate((i for i in z.infolist() if not i.is_dir()), 1):
                            data = z.read(info)
                            rows.append((archive, place, info.filename, info.file_size, hashlib.sha256(data).hexdigest(), data if with_content else None, None))
                except Exception as error:  # noqa: BLE001  one bad archive is a row, not the end of the batch
                    rows = [(archive, None, None, None, None, None, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["archive", "place", "member_path", "size_bytes", "sha256", "content", "error"]).astype({"place": "Int32", "size_bytes": "Int64"})

    return run


def archive_members(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Members of all zip archives under root; an archive that cannot be read gives one row with its error."""
    zips = scan(spark, root).where("extension = '.zip'").select("relative_path", "content")
    return zips.mapInPandas(_members(with_content), "archive string, place int, member_path string, size_bytes long, sha256 string, content binary, error string")


def archive_inventory(members: DataFrame) -> DataFrame:
    """In the form of ARCHIVE_INVENTORY."""
    rows = members.where("error is null")
    return rows.select("archive", "member_path", extension(F.col("member_path")).alias("extension"), "size_bytes", year_hint(F.concat_ws(" ", "archive", "member_path")).alias("year_hint"), "sha256")


def archive_listing(members: DataFrame, most: int = 50) -> DataFrame:
    """The first members of each archive in its own order, and the error of one that cannot be read."""
    return members.where(F.col("error").isNotNull() | (F.col("place") <= most)).select("archive", "place", "member_path", "size_bytes", "error")


def resolve(corpus: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """corpus(canonical_source_type, canonical_path, ...) with content and an error where the source is missing or of an unknown kind. Each archive is read once."""
    files = scan(spark, root).select(F.lit("loose_file").alias("t"), F.col("relative_path").alias("p"), "content")
    members = archive_members(spark, root, with_content=True).where("error is null")
    inside = members.select(F.lit("archive_member").alias("t"), F.concat_ws("::", "archive", "member_path").alias("p"), "content")
    got = corpus.join(files.unionAll(inside), (F.col("canonical_source_type") == F.col("t")) & (F.col("canonical_path") == F.col("p")), "left")
    known = F.col("canonical_source_type").isin("loose_file", "archive_member")
    error = F.when(~known, F.concat(F.lit("ValueError: unknown source type "), "canonical_source_type")).when(F.col("content").isNull(), F.concat(F.lit("FileNotFoundError: "), "canonical_path"))
    return got.withColumn("error", error).drop("t", "p")


#: Of both directions, so that every text comes back as it was: white space at its ends, an empty text beside a null, returns and feeds. A separator of lines that is given is not guessed from the first text.
_CSV = {"quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

#: What nothing between separators is read as, so that "" stays an empty text: two characters that Unicode keeps out of texts.
_NO_TEXT = "\ufdd0\uffff"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, nullValue=_NO_TEXT, **_CSV)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document per file, or a file that is one array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, **_CSV | {"emptyValue": '""'})


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, with nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _files_of_rows(folder: str):
    """Writes each row of (json) as a file of the folder. Names depend on the partition and the row, so that a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                name = f"{folder}/part-{part:05d}-{n:08d}.json"
                with open(f"{name}.{os.getpid()}.tmp", "wb") as out:
                    out.write(text.as_buffer())
                    out.write(b"\n")
                os.replace(out.name, name)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return run


def write_json_per_document(df: DataFrame, path: str, key: str | None = None) -> None:
    """A file per document or, if a key is given, a folder per document that bears it, which costs far more; the documents keep their key.

    Spark's writer forks a process for each file that it creates in a mounted folder, adds one with its checksum, and has the driver rename both. There the tasks
    write the files themselves; the folder must be mounted where they run, as a shared one is. Other stores are left to that writer.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if key is None and fs.getUri().getScheme() == "file":
        fs.delete(p, True)
        fs.mkdirs(p)
        rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary").alias("json"))
        rows.mapInArrow(_files_of_rows(p.toUri().getPath()), "n long").agg(F.sum("n")).collect()
        write_file(spark, f"{path}/_SUCCESS", b"")
        return
    if key is None:
        df.write.mode("overwrite").option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)
        return
    df.withColumn("__document", F.col(key)).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("__document").json(path)


@contextmanager
def many_files(spark: SparkSession, cost: int = 64 << 10) -> Iterator[None]:
    """Reads that run in it count so many bytes for opening a file, so that a task takes some 2,000 small ones; by Spark's default of 4 MB it takes 32."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, cost)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a folder per document or a file each, and error, the text of one that is no JSON object; it ends nothing. Run what reads many of them in many_files()."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").schema(f"{schema}, __corrupt string").json(path)
    return rows.withColumn("error", F.when(F.col("__corrupt").isNotNull(), F.concat(F.lit("JSONDecodeError: "), F.substring("__corrupt", 1, 200)))).drop("__corrupt")


def usable_fields(questions: DataFrame) -> DataFrame:
    """What is shown of sample questions."""
    return questions.select("id", "competition", "subject", "topic", "difficulty")


def as_json_array(df: DataFrame) -> DataFrame:
    """A report of bounded size as one row with a JSON array; write rows of unbounded number with write_jsonl()."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("json"))


