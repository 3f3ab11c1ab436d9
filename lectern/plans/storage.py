"""Queries of sources and sinks: files that the query writes itself, packages made of all documents, and tables written and read again."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import pieces
from lectern.operators import files as ops
from lectern.sources import docx, files
from lectern.sources.shared import delete, new_path, stored, write_file

TYPES = '<Types><Override ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
SPACES = f'xmlns:w="{docx.W[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:r="{docx.R[1:-1]}"'


def _zip(parts: dict[str, bytes]) -> bytes:
    """An archive whose bytes depend on its parts alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def package(paragraphs: list[str], cells: list[str], header: str) -> bytes:
    """A small word-processor package: paragraphs, the first with an image, one table of one row, a header, a medium."""
    text = lambda t: f"<w:p><w:pPr><w:pStyle w:val=\"Body\"/></w:pPr><w:r><w:t xml:space=\"preserve\">{escape(t)}</w:t></w:r>"
    body = "".join(text(t) + ('<w:r><a:blip r:embed="r1"/></w:r>' if k == 0 else "") + "</w:p>" for k, t in enumerate(paragraphs))
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{text(c)}</w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>"
    return _zip(
        {
            "[Content_Types].xml": TYPES.encode(), docx.MAIN: f"<w:document {SPACES}><w:body>{body}{table}</w:body></w:document>".encode(),
            docx.RELS: b'<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>', "word/header1.xml": f"<w:hdr {SPACES}>{text(header)}</w:p></w:hdr>".encode(), "word/media/i.png": b"\x89PNG",
        }
    )


_INNER = package(["Inner", "two"], ["c"], "h")
#: Files of the source queries, by path.
FILES = {
    "a/paper 2019.docx": package(["One", "two"], ["a", "b"], "top"), "a/~$paper.docx": b"lock", "a/notes.txt": b"n", "b/Copy of inner.docx": _INNER, "b/UPPER.PDF": b"%PDF",
    "b/members.zip": _zip({"x/inner 2021.docx": _INNER, "x/": b"", "~$x.docx": b"", "0 first.pdf": b"p", "deep/a/b.doc": b"d"}), "bad.zip": b"no archive",
}


def _tree(spark: SparkSession) -> str:
    root = new_path(spark, "tree")
    for path, content in FILES.items():
        write_file(spark, f"{root}/{path}", content)
    return root


def _of_tree(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a query over the tree of files, which is deleted afterwards."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _tree(spark)
        rows = query(spark, root)
        out = spark.createDataFrame(rows.collect(), rows.schema)
        delete(spark, root)
        return out

    return run


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    loose = ops.loose_candidates(files.inventory(spark, root)).withColumn("rank", F.lit(0))
    inside = ops.archive_candidates(files.archive_inventory(files.archive_members(spark, root))).withColumn("rank", F.lit(1))
    return loose.unionByName(inside).withColumn("ord", F.concat_ws(" ", "rank", "source_path")).drop("rank")


def _resolved(spark: SparkSession, root: str) -> DataFrame:
    corpus = ops.unified_corpus(_candidates(spark, root)).select("canonical_source_type", "canonical_path")
    more = spark.createDataFrame([("loose_file", "gone.docx"), ("elsewhere", "x")], "canonical_source_type string, canonical_path string")
    rows = files.resolve(corpus.unionByName(more), spark, root)
    return rows.select("canonical_source_type", "canonical_path", F.sha2("content", 256).alias("sha256"), "error")


#: Characters that a package cannot hold, or not as they are.
_BARE = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{fffe}\\x{ffff}]"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a package, in the form of resolve(); every tenth is broken."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            doc, source, lang, text = (c.to_pylist() for c in part.columns)
            content = [b"broken" if k % 10 == 0 else package(t.split("\n"), [s or "", x or ""], s or "") for k, s, x, t in zip(doc, source, lang, text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(source, pa.string()), pa.array(content, pa.binary())], ["doc_id", "source", "content"])

    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" 2020.docx"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _BARE, " ")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "source", "lang", text.alias("text"))
    return docs.mapInArrow(pack, "doc_id long, source string, content binary").select(
        F.lit("loose_file").alias("canonical_source_type"), F.concat("source", F.lit("/"), name).alias("canonical_path"), name.alias("canonical_filename"), F.lit(".docx").alias("canonical_extension"),
        "content", F.lit(None).cast("string").alias("error"),
    )


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.extract_documents(ops.packages(_packages(spark, sf_dir)))


def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("document")
    paragraphs = F.filter(d["blocks"], lambda b: b["type"] == "paragraph")
    table = F.filter(d["blocks"], lambda b: b["type"] == "table")[0]["rows"][0]["cells"]
    return _extracted(spark, sf_dir).where("status = 'ok'").select(
        F.col("source").alias("path"), d["document_type"].alias("document_type"), F.array_join(F.transform(paragraphs, lambda b: b["text"]), "\n").alias("text"), F.array_join(F.transform(table, lambda c: c["text"]), "|").alias("cells"),
        F.get(paragraphs, F.lit(0))["style"].alias("style"), F.get(paragraphs, F.lit(0))["images"][0]["target"].alias("image"), F.array_join(d["headers_footers"]["headers"]["word/header1.xml"], "|").alias("header"),
        d["media"][0]["path"].alias("medium"), d["media"][0]["size_bytes"].alias("medium_bytes"), F.array_join(d["metadata_hints"]["years_from_path"], ";").alias("years"), d["statistics"]["tables_anywhere"].alias("tables_anywhere"),
    )


def docx_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.extraction_report(_extracted(spark, sf_dir)).select("status", "source_type", "source", "paragraphs", "tables", "media_files", "error")


def docx_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _extracted(spark, sf_dir).where("status = 'ok'")
    rows = stored(good.select("source", "document.document_id", F.col("document.blocks").alias("blocks")), "documents")
    out = docx.block_stats(rows)
    return rows.select("source", F.col("document_id").alias("d")).join(out.distinct(), F.col("d") == F.col("document_id")).select("source", "paragraphs", "tables", "paragraphs_with_images")


COLUMNS = "doc_id bigint, lang string, source string, n_chars bigint, text string"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", "text")


def _round_trip(write, read) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "trip")
        write(_documents(spark, sf_dir), path)
        with files.many_files(spark):
            out = stored(read(spark, path).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha256")), "trip-rows")
        delete(spark, path)
        return out

    return run


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents as one report, read back."""
    path = new_path(spark, "array")
    groups = ops.hash_groups(_documents(spark, sf_dir).withColumn("sha256", F.sha2("text", 256)))
    files.as_json_array(groups).select("json").coalesce(1).write.text(path)
    out = stored(files.read_json_documents(spark, path, "sha256 string, n bigint"), "array-rows")
    delete(spark, path)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_inventory": _of_tree(files.inventory),
        "archive_members": _of_tree(lambda s, root: files.archive_inventory(files.archive_members(s, root))),
        "archive_listing": _of_tree(lambda s, root: files.archive_listing(files.archive_members(s, root))),
        "scan_unified": _of_tree(lambda s, root: ops.in_path_order(ops.unified_corpus(_candidates(s, root)))),
        "scan_only_in_archives": _of_tree(lambda s, root: ops.packages(ops.unified_corpus(_candidates(s, root))).select("canonical_path").unionByName(ops.only_in_archives(ops.unified_corpus(_candidates(s, root))).select("canonical_path"))),
        "resolve_sources": _of_tree(_resolved),
        "docx_blocks": docx_blocks,
        "docx_report": docx_report,
        "docx_block_stats": docx_block_stats,
        "csv_round_trip": _round_trip(files.write_csv, lambda s, path: files.read_csv(s, path, COLUMNS)),
        "jsonl_round_trip": _round_trip(files.write_jsonl, lambda s, path: files.read_jsonl(s, path, COLUMNS)),
        "json_documents_round_trip": _round_trip(files.write_json_per_document, lambda s, path: files.read_documents(s, path, COLUMNS).where("error is null")),
        "json_array_round_trip": json_array,
    }


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


def oracle_sql() -> dict[str, str]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    paper, inner, members = FILES["a/paper 2019.docx"], _INNER, FILES["b/members.zip"]
    lines = "raw as (select *, source || '/d' || doc_id || ' 2020.docx' as path, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}]', ' ', 'g'), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents), "
    lines += "trimmed as (select * replace (regexp_replace(t, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') as t) from raw), "
    # The first paragraph has an image, and is kept even if it has no text.
    lines += "kept as (select * from trimmed where t <> '' or k = 1)"
    trip = "select doc_id, lang, source, n_chars, sha256(text) as sha256 from documents"
    small = "::bigint"
    return {
        "scan_inventory": _values([("paper 2019.docx", ".docx", len(paper), "a/paper 2019.docx", sha(paper)), ("Copy of inner.docx", ".docx", len(inner), "b/Copy of inner.docx", sha(inner)), ("UPPER.PDF", ".pdf", 4, "b/UPPER.PDF", sha(b"%PDF")), ("members.zip", ".zip", len(members), "b/members.zip", sha(members)), ("bad.zip", ".zip", 10, "bad.zip", sha(b"no archive"))], "filename, extension, size_bytes, relative_path, sha256"),
        "archive_members": _values([("b/members.zip", "x/inner 2021.docx", ".docx", len(inner), "2021", sha(inner)), ("b/members.zip", "~$x.docx", ".docx", 0, "", sha(b"")), ("b/members.zip", "0 first.pdf", ".pdf", 1, "", sha(b"p")), ("b/members.zip", "deep/a/b.doc", ".doc", 1, "", sha(b"d"))], "archive, member_path, extension, size_bytes, year_hint, sha256"),
        "archive_listing": _values([("b/members.zip", 1, "x/inner 2021.docx", len(inner), None), ("b/members.zip", 2, "~$x.docx", 0, None), ("b/members.zip", 3, "0 first.pdf", 1, None), ("b/members.zip", 4, "deep/a/b.doc", 1, None), ("bad.zip", None, None, None, "BadZipFile: File is not a zip file")], "archive, place, member_path, size_bytes, error"),
        # The copy scores 10 for its path, as the member does for being one; the loose file is the first.
        "scan_unified": _values([(sha(paper), "loose_file", "paper 2019.docx", ".docx", "a/paper 2019.docx", len(paper), 1, "a/paper 2019.docx"), (sha(inner), "loose_file", "Copy of inner.docx", ".docx", "b/Copy of inner.docx", len(inner), 2, "b/Copy of inner.docx | b/members.zip::x/inner 2021.docx"), (sha(b"%PDF"), "loose_file", "UPPER.PDF", ".pdf", "b/UPPER.PDF", 4, 1, "b/UPPER.PDF"), (sha(b"p"), "archive_member", "0 first.pdf", ".pdf", "b/members.zip::0 first.pdf", 1, 1, "b/members.zip::0 first.pdf"), (sha(b"d"), "archive_member", "b.doc", ".doc", "b/members.zip::deep/a/b.doc", 1, 1, "b/members.zip::deep/a/b.doc")], "sha256, canonical_source_type, canonical_filename, canonical_extension, canonical_path, size_bytes, source_count, all_sources"),
        "scan_only_in_archives": _values([("a/paper 2019.docx",), ("b/Copy of inner.docx",), ("b/members.zip::0 first.pdf",), ("b/members.zip::deep/a/b.doc",)], "canonical_path"),
        "resolve_sources": _values([("loose_file", "a/paper 2019.docx", sha(paper), None), ("loose_file", "b/Copy of inner.docx", sha(inner), None), ("loose_file", "b/UPPER.PDF", sha(b"%PDF"), None), ("archive_member", "b/members.zip::0 first.pdf", sha(b"p"), None), ("archive_member", "b/members.zip::deep/a/b.doc", sha(b"d"), None), ("loose_file", "gone.docx", None, "FileNotFoundError: gone.docx"), ("elsewhere", "x", None, "ValueError: unknown source type elsewhere")], "canonical_source_type, canonical_path, sha256, error"),
        "docx_blocks": f"with {lines} select path, 'standard' as document_type, string_agg(t, chr(10) order by k) as text, any_value(source) || '|' || any_value(lang) as cells, 'Body' as style, 'media/i.png' as image, any_value(source) as header, 'word/media/i.png' as medium, 4::bigint as medium_bytes, '2020' as years, 1 as tables_anywhere from kept where doc_id % 10 <> 0 group by doc_id, path",
        "docx_report": f"with {lines} select case when doc_id % 10 = 0 then 'error' else 'ok' end as status, 'loose_file' as source_type, path as source, (case when doc_id % 10 = 0 then 0 else count(*) end)::int as paragraphs, (case when doc_id % 10 = 0 then 0 else 1 end)::int as tables, (case when doc_id % 10 = 0 then 0 else 1 end)::int as media_files, case when doc_id % 10 = 0 then 'BadZipFile: File is not a zip file' end as error from kept group by doc_id, path",
        "docx_block_stats": f"with {lines} select path as source, count(*)::int as paragraphs, 1 as tables, 1 as paragraphs_with_images from kept where doc_id % 10 <> 0 group by doc_id, path",
        "csv_round_trip": trip,
        "jsonl_round_trip": trip,
        "json_documents_round_trip": trip,
        "json_array_round_trip": f"select sha256(text) as sha256, count(*){small} as n from documents group by 1 having count(*) > 1",
    }
