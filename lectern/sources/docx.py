"""Word-processor packages to documents: ordered blocks, tables, images, headers and footers, media.

profile 'batch' keeps every image reference and fails without a body; 'single' also reads older image elements, resolves targets to package paths,
drops references without a target, and takes a missing body as empty.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import pieces
from lectern.schemas import DOCUMENT

# Name spaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
V = "{urn:schemas-microsoft-com:vml}"
MAIN, RELS = "word/document.xml", "word/_rels/document.xml.rels"
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_BREAKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
WITHOUT_RETURNS = {f"{W}tab": "\t", f"{W}br": "\n"}


def paragraph_text(p, breaks: dict[str, str] = _BREAKS) -> str:
    return "".join((e.text or "") if e.tag == f"{W}t" else breaks.get(e.tag, "") for e in p.iter()).strip()


def _style(p) -> str | None:
    found = p.find(f"{W}pPr/{W}pStyle")
    return None if found is None else found.get(f"{W}val")


def relationships(z: zipfile.ZipFile, single: bool) -> dict[str, str]:
    if RELS not in z.namelist():
        return {}
    rows = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(RELS)) if r.get("Id") and r.get("Target")}
    return {k: posixpath.normpath(v.lstrip("/") if v.startswith("/") else posixpath.join("word", v)) for k, v in rows.items()} if single else rows


def _images(element, rels: dict[str, str], single: bool) -> list[dict]:
    ids = [b.get(f"{R}embed") for b in element.iter(f"{A}blip")]
    if single:
        ids += [v.get(f"{R}id") for v in element.iter(f"{V}imagedata")]
    rows = [{"relationship_id": i, "target": rels.get(i)} for i in ids if i]
    if single:
        rows = [x for k, x in enumerate(rows) if x["target"] and x not in rows[:k]]
    return rows


def _paragraph(p, rels, single, breaks=_BREAKS) -> dict:
    return {"type": "paragraph", "text": paragraph_text(p, breaks), "style": _style(p), "images": _images(p, rels, single), "rows": None}


def _table(t, rels, single, breaks=_BREAKS) -> dict:
    rows = []
    for tr in t.findall(f"{W}tr"):
        cells = []
        for tc in tr.findall(f"{W}tc"):
            paragraphs = [{k: v for k, v in _paragraph(p, rels, single, breaks).items() if k != "rows"} for p in tc.iter(f"{W}p")]
            cells.append({"text": "\n".join(p["text"] for p in paragraphs if p["text"]), "paragraphs": paragraphs})
        rows.append({"cells": cells})
    return {"type": "table", "text": None, "style": None, "images": None, "rows": rows}


def _parts(z: zipfile.ZipFile, prefix: str, breaks=_BREAKS) -> dict[str, list[str]]:
    out = {}
    for name in z.namelist():
        if name.startswith(prefix) and name.endswith(".xml"):
            try:
                root = ElementTree.fromstring(z.read(name))
            except ElementTree.ParseError:
                continue
            out[name] = [t for t in (paragraph_text(p, breaks) for p in root.iter(f"{W}p")) if t]
    return out


def document_type(z: zipfile.ZipFile) -> str:
    kinds = z.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in z.namelist() else ""
    return "macro" if "macroEnabled.main+xml" in kinds else "standard" if "wordprocessingml.document.main+xml" in kinds else "unknown"


def extract(content: bytes, source: dict, profile: str = "batch", breaks: dict[str, str] | None = None) -> dict:
    """A document of DOCUMENT. breaks: text of elements by name, WITHOUT_RETURNS or {} for the plainer previews."""
    breaks = _BREAKS if breaks is None else breaks
    single = profile == "single"
    sha = hashlib.sha256(content).hexdigest()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if MAIN not in z.namelist():
            raise (KeyError if single else ValueError)(f"{MAIN} is missing")
        root = ElementTree.fromstring(z.read(MAIN))
        body, rels = root.find(f"{W}body"), relationships(z, single)
        if body is None and not single:
            raise ValueError("the document has no body")
        blocks = []
        for e in body if body is not None else ():
            if e.tag == f"{W}p":
                p = _paragraph(e, rels, single, breaks)
                if p["text"] or p["images"]:
                    blocks.append(p)
            elif e.tag == f"{W}tbl":
                blocks.append(_table(e, rels, single, breaks))
        media = [{"path": i.filename, "size_bytes": i.file_size} for i in z.infolist() if i.filename.startswith("word/media/") and not i.is_dir()]
        paragraphs = [b for b in blocks if b["type"] == "paragraph"]
        return {
            "document_id": sha[:16], "sha256": sha, "document_type": document_type(z), "source": source, "blocks": blocks,
            "headers_footers": {"headers": _parts(z, "word/header", breaks), "footers": _parts(z, "word/footer", breaks)}, "media": media,
            "statistics": {
                "paragraphs": len(paragraphs), "tables": len(blocks) - len(paragraphs), "media_files": len(media),
                "paragraphs_with_images": sum(bool(b["images"]) for b in paragraphs), "tables_anywhere": sum(1 for _ in root.iter(f"{W}tbl")),
            },
            "metadata_hints": {"years_from_path": sorted(set(_YEAR.findall(source.get("canonical_path") or "")))},
        }


def extract_documents(resolved: DataFrame, profile: str = "batch", breaks: dict[str, str] | None = None) -> DataFrame:
    """Rows of resolved(canonical_source_type, canonical_path, canonical_filename, canonical_extension, content, error) as status, error and document.

    A record that fails is a row with its error; the batch goes on. Filter to packages before: no filter is pushed through this.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, "content"):
            rows = []
            for kind, path, filename, extension, content, failed in zip(*(c.to_pylist() for c in part.columns), strict=True):
                source = {"source_type": kind, "canonical_path": path, "canonical_filename": filename, "extension": extension}
                try:
                    if failed is not None:
                        raise FileNotFoundError(failed)
                    rows.append(("ok", kind, path, None, json.dumps(extract(bytes(content), source, profile, breaks))))
                except Exception as error:  # noqa: BLE001  see above
                    rows.append(("error", kind, path, f"{type(error).__name__}: {error}", None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["status", "source_type", "source", "error", "json"])

    columns = ["canonical_source_type", "canonical_path", "canonical_filename", "canonical_extension", "content", "error"]
    rows = resolved.select(*columns).mapInArrow(run, "status string, source_type string, source string, error string, json string")
    return rows.withColumn("document", F.from_json("json", DOCUMENT)).drop("json")


def extraction_report(extracted: DataFrame) -> DataFrame:
    s = "document.statistics"
    return extracted.select("status", F.col("document.document_id").alias("document_id"), "source_type", "source", *(F.coalesce(F.col(f"{s}.{c}"), F.lit(0)).alias(c) for c in ("paragraphs", "tables", "media_files")), F.concat(F.col("document.document_id"), F.lit(".json")).alias("output"), "error")


def block_stats(documents: DataFrame) -> DataFrame:
    b = F.col("blocks")
    return documents.select(
        "document_id", F.size(F.filter(b, lambda x: x["type"] == "paragraph")).alias("paragraphs"), F.size(F.filter(b, lambda x: x["type"] == "table")).alias("tables"),
        F.size(F.filter(b, lambda x: (x["type"] == "paragraph") & (F.size(x["images"]) > 0))).alias("paragraphs_with_images"),
    )


def inspect(documents: DataFrame, paragraphs: int = 100, rows: int = 10, parts: int = 20) -> DataFrame:
    """A preview of each document: its first paragraphs, the first rows of its tables, the first texts of headers and footers."""
    b = F.col("blocks")
    cut = lambda m: F.transform_values(m, lambda _, v: F.slice(v, 1, parts))
    return documents.select(
        "document_id", "statistics", "media", F.slice(F.transform(F.filter(b, lambda x: x["type"] == "paragraph"), lambda x: F.struct(x["style"].alias("style"), x["text"].alias("text"))), 1, paragraphs).alias("paragraphs"),
        F.transform(F.filter(b, lambda x: x["type"] == "table"), lambda x: F.slice(F.transform(x["rows"], lambda r: F.transform(r["cells"], lambda c: c["text"])), 1, rows)).alias("tables"),
        cut(F.col("headers_footers.headers")).alias("headers"), cut(F.col("headers_footers.footers")).alias("footers"),
    )
