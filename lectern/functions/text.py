"""Scalar functions over text columns: cleaning, normalising, tokens, years, fingerprints, paths, sizes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Repairs of text that was decoded with the wrong character set.
MOJIBAKE = {
    "â€“": "–", "â€”": "—", "â€˜": "‘", "â€™": "’", "â€œ": "“", "â€\x9d": "”", "Â±": "±",
    "Â½": "½", "Â¼": "¼", "Â¾": "¾", "âˆš": "√", "Ï€": "π", "Î¸": "θ", "Â°": "°",
}

TOKEN = "[a-z0-9]+(?:['’\\-][a-z0-9]+)*"
YEAR = "\\b(?:19|20)\\d{2}\\b"


#: A Python worker holds the objects of so many rows and bytes at once, however large the batches are that it is sent.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, bounded by the bytes of a column too; a row that is larger comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if k > start and (k - start >= PIECE_ROWS or total + n > PIECE_BYTES):
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space of any script, no-break spaces among them, become one space each, and none at the ends; a null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def filled(c: Column) -> Column:
    """Whether anything is left of a text that is collapsed; a null is empty."""
    return F.coalesce(c.rlike("(?U)\\S"), F.lit(False))


def repair(c: Column) -> Column:
    """All wrong sequences begin with one of few letters; a text without these is left alone."""
    out = c
    for bad, good in MOJIBAKE.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(c.rlike("[" + "".join(sorted({bad[0] for bad in MOJIBAKE})) + "]"), out).otherwise(c)


def clean(c: Column) -> Column:
    """Repaired and collapsed; a null is empty."""
    return collapse(repair(F.coalesce(c, F.lit(""))))


def _nfkc(s: pa.Array) -> pa.Array:
    if s.null_count == len(s):
        return s.cast(pa.string())
    batch = pa.RecordBatch.from_arrays([s], ["s"])
    normal = (pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in p.column(0).to_pylist()], pa.string()) for p in pieces([batch], "s"))
    return pa.concat_arrays(list(normal))


def _inert() -> str:
    """A character class of which any text is its own compatibility form: none of it combines. Single characters below 256 are one table for the matcher, ranges are tried in turn, so there are few."""
    good = lambda c: unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c))
    return "\\x00-\\x7f" + "".join(f"\\x{{{c:x}}}" for c in range(0x80, 0x100) if good(c)) + "\\x{2012}-\\x{2016}\\x{2018}-\\x{2022}\\x{20ac}"


INERT = _inert()


def normalize(c: Column, ascii_only: bool = False) -> Column:
    """The form that question texts and answers are compared in. ascii_only leaves out the one step that is no built-in, which ASCII does not need."""
    raw = F.coalesce(c, F.lit(""))
    if ascii_only:
        c = raw
    else:
        # Only texts with other characters than those of INERT travel to Python, once repaired; the rest as nulls.
        c = repair(raw)
        c = F.coalesce(F.arrow_udf(_nfkc, "string")(F.when(c.rlike(f"[^{INERT}]"), c)), c)
    c = F.translate(F.lower(c), "–—−", "---")
    c = F.regexp_replace(c, "(?U)\\s+", " ")
    return F.trim(F.regexp_replace(c, "\\s*([,.;:!?()\\[\\]{}=+\\-*/<>])\\s*", "$1"))


def clean_answer(c: Column, ascii_only: bool = False) -> Column:
    """Empty for a null or empty answer, else normalised."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(normalize(c, ascii_only))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def years(c: Column) -> Column:
    """Distinct years in a text, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(YEAR), F.lit(0))))


def year_hint(c: Column) -> Column:
    return F.array_join(years(c), ";")


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 0), F.lit("")).cast("int")


def fingerprint_of(kind: Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(F.nullif(kind, F.lit("")), F.lit("standard")), normalized), 256)


def fingerprint(kind: Column, question: Column, ascii_only: bool = False) -> Column:
    return fingerprint_of(kind, normalize(question, ascii_only))


def subject_hint(c: Column) -> Column:
    """Subject that a path names; chemistry comes before physics, biology and mathematics."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("chemistry"), "chemistry").when(low.contains("physics"), "physics")
        .when(low.contains("biology"), "biology").when(low.contains("math"), "mathematics")
    )


def contains_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    """Lower-case suffix of a file name with its dot; empty without one, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(c), "^.+(\\.[^.]+)$", 1))


def archive_path(archive: Column, member: Column) -> Column:
    return F.concat_ws("::", archive, member)


def split_archive_path(c: Column) -> tuple[Column, Column]:
    return F.regexp_extract(c, "(?s)^(.*?)::(.*)$", 1), F.regexp_extract(c, "(?s)^(.*?)::(.*)$", 2)


def format_bytes(c: Column) -> Column:
    size = c.cast("double")
    out = F.format_string("%.2f TB", size / 1024**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024 ** (k + 1), F.format_string(f"%.2f {unit}", size / 1024**k)).otherwise(out)
    return out


def rescue_json(c: Column) -> Column:
    """A JSON text: the whole, else from the first brace to the last, else from the first bracket to the last; else null. Compare as text."""
    tries = [c, F.regexp_extract(c, "(?s)\\{.*\\}", 0), F.regexp_extract(c, "(?s)\\[.*\\]", 0)]
    return F.coalesce(*(F.to_json(F.try_parse_json(F.nullif(F.trim(t), F.lit("")))) for t in tries))
