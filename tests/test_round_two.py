"""What the second review found."""

import re
import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import search
from lectern.plans import queries as Q
from lectern.sources import docx
from lectern.sources import files as sources

COLUMNS = "doc_id long, lang string, source string, n_chars long, text string"


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    return f"{tmp_path}/in"


def of_sql(path, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return con.sql(Q.oracle_sql()[name])


def same(spark, path, name):
    df = Q.queries()[name](spark, path)
    want = of_sql(path, name).select(*(f'"{c}"' for c in df.columns)).fetchall()
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


ODD = ["", None, " lead", "trail ", "  ", "\t", "\n", "\r", "a\rb", "\r\nx", '"', '""', 'a"', "\\", '\\"', "a,b", "#x", "x\n", '",\n"', '""\n', "\\\n", "null", "\u00a0"]


def test_csv_keeps_every_text(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ODD)), "i long, t string").coalesce(1)
    sources.write_csv(df, f"file://{tmp_path}/c")
    assert {r.i: r.t for r in sources.read_csv(spark, f"file://{tmp_path}/c", "i long, t string").collect()} == dict(enumerate(ODD))


def test_csv_query_keeps_every_text(spark, tmp_path):
    path = folder(spark, tmp_path, [(k, "en", "web", 1, t) for k, t in enumerate(ODD)])
    assert same(spark, path, "csv_round_trip")


def test_ties_of_retrieval_are_in_order_of_numbers(spark, tmp_path):
    path = folder(spark, tmp_path, [(k, "en", "web", 1, "the license") for k in range(1, 41)])
    assert [r.question_id for r in Q.queries()["retrieve"](spark, path).collect()] == [str(k) for k in range(1, 21)]
    assert same(spark, path, "retrieve")


def test_json_documents_are_written_by_tasks_and_read_many_at_once(spark, tmp_path):
    """No file of Spark's writer, none with a checksum, each text whole, and a task for many files."""
    df = spark.createDataFrame([(k, ODD[k % len(ODD)]) for k in range(300)], "i long, t string").repartition(3)
    path = f"file://{tmp_path}/j"
    for _ in range(2):
        sources.write_json_per_document(df, path)
    names = [f.name for f in (tmp_path / "j").iterdir() if not f.name.endswith("_SUCCESS") and not f.name.endswith("_SUCCESS.crc")]
    assert len(names) == 300 and all(n.startswith("part-") and n.endswith(".json") for n in names)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with sources.many_files(spark):
        back = sources.read_documents(spark, path, "i long, t string")
        assert back.rdd.getNumPartitions() <= 8
        assert {r.i: r.t for r in back.where("error is null").collect()} == {k: ODD[k % len(ODD)] for k in range(300)}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def batch(texts):
    return pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})


def test_workers_hold_pieces():
    texts = ["x" * 10] * 1000 + [None] + ["y" * (T.PIECE_BYTES // 2 + 1)] * 5 + ["z" * 3 * T.PIECE_BYTES, ""]
    parts = list(T.pieces([batch(texts), batch([])], "t"))
    assert [v for p in parts for v in p.column(0).to_pylist()] == texts
    for p in parts:
        size = sum(len(v or "") for v in p.column(0).to_pylist())
        assert p.num_rows <= T.PIECE_ROWS and (size <= T.PIECE_BYTES or p.num_rows == 1)


def test_packages_are_extracted_in_pieces(spark):
    """No batch that leaves the extraction is larger than a piece."""
    seen = []
    resolved = spark.createDataFrame([("loose_file", "x", "x", ".docx", b"", None)], "canonical_source_type string, canonical_path string, canonical_filename string, canonical_extension string, content binary, error string")

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            n = 3 * T.PIECE_ROWS
            columns = [["loose_file"] * n, ["x"] * n, ["x"] * n, [".docx"] * n, [b"no archive"] * n, [None] * n]
            seen.extend(run([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.binary(), pa.string()], strict=True)], names=list("abcd") + ["content", "error"])]))
            return spark.createDataFrame([], schema)

    assert docx.extract_documents(resolved).collect()[0].error.startswith("BadZipFile")
    docx.extract_documents(Frame())
    assert sum(b.num_rows for b in seen) == 3 * T.PIECE_ROWS and max(b.num_rows for b in seen) <= T.PIECE_ROWS


def test_inert_texts_are_their_own_form():
    """Each of the characters, and any two of them, are what normalisation leaves as they are; then so is any text of them, as none combines."""
    good = [chr(c) for c in range(0x2100) if re.fullmatch(f"[{re.sub(r'\\x{([0-9a-f]+)}', lambda m: re.escape(chr(int(m[1], 16))), T.INERT)}]", chr(c))]
    assert {"a", "é", "ß", "–", "’", "€"} < set(good) and not {"ª", "²", "½", "ﬁ", "́", " ", "…"} & set(good)
    for a in good:
        text = "".join(a + b for b in good)
        assert unicodedata.normalize("NFKC", text) == text and unicodedata.combining(a) == 0


def test_only_other_texts_travel_to_python(spark):
    texts = ["", "plain", "über – “ça”", "ﬁ ½ x", "é", "10â€“20 °", "Â½", "Ångström Å", "a b", None, "Ï€ Î¸", "жизнь̀"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")

    def plain(t):
        t = t or ""
        for bad, good in T.MOJIBAKE.items():
            t = t.replace(bad, good)
        t = unicodedata.normalize("NFKC", t).lower().translate(str.maketrans("–—−", "---"))
        t = re.sub(r"\s+", " ", t)
        return re.sub(r"\s*([,.;:!?()\[\]{}=+\-*/<>])\s*", r"\1", t).strip(" ")

    assert {r.i: r.n for r in df.select("i", T.normalize(F.col("t")).alias("n")).collect()} == {k: plain(t) for k, t in enumerate(texts)}
    seen = df.where(F.col("t").rlike(f"[^{T.INERT}]")).select("i").collect()
    assert {3, 4, 7, 11} <= {r.i for r in seen} and not {0, 1, 2} & {r.i for r in seen}


def test_other_terms_are_not_shuffled(spark):
    """The filter is below the first grouping of the postings."""
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b x")], "doc_id long, text string")
    index = search.postings(docs, "doc_id", F.col("text"))
    found = search.scores_from_index(index, search.lengths(docs, "doc_id", F.col("text")), "doc_id", "b zz")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "qterm" not in text and "term#" in text and "IN (b,zz)" in text
    lines = text.splitlines()
    k = next(k for k, x in enumerate(lines) if "IN (b,zz)" in x)
    assert any("Aggregate" in x for x in lines[:k]) and not any("Aggregate" in x for x in lines[k : k + 2]) and "Generate" in "".join(lines[k : k + 3])
    assert {r.doc_id for r in found.collect()} == {1, 2}
    assert search.scores_from_index(index, search.lengths(docs, "doc_id", F.col("text")), "doc_id", "?!").count() == 0
