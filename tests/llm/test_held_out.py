"""Queries that SQL cannot state, on whole tables: held-out accuracy, and what their contracts say of each row."""

import collections
import os
import zlib

import pytest

from lectern.llm import queries as Q

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = Q.queries()["op2_naive_bayes_language_id"](spark, DATA).collect()
    assert len(got) == len(docs) and all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None}
    got = Q.queries()["op7_boosted_tree_toxicity"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    bad, good = ([r.score for r in got if r.held_out and labels.get(r.doc_id) == k] for k in (1, 0))
    assert bad and good and sum((x > y) + (x == y) / 2 for x in bad for y in good) / (len(bad) * len(good)) > 0.8


def test_shards(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = Q.queries()["op1_vector_bin_packing"](spark, DATA).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(docs) and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
