"""Each operator on small tables: against brute force or a round trip, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, hnsw, langid, neardup, pieces, rollups, shards, toxicity, urls, warc
from lectern.llm.common import connected_components, new_path, shared_dir

ODD = "doc_id long, text string, lang string, source string, score double, component_id long, item long, n long"


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (7, "x" * 300_000), (8, "a b " * 50_000), (9, "12 % 34"), (10, "Ünï \x00 ▁ 漢字 \U0001f600")]
    return spark.createDataFrame([(i, t, None, None, 0.5, 3, 4, 5) for i, t in rows], ODD)


def prose(rng, n, words="the of and tion ing er le la que und der ein ment".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(400, 400), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard_roots(texts, k, percent):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "direct"), [(3, 85, 2048), (5, 80, 4)])
def test_near_duplicates_equal_brute_force(spark, k, percent, direct):
    rng = random.Random(k)
    texts = {}
    for g in range(12):
        base = prose(rng, rng.choice((4, 30, 120))).split()
        for _ in range(rng.choice((1, 3, 12))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {900: None, 901: "", 902: "word", 903: "WORD"}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, percent, direct=direct).collect()
    roots, sizes = jaccard_roots(texts, k, percent)
    assert {r.doc_id: r.component_id for r in got} == roots
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_of_large_buckets_are_found(spark, monkeypatch):
    """Buckets by hand: a pair that shares nothing but a large bucket, and one whose first band and largest key is a large bucket beside a small one."""
    rng = random.Random(8)
    texts = {i: prose(rng, 60) for i in range(16)}
    texts[2], texts[12] = texts[1] + " end", texts[11] + " end"
    keys = {i: [7] for i in range(6)} | {i: [100] for i in range(10, 16)} | {9: [50], 11: [100, 50], 12: [100, 50]}
    table, real = spark.createDataFrame(list(keys.items()), "key_id long, by_hand array<long>"), neardup.sketches

    def sketches(*args):
        return real(*args).join(table, F.col("doc_id") == F.col("key_id")).select("doc_id", "n", "h1", "h2", F.col("by_hand").alias("keys"), "planes")

    monkeypatch.setattr(neardup, "sketches", sketches)
    docs = spark.createDataFrame([(i, texts[i]) for i in keys], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85, direct=3).collect()}
    assert got == jaccard_roots({i: texts[i] for i in keys}, 3, 85)[0] and (got[2], got[12]) == (1, 11)


@pytest.mark.parametrize("percent", [80, 85])
def test_filter_misses_no_more_than_banding(spark, percent):
    """Planes that differ in k places pass the filter, until pairs at the threshold that differ in more are rarer than pairs without a common band."""
    p, banding = (1 - percent / 100) * 15 / 16, (1 - (percent / 100) ** neardup.ROWS) ** neardup.BANDS
    rows = [(k, [0] * 8, [(1 << min(k, 63)) - 1, (1 << max(k - 63, 0)) - 1] + [0] * 6) for k in range(126)]
    limit = neardup.most_differing(percent)
    passed = {r.k for r in spark.createDataFrame(rows, "k int, a array<long>, b array<long>").where(neardup._resemble("a", "b", limit)).collect()}
    assert passed == set(range(limit + 1))
    assert sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(limit + 1, 129)) <= banding


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.unique(np.concatenate((a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64))))
    s = neardup.superminhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 200)
    assert abs((s[0] == s[1]).mean() - 300 / (len(a) + len(b) - 300)) < 0.1


@pytest.mark.parametrize("shard", [16_384, 40])
def test_near_vectors_equal_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = [(base[k % 12] + rng.normal(size=16) * rng.choice([0, 0.02, 0.2])).tolist() for k in range(150)]
    rows = [(k, v, k % 2) for k, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, x[0], None), (505, [], 0), (506, [1.0], 0)]
    got = {r.vec_id: r for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard, block=20).collect()}
    assert len(got) == len(rows)
    for k in (500, 501, 502, 503, 504, 505, 506):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (np.arange(150)[:, None] % 2 == np.arange(150) % 2)
    np.fill_diagonal(links, False)
    assert [got[k].n_links for k in range(150)] == links.sum(1).tolist()
    low = np.arange(150)
    for _ in range(150):
        low = np.minimum(low, np.where(links, low[None, :], 999).min(1))
    assert [got[k].component_id for k in range(150)] == low.tolist()


def test_pieces_equal_the_library(spark):
    spm = pytest.importorskip("sentencepiece")
    path = pieces.default_model()
    sp, model, rng = spm.SentencePieceProcessor(model_file=path), pieces.PieceModel(open(path, "rb").read()), random.Random(4)
    some = list(model.text.values())
    texts = ["", " a", "\x00b", "a▁b", "\n", "<s></s><unk>", "<0x0A>", "�é日本\U0001f600", "aaaa" * 9, *(" " * k + "x" + " " * k for k in range(40))]
    texts += ["".join(rng.choice(some).replace("▁", " ") if rng.random() < 0.8 else rng.choice("aé\n漢 ") for _ in range(6)) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == sp.decode(ids), t
    rows = pieces.encode_pieces(odd_docs(spark), path, with_ids=True).collect()
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(odd_docs(spark).collect(), key=lambda d: d.doc_id or 0), strict=True):
        ids = sp.encode(d.text or "", add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_shards(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(1, 60))) for k in range(600)] + [(1000 + k, "the same text") for k in range(400)] + [(3000, None), (3001, "")]
    got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    sizes, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    text = dict(rows)
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Only what exceeds a fair share, of the rows here, is split, and into no more parts than it must.
    assert all(len(s) == 1 for t, s in where.items() if t != "the same text") and len(where["the same text"]) == 2


def test_rollups_are_idempotent(spark):
    roll = rollups.TokenRollup(spark, new_path(spark, "test-rollup"))
    batch = spark.createDataFrame([("insert", "s", "en", "v", 5, None), ("insert", "s", None, "v", None, None), ("insert", "s", "en", "v", 7, None)], "action string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long")
    assert roll.apply("one", batch) and not roll.apply("one", batch)
    change = spark.createDataFrame([("revise", "s", "en", "v", 9, 7), ("delete", "s", "en", "v", 5, None), ("delete", "s", None, "v", None, None)], batch.schema)
    assert roll.apply("two/x", change) and not roll.apply("two/x", change)
    assert roll.apply("empty", batch.limit(0))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "v", 1, 9)]


def test_urls(spark):
    cases = {"http://Example.com/en/1": "example.com/en/", "https://www.example.com/en/": "www.example.com/en/", "http://a.b.net/fr/x?y": "net/fr/", "http://x.com": None, "http://x.com/": "com/", None: None, "no": None, "http://xexample.org/en/": None, "a://b.com#/x": None}
    rows = spark.createDataFrame([(k, u, "n") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(rows).collect()}
    assert [got[k].rule for k in range(len(cases))] == list(cases.values())
    assert (got[0].host, got[0].path) == ("example.com", "/en/1") and (got[5].host, got[5].path) == ("", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    table = urls.labelled_urls()
    model = urls.fit([t for k, t in enumerate(table) if k % 4])
    import pyarrow as pa

    held = [t for k, t in enumerate(table) if not k % 4]
    p = model.score(pa.array([t[0] for t in held]), pa.array([t[1] for t in held]))
    assert np.mean((p >= 0.5) == [t[2] == 1 for t in held]) > 0.9


def test_language_and_toxicity_on_odd_rows(spark):
    rng = random.Random(6)
    words = {"en": "the of and thing".split(), "de": "der und keit schön".split()}
    rows = [(100 + k, prose(rng, 30, words[("en", "de")[k % 2]]), ("en", "de")[k % 2], None, 0.0, 0, 0, 0) for k in range(80)]
    train = spark.createDataFrame(rows, ODD)
    model = langid.fit(train.where("doc_id < 160"))
    got = {r.doc_id: r for r in langid.identify(train, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows if r[0] >= 160)
    odd = langid.identify(odd_docs(spark), model).collect()
    assert len(odd) == 11 and {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert model.predict(["½ ² ٣ ① Ⅷ 12"])[0] == ["und"]
    assert {r.lang_pred for r in langid.identify(train, langid.fit(train.limit(0))).collect()} == {"und"}
    toxic = spark.createDataFrame([(r[0], r[1] + (" you idiot moron scum" if r[0] % 3 == 0 else "")) for r in rows], "doc_id long, text string")
    labels = toxic.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).unionAll(spark.createDataFrame([(None, 1), (101, None)], "doc_id long, toxic int"))
    model = toxicity.fit(toxic, labels.where("doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.toxicity(toxic, model).collect()}
    assert all(got[k].predicted == int(k % 3 == 0) for k in range(160, 180))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd_docs(spark), model).collect())
    assert toxicity.toxicity(odd_docs(spark), toxicity.fit(toxic, labels.limit(0))).count() == 11


def test_warc(spark):
    rng = random.Random(7)
    html = {1: None, 2: "", 3: "x\r\n\r\nWARC/1.0\r\n", 4: prose(rng, 9000), 5: "same", 6: "same", 7: "same", 8: "é" * 40_000}
    rows = spark.createDataFrame([(k, f"http://h/\n{k}", h, "z") for k, h in html.items()] + [(6, "http://h/6", "same", "z"), (None, None, None, None)], "page_id long, url string, html string, sha string")
    path = new_path(spark, "test-warc")
    warc.archive(rows, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert sorted(got) == sorted(html)
    for k, h in html.items():
        data = (h or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: got[k].refers_to for k in html if got[k].record_type == "revisit"} == {1: 2, 5: 7, 6: 7}
    body = warc.chunked(b"abc" * 9999)
    assert warc.unchunked(body) == b"abc" * 9999
    with pytest.raises(ValueError):
        warc.unchunked(body[:-9])


def split_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_overlaps(docs, items):
    """(document, item) to (passing windows, most equal tokens, first token), by looking at all windows of all alignments; no masks."""
    places = collections.defaultdict(list)
    size = {}
    for i, text in items.items():
        v = split_words(text)
        size[i] = len(v)
        for q, w in enumerate(v):
            places[w].append((i, q))
    want = {}
    for d, text in docs.items():
        same = collections.defaultdict(list)
        for p, w in enumerate(split_words(text)):
            for i, q in places.get(w, ()):
                same[(i, p - q)].append(p)
        for (i, _), at in same.items():
            n = min(13, size[i])
            need = size[i] if size[i] < 8 else -(-n * 10 // 13)
            for s in range(min(at) - 13, max(at) + 1):
                got = sum(s <= p < s + n for p in at)
                if got >= need:
                    windows, most, first = want.get((d, i), (0, 0, 10**9))
                    want[(d, i)] = (windows + 1, max(most, got), min(first, max(0, s)))
    return want


def test_masks_miss_no_admitted_pattern():
    """For each length of an item, each way to place the substitutions that are allowed leaves a mask whole at some place."""
    for n in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        allowed = n + -n * decontaminate.MATCHES // decontaminate.WINDOW
        for changed in itertools.combinations(range(n), allowed):
            assert any(all(mask[k - at] == "0" for k in changed if 0 <= k - at < len(mask)) for mask in decontaminate.MASKS for at in range(n - len(mask) + 1)), (n, changed)
    assert all(m[0] == m[-1] == "1" and "0" in m for m in decontaminate.MASKS)


@pytest.mark.parametrize("piece", [1024, 20])
def test_overlaps_equal_brute_force(spark, piece):
    rng = random.Random(8)
    items = {k: prose(rng, n) for k, n in enumerate((5, 9, 20, 40, 1, 8, 12))}
    docs = {}
    for k in range(80):
        words = prose(rng, 200).split()
        if k % 2:
            passage = items[k % 7].split()
            for _ in range(rng.choice((0, 1, 2, 3))):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.choice((0, rng.randrange(200), 200))
            words[at:at] = passage
        docs[k] = " ".join(words)
    docs |= {200: items[0], 201: " ".join(items[3].split()[:11]), 202: prose(rng, 30_000) + " " + items[6]}
    want = brute_overlaps(docs, items)
    assert {i for _, i in want} == set(items)
    table = spark.createDataFrame([*docs.items(), (200, items[0]), (None, items[3]), (99, None), (98, "")], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("item", F.lit("x")).withColumn("tokens", F.lit(2))
    bench = spark.createDataFrame([*items.items(), (None, "a"), (77, None), (78, " . "), (3, items[3])], "item_id long, text string").withColumn("seed", F.lit(1))
    for most in (2_000_000, 0) if piece == 1024 else (0,):
        got = {(r.doc_id, r.item_id): (r.n_windows, r.matched, r.doc_at) for r in decontaminate.overlaps(table, bench, broadcast_seeds=most, piece=piece).collect()}
        assert got == want
    assert decontaminate.overlaps(table, bench.limit(0)).count() == 0 and decontaminate.overlaps(table.limit(0), bench).count() == 0


def test_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert got[5].component_id == 4 and not got[5].kept and got[None].kept is False
    assert shards.assign_shards(odd).count() == 11
    none = odd.limit(0)
    for df in (neardup.near_duplicates(none), shards.assign_shards(none), pieces.encode_pieces(none, pieces.default_model()), hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert df.count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    spm = pytest.importorskip("sentencepiece")
    import corpus_pipeline as c

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    columns, kept = docs.columns, {}
    before = {r.doc_id: r.text for r in docs.collect()}
    want = {
        "language": lambda t: {i for i, lang, p in zip(t, *langid.fit(docs).predict(list(t.values())), strict=True) if lang != "und" and p > 0.5},
        "near_duplicates": lambda t: {i for i, root in jaccard_roots(t, 5, 80)[0].items() if i == root},
        "decontamination": lambda t: set(t) - {d for d, _ in brute_overlaps(t, items)},
    }
    for name, stage in c.STAGES[:-1]:
        after = c.materialise(stage(spark, docs, data), "test")
        assert after.columns == columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept and kept.items() <= before.items()
        if name in want:
            assert set(kept) == want[name](before), name
        else:
            model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
            assert set(kept) == {r.doc_id for r in toxicity.toxicity(docs, model).collect() if r.score < c.TOXIC}
        docs, before = after, kept
    sp = spm.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in c.STAGES[-1][1](spark, docs, data).collect()}
    assert set(got) == set(kept)
    for i, text in kept.items():
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_toxicity_stage_rejects_what_the_operator_rejects(spark, monkeypatch):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rate in (0.29, 0.3, 0.4, 0.5):
        model = toxicity.Model(np.empty(0, np.uint64), np.empty(0), None, np.empty(0), np.empty(0), rate)
        monkeypatch.setattr(toxicity, "fit", lambda *_, model=model: model)
        clean = {r.doc_id for r in toxicity.toxicity(docs, model).collect() if not r.predicted}
        assert {r.doc_id for r in c.toxic(spark, docs, "/root/testdata/sf0.001").collect()} == clean


def test_pipeline_without_known_languages_and_its_encoding(spark):
    import corpus_pipeline as c

    texts = {1: "one two", 2: "12 %", 3: None, 4: "Ünï 漢字"}
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "doc_id long, text string, lang string")
    left = c.language(spark, docs, "")
    got = {r.doc_id: r for r in c.encoding(spark, left, "").collect()}
    assert set(got) == {1, 4}
    for i, r in got.items():
        assert len(r.ids) == r.n_tokens and r.decoded == texts[i]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and blank texts go in the first stage; equal texts leave one row; an empty table stays empty."""
    import corpus_pipeline as c

    spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_docs(spark).withColumn("lang", F.lit("en"))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = [r.doc_id for r in c.run(spark, str(tmp_path)).collect()]
    # What is left is the table that the result reads.
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["decontamination"]
    assert set(got) <= {4, 5, 7, 8, 10, None} and 5 not in got and len(got) == len(set(got))
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
