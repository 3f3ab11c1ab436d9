"""The methods against plain versions of themselves, at the sizes and on the rows where they could go wrong."""

import collections
import math
import random
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.llm import common, hnsw, langid, neardup, pieces, rollups, shards, toxicity, urls, warc
from lectern.llm.textvec import U


def words_of(rng, n, words="the of and tion ing er le la que und der ein ment".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def folder(spark):
    return common.shared_dir(spark).removeprefix("file://")


def test_shards_equal_a_plain_packer(spark):
    rng = random.Random(2)
    rows = [(k, words_of(rng, rng.randrange(1, 40))) for k in range(150)]
    rows += [(500 + k, rows[k % 9][1]) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("one", F.lit("x")).withColumn("item", F.lit(0))
    hashes = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    vectors = collections.defaultdict(lambda: [0, 0, 0])
    for _, t in rows:
        for d, x in enumerate((len(t.encode()) + 1, len(t.split()), 1)):
            vectors[t][d] += x
    total = [sum(v[d] for v in vectors.values()) for d in range(3)]
    scaled = {t: [4 * v[d] / total[d] for d in range(3)] for t, v in vectors.items()}
    left, want = [[1.0] * 3 for _ in range(4)], {}
    for t in sorted(scaled, key=lambda t: (-max(scaled[t]), f"heavy {hashes[t]} 0")):
        dots = [sum(a * b for a, b in zip(room, scaled[t], strict=True)) for room in left]
        room = [[a >= b - 1e-9 for a, b in zip(x, scaled[t], strict=True)] for x in left]
        want[t] = s = max(range(4), key=lambda k: (all(room[k]), room[k][0], round(dots[k] if room[k][0] else left[k][0], 9), -k))
        left[s] = [a - b for a, b in zip(left[s], scaled[t], strict=True)]
    text = dict(rows)
    got = shards.assign_shards(table, 4).collect()
    assert {r.doc_id: r.shard for r in got} == {i: want[t] for i, t in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_shards_keep_groups_on_both_sides_of_the_first_pass(spark):
    """With one item a shard, all small groups are united before they are packed."""
    rng = random.Random(3)
    texts = [words_of(rng, 5) for _ in range(300)]
    rows = [(k, texts[k % 300] if k % 10 else texts[7]) for k in range(900)]
    for items in (512, 2):
        got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, items).collect()
        where, slots = collections.defaultdict(set), collections.defaultdict(list)
        for r in got:
            where[dict(rows)[r.doc_id]].add(r.shard)
            slots[r.shard].append(r.slot)
        assert all(len(s) == 1 for s in where.values()) and len(got) == 900
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_buckets(text):
    """Buckets of all n-grams of a text, by integers alone."""
    codes = [32, 32] + [ord(c) if c.isalpha() else 32 for c in text.lower()]
    for at in range(2, len(codes)):
        h = 0
        for k, n in enumerate(langid.ORDERS):
            h = (h * 0x9E3779B97F4A7C15 + codes[at - n + 1] + n) % (1 << 64)
            yield k, (h * 0xD6E8FEB86659FD93 % (1 << 64) >> (64 - langid.BITS)) + (k << langid.BITS)


def test_language_equals_a_plain_naive_bayes(spark):
    rng = random.Random(4)
    kinds = {"en": "the of and thing".split(), "de": "der und keit schön".split(), "xx": "ŋa ɓu ʔi zo".split()}
    rows = [(k, words_of(rng, rng.randrange(1, 12), kinds[lang]), lang) for k in range(90) for lang in [list(kinds)[k % 3]]]
    model = langid.fit(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"))
    counts = {x: collections.Counter() for x in kinds}
    for _, text, lang in rows[:60]:
        counts[lang].update(b for _, b in plain_buckets(text))
    size = {(x, k): sum(n for b, n in counts[x].items() if b >> langid.BITS == k) + 0.5 * (1 << langid.BITS) for x in kinds for k in range(3)}
    texts = [r[1] for r in rows[60:]] + ["", None, "42 ½", "é", "the" * 500]
    got = model.predict(texts)
    for text, lang, p in zip(texts, *got, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (lang, p) == ("und", 0)
            continue
        z = {x: math.log(20 / 60) + sum(math.log((counts[x][b] + 0.5) / size[x, k]) for k, b in plain_buckets(text)) for x in kinds}
        best = max(sorted(z), key=z.get)
        assert lang == best and p == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()), rel=1e-9)
    # Neither cuts in a text nor the texts beside it change a score.
    for piece in (1, 7, 64):
        assert model.predict(texts, piece)[0] == got[0] and np.allclose(model.predict(texts, piece)[1], got[1], rtol=1e-9)
    assert model.predict(texts[3:4])[1][0] == pytest.approx(got[1][3], rel=1e-9)


def test_language_learns_every_language_of_the_sample(spark):
    rows = [(k, f"{chr(0x4E00 + k)} {chr(0x4E00 + k)}" * 3, f"l{k:03}") for k in range(260)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == [r[2] for r in rows]


def test_sample_is_that_of_the_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id")).limit(300).collect()]
    for most in (300, 6000):
        with common.scratch(spark):
            got = [r.doc_id for r in common.smallest_hashes(df, "doc_id", most).collect()]
        assert got[:300] == want and len(got) == min(most, 5000)


def test_vectors_of_a_label_of_two_full_shards(spark):
    """20,000 vectors with dense clusters: walks widen, only members of the densest need a scan, and all links are found."""
    rng = np.random.default_rng(6)
    n = 20_000
    base = rng.normal(size=(n // 4, 24))
    of = np.where(rng.random(n) < 0.05, 0, np.where(rng.random(n) < 0.03, 1, rng.integers(2, n // 4, n)))
    x = (base[of] + rng.normal(size=(n, 24)) * rng.choice([0.02, 0.08, 0.3], n)[:, None]).astype(np.float32)
    u = hnsw.unit(x)
    low, links = np.arange(n), np.zeros(n, dtype=int)
    pairs = []
    for lo in range(0, n, 2000):
        a, b = np.nonzero(u[lo : lo + 2000] @ u.T >= 0.98)
        links[lo : lo + 2000] = np.bincount(a, minlength=2000) - 1
        pairs.append((a + lo, b))
    node, root = common.spanning_edges(*(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))
    low[node] = root
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 24).cast(pa.list_(pa.float32())), "label": np.zeros(n, dtype=np.int32)}))
    got = hnsw.near_vectors(df).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert found.sum() >= 0.9999 * links.sum() and (found == links).mean() > 0.999
    assert (got["component_id"].to_numpy() == low).mean() > 0.999
    graph, widths = hnsw.Graph.build(x[:8192]), []
    own = np.arange(512)
    a, b, _ = hnsw.linked(graph, graph.unit[:512], 0.98, own=own, widths=widths)
    assert len(a) == len(hnsw.scanned(graph, graph.unit[:512], 0.98)[0])
    walks = collections.Counter(widths)
    assert {32, 64, 128, 256} <= set(walks) and walks[8192] <= (of[:512] < 2).sum() and walks[32] == 512


def test_vectors_on_odd_rows(spark):
    edge = [0.98, math.sqrt(1 - 0.98**2)]
    rows = [(1, [1.0, 0.0], 1, "x"), (2, edge, 1, "x"), (2, edge, 1, "x"), (3, [2.0, 0.0], 1, "x"), (3, [0.0, 5.0], 2, "x"), (4, [0.0, 1.0], 2, "x"), (None, [1.0, 0.0], 1, "x"), (5, [1e300, 0.0], 1, "x"), (6, [5e-320, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").withColumn("n", F.lit(0)).withColumn("root", F.lit("r"))
    u = {1: np.array([1.0, 0.0]), 2: hnsw.unit(np.array([edge]))[0]}
    tie = float(u[1] @ u[2]) >= 0.98
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()]
    assert len(got) == 9
    one = {r[0]: r[1:] for r in got}
    # 1, 3, 5 and 6 point the same way; 2 is one vector although it comes twice; 3 has another vector in another label too.
    assert one[1] == (3 + tie, 1, True) and one[5] == (3 + tie, 1, False) and one[6] == one[5]
    assert one[3] == (4 + tie, 1, False) and one[4] == (1, 1, False) or one[4][0] == 1
    assert one[2][0] == (4 if tie else 0) and one[None] == (0, None, False)


def test_groups_of_one_large_component_and_a_few_others(spark):
    """Blocks of a united component do not meet each other; what is linked across components is found all the same."""
    rng = random.Random(9)
    base = words_of(rng, 80).split()
    texts = {k: " ".join([*base, f"end{k}"]) for k in range(30)}
    texts |= {100 + k: " ".join([*words_of(rng, 60).split(), f"x{k}"]) for k in range(5)}
    texts |= {200: texts[100] + " more", 201: " ".join([*base, "last"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = spark.createDataFrame([(k, 1, 0 if k < 30 else k) for k in texts], "id long, group long, root long")
    with common.scratch(spark):
        got = {(r.a, r.b) for r in neardup.confirm_groups(nodes, docs, 5, 80, block=4).collect()}
        assert all({a, b} <= {100, 200} or 201 in (a, b) or b < 30 for a, b in got)
        roots = {r.node: r.root for r in common.connected_components(spark.createDataFrame([*got, *((k, 0) for k in range(1, 30))], "a long, b long")).collect()}
    assert roots[201] == 0 and roots[200] == roots[100] == 100 and not {101, 102, 103, 104} & set(roots)


def test_links_just_above_the_threshold_are_found(spark):
    """Pairs of 85 to 87 % that share nothing with other pairs: banding and the filter together miss less than one in a thousand."""
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(102)]
        other = list(words)
        other[50:53] = [f"v{rng.randrange(10**9)}" for _ in range(rng.choice((3, 2)))]
        a, b = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words, other))
        if 100 * len(a & b) >= 85 * len(a | b):
            want.add(2 * k)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect() if r.doc_id % 2 and r.component_id % 2 == 0}
    assert len(want) > 300 and got == want


def test_intermediates_are_deleted(spark, tmp_path):
    import os

    rng = random.Random(11)
    docs = spark.createDataFrame([(k, words_of(rng, 30)) for k in range(40)] + [(90, "a b c d e f"), (91, "a b c d e f")], "doc_id long, text string")
    before = set(os.listdir(folder(spark)))
    with common.scratch(spark):
        assert neardup.near_duplicates(docs).where("not kept").count() == 1
        assert shards.assign_shards(docs).count() == 42
        left = set(os.listdir(folder(spark))) - before
        assert {x.split("-")[1] for x in left} == {"near", "rows"}
    assert set(os.listdir(folder(spark))) == before


def test_rollups_of_several_writers(spark):
    schema = "action string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"
    path = common.new_path(spark, "test-rollup")
    rolls = [rollups.TokenRollup(spark, path) for _ in range(4)]
    batch = spark.createDataFrame([("insert", "s", "en", "v", 5, None)], schema)
    done, gate = [], threading.Barrier(4)

    def write(roll):
        gate.wait()
        done.append(roll.apply("a", batch))

    threads = [threading.Thread(target=write, args=(r,)) for r in rolls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [False, False, False, True]
    assert [tuple(r) for r in rolls[0].totals().collect()] == [("s", "en", "v", 1, 5)]
    with pytest.raises(PySparkException):
        rolls[0].apply("bad", spark.createDataFrame([("upsert", "s", "en", "v", 5, None)], schema))
    assert not rolls[0].committed("bad")
    other = batch.withColumn("n_docs", F.lit(9)).withColumn("sums", F.lit("x"))
    assert rolls[1].apply("clash", other) and rolls[2].totals().first().n_docs == 2
    with open(f"{path.removeprefix('file://')}/commits/lost", "w"):
        pass
    with pytest.raises(RuntimeError, match="lost"):
        rolls[0].totals()


def test_rollups_of_real_tokens(spark):
    """Counts of the piece model: a document is revised, another deleted, and a new tokenizer version stands beside the old one."""
    spm = pytest.importorskip("sentencepiece")
    path = pieces.default_model()
    sp = spm.SentencePieceProcessor(model_file=path)
    size = lambda t: len(sp.encode(t or "", add_bos=True, add_eos=True))
    old = {1: ("a", "en", "one two three"), 2: ("a", "en", None), 3: ("b", None, "été " * 50), 3000: ("b", None, "")}
    new = {1: ("a", "en", "one two three four"), 4: ("c", "de", "neu")}
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in rows.items()], "doc_id long, source string, lang string, text string")
    roll = rollups.TokenRollup(spark, common.new_path(spark, "test-rollup"))
    first, second = rollups.inserted(frame(old), path, "piece-1"), rollups.inserted(frame(new), path, "piece-1")
    assert roll.apply("load", first.drop("doc_id"))
    before = first.select(F.col("doc_id").alias("d"), F.col("n_tokens").alias("o"))
    changed = second.join(before, F.col("doc_id") == F.col("d"), "left").withColumn("action", F.when(F.col("d").isNull(), "insert").otherwise("revise")).withColumn("old_tokens", F.col("o"))
    assert roll.apply("crawl 2", changed) and not roll.apply("crawl 2", changed)
    assert roll.apply("down", first.where("doc_id = 3").withColumn("action", F.lit("delete")))
    assert roll.apply("words", frame({**old, **new}).select(F.lit("insert").alias("action"), "source", "lang", F.lit("words-1").alias("tokenizer_version"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n_tokens"), F.lit(None).cast("long").alias("old_tokens")))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert {k: v for k, v in got.items() if k[2] == "piece-1"} == {("a", "en", "piece-1"): (2, size(new[1][2]) + size(None)), ("b", None, "piece-1"): (1, size("")), ("c", "de", "piece-1"): (1, size("neu"))}
    assert sum(v[0] for k, v in got.items() if k[2] == "words-1") == 5


def test_urls_of_unseen_hosts():
    """Hosts are held out whole, so that neither their names nor their paths were seen together."""
    table, right, n = urls.labelled_urls(), 0, 0
    hosts = sorted({t[0] for t in table})
    for fold in range(4):
        out = set(hosts[fold::4])
        model = urls.fit([t for t in table if t[0] not in out])
        held = [t for t in table if t[0] in out]
        p = model.score(pa.array([t[0] for t in held]), pa.array([t[1] for t in held]))
        right, n = right + sum((p >= 0.5) == [t[2] == 1 for t in held]), n + len(held)
    assert right / n > 0.85


def test_logistic_regression_has_the_gradient_of_its_loss():
    """At the weights that the fit gives, the gradient, computed per n-gram and row by plain sums, is close to zero."""
    table = [("good.org", "/a", 0), ("bad.top", "/buy", 1), ("good.org", "/b", 0), ("worse.top", "/", 1)]
    model = urls.fit(table, steps=3000, l2=1e-2)
    column = urls.texts(pa.array([t[0] for t in table]), pa.array([t[1] for t in table]))
    rows = []
    for text in column.to_pylist():
        data = np.frombuffer(text.encode(), np.uint8)
        rows.append(collections.Counter(int(b) for g, inside in urls._grams(data, np.array([0, len(data)])) for b in g[inside]))
        for k in rows[-1]:
            rows[-1][k] /= math.sqrt(len(data))
    p = [1 / (1 + math.exp(-sum(model.weight[k] * v for k, v in r.items()) - model.bias)) for r in rows]
    for k in {k for r in rows for k in r}:
        assert abs(sum((q - t[2]) * r.get(k, 0) for q, t, r in zip(p, table, rows, strict=True)) / 4 + 1e-2 * model.weight[k]) < 2e-3
    got = model.score(pa.array([t[0] for t in table]), pa.array([t[1] for t in table]))
    assert np.allclose(got, p, rtol=1e-6)
    # A score does not depend on the rows beside it.
    assert np.allclose(model.score(pa.array([t[0] for t in table[2:]]), pa.array([t[1] for t in table[2:]])), p[2:], rtol=1e-6)


def test_urls_on_odd_rows(spark):
    long = "http://h.org/" + "x" * 200_000
    rows = [(1, ""), (1, ""), (None, "http://A.com/x"), (2, long), (3, "://"), (4, "http://é.net/es/ü"), (5, "http://EXAMPLE.com/en"), (6, "a://b.example.com/en/?q#f")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("path", F.lit(1)).withColumn("rule", F.lit("r")).withColumn("score", F.lit(0))
    got = [(r.page_id, r.host, r.path, r.rule) for r in urls.judge(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "", "", None), (1, "", "", None), (None, "a.com", "/x", "com/"), (2, "h.org", long[12:], None), (3, "", "", None), (4, "é.net", "/es/ü", "net/es/"), (5, "example.com", "/en", "com/"), (6, "b.example.com", "/en/", "example.com/en/")]))
    assert urls.judge(df.limit(0)).count() == 0


def test_first_split_of_a_tree_is_the_best_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = (x[:, 2] + 0.3 * rng.normal(size=60) > 0.2).astype(float)
    t = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    g, h = y - y.mean(), y.mean() * (1 - y.mean())
    best = (-1.0, None)
    for f in range(4):
        for c, cut in enumerate(t.cuts[f]):
            left = x[:, f] <= cut
            a, b = left.sum() * h, (~left).sum() * h
            if min(a, b) >= 0.5:
                gain = g[left].sum() ** 2 / (a + t.l2) + g[~left].sum() ** 2 / (b + t.l2)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, c))
    feature, cut, value = t.trees[0]
    assert (int(feature[0]), int(cut[0])) == best[1]
    left = x[:, best[1][0]] <= t.cuts[best[1][0]][best[1][1]]
    assert value == pytest.approx([t.rate * g[s].sum() / (s.sum() * h + t.l2) for s in (left, ~left)])


def test_isotonic_regression_equals_its_min_max_formula():
    rng = random.Random(12)
    raw = np.array(sorted(rng.random() for _ in range(40)))
    y = np.array([float(rng.random() < r) for r in raw])
    at, to = toxicity.isotonic(raw, y)
    want = [max(min(y[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    centre = {round(v, 12): raw[[round(w, 12) == round(v, 12) for w in want]].mean() for v in want}
    assert np.allclose(sorted(centre), to) and np.allclose([centre[k] for k in sorted(centre)], at)


def test_toxicity_of_repeated_rows(spark):
    rows = [(k, "you idiot scum" if k % 2 else "a fine day") for k in range(40)]
    docs = spark.createDataFrame([*rows, (1, rows[1][1]), (None, "you idiot scum")], "doc_id long, text string").withColumn("toxic", F.lit(7)).withColumn("score", F.lit("s")).withColumn("id", F.lit(0))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (1, None), (999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("t"))
    got = collections.defaultdict(list)
    for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect():
        got[r.doc_id].append((r.score, r.predicted))
    assert len(got[1]) == 2 and len(set(got[1] + got[3] + got[None])) == 1 and got[1][0][1] == 1 and got[0][0][1] == 0
    assert toxicity.toxicity(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_archives_that_are_broken(spark, tmp_path):
    def parts(page, text):
        return list(warc.records_of(page, "http://h/", text.encode(), None, segment=400))

    whole, cut, total, digest, twice = parts(1, "x" * 100), parts(2, "y" * 2000), parts(3, "z" * 2000), parts(4, "w" * 100), parts(5, "v" * 2000)
    bad_total = [x.replace(b"Total-Length: ", b"Total-Length: 9") for x in total]
    bad_digest = [x.replace(b"wwww", b"wwwv", 1) for x in digest]
    records = [*whole, *cut[:1], *cut[2:], *bad_total, *bad_digest, *twice, twice[1]]
    data = warc.EMPTY.join(warc.member(r + warc.END) for r in records)
    broken = bytearray(warc.member(parts(6, "u" * 100)[0] + warc.END))
    broken[40] ^= 0xFF
    data += bytes(broken) + warc.member(b"no record" + warc.END) + warc.member(parts(7, "t" * 100)[0][:-5] + warc.END) + warc.member(parts(8, "s" * 100)[0] + warc.END)
    data += warc.member(parts(9, "r" * 100)[0] + warc.END)[:-20]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(data)
    got = warc.read_archives(spark, f"file://{tmp_path}/in").collect()
    good = {r.page_id: r for r in got if r.error is None}
    assert set(good) == {1, 8} and good[1].payload_bytes == 100 and good[1].record_type == "response"
    errors = collections.defaultdict(list)
    for r in got:
        if r.error is not None:
            errors[r.page_id].append(r.error)
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (None,) * 4
    assert "missing" in errors[2][0] and "total length" in errors[3][0] and "digest" in errors[4][0] and "twice" in errors[5][0]
    assert len(errors[None]) >= 4 and set(errors) == {2, 3, 4, 5, None}


def test_archives_of_no_rows_and_of_members(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.new_path(spark, "test-warc")
    warc.archive(none, path)
    assert warc.read_archives(spark, path).count() == 0
    pages = spark.createDataFrame([(k, f"http://h/{k}", "é" * (k * 9000)) for k in range(8)], "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("sha", F.lit("s")).withColumn("maybe", F.lit(True))
    warc.archive(pages, f"file://{tmp_path}/out")
    import gzip
    import pathlib

    seen = 0
    for f in pathlib.Path(tmp_path / "out").glob("part-*"):
        data = f.read_bytes()
        found = [c for c, e in warc.members(data)]
        assert gzip.decompress(data) == b"".join(found) and all(c.startswith(b"WARC/1.0\r\n") and c.endswith(warc.END) for c in found)
        seen += len(found)
    assert seen > 8
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, f"file://{tmp_path}/out").collect()} == {k: k * 18000 for k in range(8)}


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session).startswith("file://")


def test_superminhash_is_that_of_each_element_alone():
    """The signature of a set is the minimum of the signatures of its elements, computed one by one without an early stop."""
    rng = np.random.default_rng(5)
    sets = np.unique(rng.integers(0, 1 << 63, 60).astype(U))
    alone = neardup.superminhash(sets, np.arange(len(sets) + 1), 32)
    assert (neardup.superminhash(sets, np.array([0, len(sets)]), 32)[0] == alone.min(axis=0)).all()
