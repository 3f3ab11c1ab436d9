"""Near-duplicate documents: SuperMinHash signatures, banding, exact confirmation, components.

1. One pass over the texts gives, per row, the size and a 128-bit identity of its shingle set, one key per band, and four bits of
   each place of the signature. Rows with equal sets are one class from here on, so that thousands of copies cost one signature.
2. Classes that share a band key form a bucket, whose smallest member is its hub. Each class is first tried against the hub
   that its signature resembles most: that alone unites most of a group, and all that follows looks only across components.
3. Classes that resemble a common hub form a group, and a group that is still in several components is resolved by blocks:
   each pair of its blocks of about BLOCK texts is a task that counts all intersections as a product of incidence matrices and
   returns edges that span what is linked, never pairs. A component of BLOCK texts or more has blocks of its own, which are not paired with each
   other: in a group that its hub has united but for a few texts, only these few meet all others.
4. Pairs that share a band but no group are generated once, at the least key that they share among the buckets of up to DIRECT classes, if sizes
   and signatures allow a link (they drop a pair at the threshold ten times less often than banding does, see most_differing). Larger buckets that hold several
   groups are resolved by blocks like groups, whatever else their pairs share, so that no bucket is cut short.
5. A pair is a link only if the full sets, rebuilt from the whole texts, pass the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, discard, id_bits, materialise, maybe_among, scratch, spanning_edges
from lectern.llm.textvec import U, chunks, mix, shingle_sets

BANDS, ROWS = 26, 5
#: Texts of a block.
BLOCK = 256
#: Buckets of up to so many classes give pairs; larger ones are resolved by blocks.
DIRECT = 2048
#: Places of a signature that are compared, four bits of each in four planes of two words.
PLACES = 128


def superminhash(sets: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures of many sets: row i holds the minima over the elements of set i.

    In round j every element of an unfinished set draws a value in [j, j + 1) for the slot that stands at place j of
    its own random permutation of the m slots. A set is finished, and its elements are dropped, once all of its slots hold less
    than j: no later round can lower them. Values are j in the upper and 24 random bits in the lower part.
    """
    n = len(bounds) - 1
    out = np.full((n, m), 0xFFFFFFFF, dtype=np.uint32)
    sizes = np.diff(bounds)
    if not len(sets):
        return out
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), sizes)
    x = sets
    perm = None
    for j in range(m):
        rnd = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (rnd >> U(40)).astype(np.uint32) | np.uint32(j << 24)
        k = (j + (((rnd & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            row = np.arange(len(x))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(flat, owner * m + slot, value)
        live = out.max(axis=1) >= np.uint32((j + 1) << 24) if j + 1 < m else np.zeros(n, bool)
        keep = live[owner]
        if not keep.any():
            break
        if j == 0:
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(keep.sum()), 1))
            row, k = np.arange(len(perm)), k[keep]
            perm[row, k] = 0
            perm[:, 0] = k
        elif not keep.all():
            perm = perm[keep]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signatures.reshape(len(signatures), bands, rows).astype(U)
    key = np.arange(bands, dtype=U)[None, :] + U(1)
    for r in range(rows):
        key = mix(key * U(0x9FB21C651E98DF25) + s[:, :, r])
    return key.view(np.int64)


def planes(signatures: np.ndarray) -> np.ndarray:
    """Four bits of the first PLACES places, as 4 planes of 2 words per row."""
    s = signatures[:, :PLACES]
    bits = np.stack([((mix(s.astype(U)) >> U(k)) & U(1)).astype(np.uint8) for k in range(4)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").reshape(len(s), PLACES // 2).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo, data, offs in chunks(texts):
            sets, at = shingle_sets(data, offs, k)
            size = np.diff(at)
            some = size > 0
            h1, h2 = np.zeros(len(size), U), np.zeros(len(size), U)
            if len(sets):
                first = at[:-1][some]
                h1[some] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), first)
                h2[some] = np.add.reduceat(mix(sets * U(0xD1342543DE82EF95) + U(1)), first)
            signatures = superminhash(sets, at, bands * rows)[some]
            lists = []
            for values, kind in ((band_keys(signatures, bands, rows), pa.int64()), (planes(signatures), pa.int64())):
                offsets = np.concatenate(([0], np.cumsum(np.where(some, values.shape[1], 0))))
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.reshape(-1), kind)))
            columns = [ids.slice(lo, len(size)), pa.array(size, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists]
            yield pa.record_batch(columns, names=["doc_id", "n", "h1", "h2", "keys", "planes"])


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _sketch(it, k, bands, rows), "doc_id long, n long, h1 long, h2 long, keys array<long>, planes array<long>"
    )


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: tuple[object, np.ndarray] = (None, np.empty(0, U))
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        mine, theirs = batch.column(2), batch.column(3)
        left, right = [], []
        for lo, data, offs in chunks(mine):
            sets, at = shingle_sets(data, offs, k)
            for i in range(len(at) - 1):
                r = lo + i
                x = sets[at[i] : at[i + 1]]
                if last[0] != b[r]:
                    _, other, bound = next(chunks(theirs.slice(r, 1)))
                    last = (b[r], shingle_sets(other, bound, k)[0])
                y = last[1]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if not len(small) or 100 * len(small) < percent * len(large):
                    continue
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                both = int((large[place] == small).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(a[r])
                    right.append(b[r])
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose full shingle sets reach the threshold; the texts of other documents are not shuffled."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = maybe_among(texts, "id", id_bits(ids, "id"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("mine"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("theirs"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "mine", "theirs")
    return both.mapInArrow(lambda it: _confirm(it, k, percent), "a long, b long")


def _confirm_block(part: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Edges that span the links across components among the texts of two blocks."""
    ids, root = part["id"].to_numpy(np.int64), part["root"].to_numpy(np.int64)
    sets, sizes = [], []
    for _, data, offs in chunks(pa.array(part["text"], pa.string())):
        own, at = shingle_sets(data, offs, k)
        sets.append(own)
        sizes.append(np.diff(at))
    size = np.concatenate(sizes)
    owner = np.repeat(np.arange(len(ids)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((len(ids), len(ids)), dtype=np.float32)
    wide = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, (lo, lo + wide))
        m = np.zeros((len(ids), wide), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    linked = (100 * both >= percent * union) & (both > 0) & (root[:, None] != root[None, :])
    u, v = np.nonzero(linked)
    a, b = spanning_edges(ids[u], ids[v])
    return pd.DataFrame({"a": a, "b": b})


def confirm_groups(nodes: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Edges that span the links across roots within each group. nodes: id, group, root."""
    per = nodes.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    # Roots of a block or more have blocks to themselves; the others of a group share blocks, whose root is null.
    alone = F.when(F.col("n") >= block, F.col("root"))
    shares = materialise(per.groupBy("group", alone.alias("alone")).agg(F.sum("n").alias("n")).select("group", "alone", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shares")
    name = lambda part: F.xxhash64(F.coalesce("alone", F.lit(0)), F.col("alone").isNull(), part)
    listed = shares.select("group", "alone", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")).select("group", "alone", name(F.col("part")).alias("block"))
    x, y = (listed.select(F.col("group").alias(f"g{s}"), F.col("alone").alias(f"alone{s}"), F.col("block").alias(f"block{s}")) for s in "xy")
    differ = ~F.coalesce(F.col("alonex") == F.col("aloney"), F.lit(False))
    met = x.join(y, (F.col("gx") == F.col("gy")) & (F.col("blockx") <= F.col("blocky")) & differ).select(F.col("gx").alias("g"), F.col("blockx").alias("left"), F.col("blocky").alias("right"))
    sides = materialise(met.select("g", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("side")), "met")
    big = shares.select(F.col("group").alias("bg"), F.col("alone").alias("bigroot"), F.col("blocks").alias("bigblocks")).where("bigroot is not null")
    rest = shares.where("alone is null").select(F.col("group").alias("rg"), F.col("blocks").alias("restblocks"))
    own = nodes.select("id", "group", "root").join(big, (F.col("group") == F.col("bg")) & (F.col("root") == F.col("bigroot")), "left").join(rest, F.col("group") == F.col("rg"), "left")
    own = own.withColumn("alone", F.col("bigroot")).withColumn("own", name(F.pmod(F.xxhash64("id"), F.coalesce("bigblocks", "restblocks")).cast("int"))).select("id", "group", "root", "own")
    sent = own.join(sides, (F.col("group") == F.col("g")) & (F.col("own") == F.col("side"))).select("id", "group", "root", "left", "right")
    texts = docs.select(F.col("doc_id").cast("long").alias("tid"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = maybe_among(texts, "tid", id_bits(nodes, "id"))
    sent = texts.join(sent, F.col("tid") == F.col("id")).select("id", "group", "root", "text", "left", "right")
    return sent.groupBy("group", "left", "right").applyInPandas(lambda part: _confirm_block(part, k, percent), "a long, b long")


def most_differing(percent: int, bands: int = BANDS, rows: int = ROWS) -> int:
    """How many of PLACES may differ: the least number that a pair right at the threshold exceeds at most a tenth as often as it shares no band.

    Places count as independent; a place of different values agrees by chance once in 16.
    """
    similar = percent / 100
    p, missed = (1 - similar) * 15 / 16, (1 - similar**rows) ** bands / 10
    tail, most = 0.0, PLACES
    while most > 0:
        tail += comb(PLACES, most) * p**most * (1 - p) ** (PLACES - most)
        if tail > missed:
            break
        most -= 1
    return most


def _resemble(a: str, b: str, most: int) -> Column:
    """Whether the planes of both sides differ in at most so many places."""
    words = []
    for w in (0, 1):
        differ = None
        for p in range(4):
            x = F.get(a, F.lit(2 * p + w)).bitwiseXOR(F.get(b, F.lit(2 * p + w)))
            differ = x if differ is None else differ.bitwiseOR(x)
        words.append(F.bit_count(differ))
    return words[0] + words[1] <= most


def _differing(a: str, b: str) -> Column:
    return sum(F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(8))


def _fit(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _pairs_across(members: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs within a key whose components differ and that sizes and signatures allow, each once. members: key, id, n, root, planes, open (all keys that the id has here)."""
    x, y = (members.select(F.col("key").alias(f"key{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("root").alias(f"r{s}"), F.col("planes").alias(f"p{s}"), F.col("open").alias(f"o{s}")) for s in "ab")
    fits = (F.col("ra") != F.col("rb")) & (F.col("a") > F.col("b")) & _fit(percent) & _resemble("pa", "pb", most)
    return x.join(y, (F.col("keya") == F.col("keyb")) & fits & (F.array_min(F.array_intersect("oa", "ob")) == F.col("keya"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, direct: int = DIRECT) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Two documents are linked if percent % of the union of their sets of k-word shingles is shared; component_id is the smallest
    doc_id that can be reached over links. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id are one document, all of its rows get the same component. A row with a null doc_id gets the
    component of the documents with its text, if any, is never a component's name, and is not kept. A pair right at
    the threshold is linked. A text of any length is sketched and confirmed as a whole. Other columns of docs are ignored. An empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as keep:
        out = materialise(_components(docs, k, percent, bands, rows, direct), "near-duplicates")
        keep.append(out)
    return out


def _components(docs: DataFrame, k: int, percent: int, bands: int, rows: int, direct: int) -> DataFrame:
    most = most_differing(percent, bands, rows)
    rows_ = materialise(sketches(docs, k, bands, rows), "sketches")
    classes = materialise(rows_.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id")), "classes")
    named = classes.where("id is not null").select(F.col("id").alias("cid"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    same = (F.col("doc_id") == F.col("cid")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    first = materialise(rows_.where("n > 0").join(named, same, "left_semi").select(F.col("doc_id").alias("id"), "n", "keys", "planes").dropDuplicates(["id", "n"]), "first")
    banded = materialise(first.select("id", F.explode("keys").alias("key")), "banded")
    hubs = materialise(banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub"), "hubs")
    buckets = materialise(banded.join(hubs, "key").select("key", "id", "hub"), "buckets")
    discard(banded)
    several = materialise(buckets.select(F.col("id").alias("bid")).distinct(), "several")
    detail = materialise(first.join(several, F.col("id") == F.col("bid"), "left_semi").select("id", "n", "planes"), "detail")

    x, y = (detail.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("planes").alias(f"p{s}")) for s in "ab")
    spokes = buckets.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    tried = spokes.join(x, "a").join(y, "b").where(_fit(percent) & _resemble("pa", "pb", most)).select("a", "b", _differing("pa", "pb").alias("differing"))
    tried = materialise(tried, "tried")
    best = materialise(tried.groupBy("a").agg(F.min(F.struct("differing", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "best")
    links = materialise(confirm(best, docs, k, percent), "links")
    roots = connected_components(links)

    def with_root(df: DataFrame, column: str, name: str) -> DataFrame:
        r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return df.join(r, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", column)).drop("__node", "__root")

    # Groups: classes that resemble a common hub, directly or over others.
    groups = connected_components(tried)
    nodes = materialise(with_root(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id", "root"), "grouped")
    open_ = nodes.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_ = materialise(open_.select(F.col("group").alias("open")), "open")
    if not open_.isEmpty():
        links = links.unionAll(materialise(confirm_groups(materialise(nodes.join(open_, F.col("group") == F.col("open")).select("id", "group", "root"), "nodes"), docs, k, percent), "links"))

    roots = groups
    members = materialise(with_root(buckets.select("key", "id"), "id", "root"), "members")
    sizes = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    members = materialise(members.join(sizes.select("key", "size"), "key").select("key", "id", "root", "size"), "members")
    small, large = members.where(F.col("size") <= direct), members.where(F.col("size") > direct)
    shared = small.groupBy("id").agg(F.collect_list("key").alias("open"))
    pairs = materialise(_pairs_across(small.join(detail, "id").join(shared, "id"), percent, most), "pairs")
    if not pairs.isEmpty():
        links = links.unionAll(materialise(confirm(pairs, docs, k, percent), "links"))
    if not large.isEmpty():
        links = links.unionAll(materialise(confirm_groups(large.select("id", F.col("key").alias("group"), "root"), docs, k, percent), "links"))
    roots = connected_components(links)

    named = materialise(with_root(classes, "id", "root").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "root"), "named")
    return rows_.join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") > 0), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(False)).alias("kept"),
    )


def op8_superminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


OP8_SQL = """
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded),
single as (select doc_id, len(s) as n, unnest(s) as x from shingled),
shared as (
  select p.doc_id as a, q.doc_id as b, p.n + q.n as total, count(*) as common from single p join single q on p.x = q.x and p.doc_id <> q.doc_id
  group by all),
links as (select a, b from shared where 100 * common >= 85 * (total - common)),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
lowest as (select a, min(b) as b from reached group by a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id <= coalesce(b, doc_id) as kept
from shingled left join lowest on doc_id = a
"""
