"""Embedding near-duplicates with one hierarchical navigable small-world graph per shard.

Vectors of a label are dealt over shards of at most about SHARD vectors; a graph is built per shard, and every block of vectors
queries every shard of its label. Equal vectors are one node with a weight. A query's beam is widened until its worst
member is below the threshold, so that all links fit in it, and a block's beams are widened until its audit passes: for a
part of its queries the links are counted by brute force within the shard. Beams of more than WIDEST are as wide as the
shard, which is a scan, so that there is an exact end to widening whose cost does not grow with the cluster that a query is in. Graphs are walked in single precision; all that comes near the threshold is verified in double precision.

A task holds the blocks of TILE shards and the graphs of TILE shards, so that each graph is sent once for TILE shards that query it.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, materialise, scratch, spanning_edges

SHARD = 16_384  # vectors of a graph
BLOCK = 512  # vectors that query a graph together
TOGETHER = 4  # blocks of a task at least, so that a graph is not sent for every block
TILE = 4  # shards whose blocks, and shards whose graphs, a task holds
LINKS = 12  # neighbours per node on the upper layers, twice as many on the lowest
BUILD_BEAM, FIRST_BEAM, WIDEST = 48, 32, 256
AUDIT, RECALL = 32, 1.0  # queries of a block that are audited, and the share of their links to be found
MARGIN = 1e-5  # how far a cosine of single precision may be off
BEYOND = 0.01  # how far below the threshold the worst member of a beam has to be, so that what lies behind a slightly worse node is found


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """Layers of a graph over the rows of raw. layers[k] = (ids, neighbours as places in ids, padded with -1); unit and walk are the unit vectors in double and single precision."""

    def __init__(self, raw: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.raw, self.layers = raw, layers
        self.unit = unit(raw)
        self.walk = self.unit.astype(np.float32)

    @classmethod
    def build(cls, raw: np.ndarray, seed: int = 5, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        n = len(raw)
        draw = -np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)
        level = draw.astype(int)
        level[0] = level.max() if n else 0
        graph = cls(raw, [])
        for k in range(int(level.max()) if n else 0, -1, -1):
            ids = np.flatnonzero(level >= k)
            graph.layers.insert(0, (ids, graph._layer(ids, links * (1 + (k == 0)), beam)))
        return graph

    def _layer(self, ids: np.ndarray, most: int, beam: int) -> np.ndarray:
        """Inserts the nodes in batches that double: each batch searches what stands and compares its own nodes with each other."""
        x, n = self.walk[ids], len(ids)
        out = np.full((n, most), -1, dtype=np.int32)
        entry = self._descend(x) if self.layers else np.zeros(n, dtype=np.int64)
        entry = np.searchsorted(ids, self.layers[0][0][entry]) if self.layers else entry
        done = 0
        while done < n:
            size = min(max(done, 32), 256, n - done)
            new = np.arange(done, done + size)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -2)
            found = [new[np.argsort(-own, axis=1)[:, : min(beam // 2, size - 1)]]]
            if done:
                start = np.where(entry[new] < done, entry[new], entry[new] % done)
                found.append(_beam(x[:done], out[:done], x[new], start[:, None], beam)[0])
            chosen = _diverse(x, new, np.concatenate(found, axis=1), most // 2)
            out[new, : chosen.shape[1]] = chosen
            row, col = np.nonzero(chosen >= 0)
            self._link_back(x, out, chosen[row, col].astype(np.int64), new[row], most)
            done += size
        return out

    @staticmethod
    def _link_back(x: np.ndarray, out: np.ndarray, to: np.ndarray, of: np.ndarray, most: int) -> None:
        """Adds the nodes `of` to the neighbours of the nodes `to`, whose neighbours are chosen anew where they become too many."""
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        nodes, begin, more = np.unique(to, return_index=True, return_counts=True)
        by_count = np.argsort(more, kind="stable")
        for lo in range(0, len(nodes), 256):
            part = by_count[lo : lo + 256]
            pool = np.full((len(part), most + int(more[part[-1]]) if len(part) else most), -1, dtype=np.int64)
            pool[:, :most] = out[nodes[part]]
            rows = np.repeat(np.arange(len(part)), more[part])
            places = np.arange(len(rows)) - np.repeat(np.cumsum(more[part]) - more[part], more[part])
            pool[rows, most + places] = of[begin[part][rows] + places]
            out[nodes[part]] = -1
            chosen = _diverse(x, nodes[part], pool, most)
            out[nodes[part], : chosen.shape[1]] = chosen

    def _descend(self, q: np.ndarray, stop: int = 0) -> np.ndarray:
        """For each query the best node that a greedy walk finds, as a place in the lowest layer there is."""
        at = np.zeros(len(q), dtype=np.int64)
        for k in range(len(self.layers) - 1, stop - 1, -1):
            ids, near = self.layers[k]
            if k < len(self.layers) - 1:
                at = np.searchsorted(ids, self.layers[k + 1][0][at])
            at = _beam(self.walk[ids], near, q, at[:, None], 4)[0][:, 0].astype(np.int64)
        return at

    def search(self, q: np.ndarray, beam: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam, best first, padded with -1, of queries in single precision; own: the queries' own nodes, or -1."""
        start = np.zeros(len(q), dtype=np.int64)
        if len(self.layers) > 1:
            start = self.layers[1][0][self._descend(q, 1)]
        return _beam(self.walk, self.layers[0][1], q, np.column_stack((start, own)), beam)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.raw, n=len(self.layers), **{f"i{k}": i.astype(np.int32) for k, (i, _) in enumerate(self.layers)}, **{f"n{k}": n for k, (_, n) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, content: bytes) -> Graph:
        z = np.load(io.BytesIO(content), allow_pickle=False)
        return cls(z["x"], [(z[f"i{k}"].astype(np.int64), z[f"n{k}"]) for k in range(int(z["n"]))])


def _diverse(x: np.ndarray, nodes: np.ndarray, pools: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node out of its row of the pools, padded with -1.

    Best first, leaving out what is closer to one chosen before than to the node, then filled up with the best left out.
    """
    pools = np.sort(pools, axis=1)
    pools[:, 1:][pools[:, 1:] == pools[:, :-1]] = -1
    pools[pools == nodes[:, None]] = -1
    sim = np.where(pools < 0, np.float32(-3), np.einsum("bpd,bd->bp", x[pools], x[nodes]))
    wide = max(1, min(4 * most, int((pools >= 0).sum(axis=1).max(initial=0))))
    order = np.argsort(-sim, axis=1, kind="stable")[:, :wide]
    pools, sim = np.take_along_axis(pools, order, axis=1), np.take_along_axis(sim, order, axis=1)
    v = x[pools]
    among = v @ v.transpose(0, 2, 1)
    blocked, chosen, count = pools < 0, np.zeros(pools.shape, dtype=bool), np.zeros(len(pools), dtype=int)
    for k in range(pools.shape[1]):
        taken = ~blocked[:, k] & (count < most)
        chosen[:, k] = taken
        count += taken
        blocked |= (among[:, k] > sim) & taken[:, None]
    rank = np.where(pools < 0, 2, np.where(chosen, 0, 1))
    return np.take_along_axis(pools, np.argsort(rank, axis=1, kind="stable")[:, :most], axis=1)


_table: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once from one or two nodes each (the second may be -1); stops for a query when its best node that is not expanded is worse than a full beam's worst."""
    n, width = len(q), min(beam, len(x))
    ids = np.full((n, width), -1, dtype=np.int32)
    sims = np.full((n, width), -2.0, dtype=np.float32)
    start = start.copy()
    start[:, 1:][start[:, 1:] == start[:, :1]] = -1
    for k in range(min(start.shape[1], width)):
        some = np.flatnonzero(start[:, k] >= 0)
        ids[some, k] = start[some, k]
        sims[some, k] = np.einsum("ij,ij->i", q[some], x[start[some, k]])
    # 0 is a node that a query has not seen; of equal nodes that come together, the one that wrote last counts. The table is used again, and what was written erased.
    if len(_table[0]) < n * len(x):
        _table[0] = np.zeros(n * len(x), dtype=np.int32)
    seen, written = _table[0][: n * len(x)], [(np.arange(n)[:, None] * len(x) + start)[start >= 0]]
    seen[written[0]] = 1
    expanded = np.zeros((n, width), dtype=bool)
    live = np.arange(n)
    # Expanding a few at a time takes fewer rounds for little more work.
    take = min(max(4, width // 8), width)
    while len(live):
        own_ids, own_sims, own_exp = ids[live], sims[live], expanded[live]
        open_ = np.where(own_exp | (own_ids < 0), np.float32(-3), own_sims)
        best = np.argpartition(-open_, take - 1, axis=1)[:, :take]
        good = np.take_along_axis(open_, best, axis=1) > -2.5
        going = good.any(axis=1)
        if not going.all():
            live, best, good, own_ids, own_sims, own_exp = (v[going] for v in (live, best, good, own_ids, own_sims, own_exp))
            if not len(live):
                break
        np.put_along_axis(own_exp, best, True, axis=1)
        nodes = np.where(good, np.take_along_axis(own_ids, best, axis=1), -1)
        more = near[nodes]
        more[nodes < 0] = -1
        more = more.reshape(len(live), -1)
        place, c = np.nonzero(more >= 0)
        node, of = more[place, c], live[place]
        key = of * len(x) + node
        fresh = seen[key] == 0
        place, node, of, key = place[fresh], node[fresh], of[fresh], key[fresh]
        stamp = np.arange(1, len(of) + 1, dtype=np.int32)
        seen[key] = stamp
        fresh = seen[key] == stamp
        place, node, of = place[fresh], node[fresh], of[fresh]
        written.append(key)
        if not len(of):
            expanded[live] = own_exp
            continue
        sim = np.einsum("ij,ij->i", q[of], x[node])
        # What is worse than the worst of a full beam has no place in it.
        some = sim > own_sims.min(axis=1)[place]
        place, node, sim = place[some], node[some], sim[some]
        count = np.bincount(place, minlength=len(live))
        at = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        wide = int(count.max(initial=0))
        if wide:
            add_id, add_sim = np.full((len(live), wide), -1, dtype=np.int32), np.full((len(live), wide), -2.0, dtype=np.float32)
            add_id[place, at], add_sim[place, at] = node, sim
            own_ids, own_sims = np.concatenate((own_ids, add_id), axis=1), np.concatenate((own_sims, add_sim), axis=1)
            own_exp = np.concatenate((own_exp, np.zeros((len(live), wide), dtype=bool)), axis=1)
            order = np.argpartition(-own_sims, width - 1, axis=1)[:, :width]
            own_ids, own_sims, own_exp = (np.take_along_axis(v, order, axis=1) for v in (own_ids, own_sims, own_exp))
        ids[live], sims[live], expanded[live] = own_ids, own_sims, own_exp
    for key in written:
        seen[key] = 0
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1).astype(np.int64), np.take_along_axis(sims, order, axis=1)


def verified(graph: Graph, q: np.ndarray, row: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of a query (unit vectors in double precision) and a node whose cosine is at least the threshold."""
    fine = [np.einsum("ij,ij->i", q[row[lo : lo + 65536]], graph.unit[node[lo : lo + 65536]]) >= threshold for lo in range(0, len(row), 65536)]
    fine = np.concatenate(fine) if fine else np.zeros(0, dtype=bool)
    return row[fine], node[fine]


def scanned(graph: Graph, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs with a cosine of at least the threshold, by brute force."""
    return verified(graph, q, *np.nonzero(q.astype(np.float32) @ graph.walk.T >= threshold - MARGIN), threshold)


def linked(graph: Graph, q: np.ndarray, threshold: float, beam: int = FIRST_BEAM, audit: int = AUDIT, recall: float = RECALL, own: np.ndarray | None = None, widths: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node) of all pairs with a cosine of at least the threshold that the search finds, and the width it ended with.

    own: the queries' own nodes, from which they are searched too, or -1. widths collects the width of each walk of each query.
    """
    n, walk = len(graph.unit), q.astype(np.float32)
    own = np.full(len(q), -1) if own is None else own
    rows = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
    sought = np.bincount(scanned(graph, q[rows], threshold)[0], minlength=len(rows))
    while True:
        parts, left, width = [], np.arange(len(q)), beam
        counts = np.zeros(len(q), dtype=np.int64)
        while len(left):
            if widths is not None:
                widths += [min(width, n)] * len(left)
            if width >= n:
                r, c = scanned(graph, q[left], threshold)
                parts.append((left[r], c))
                counts[left] = np.bincount(r, minlength=len(left))
                break
            ids, sims = graph.search(walk[left], width, own[left])
            # The links are all in the beam if it reaches below the threshold.
            fine = ~((sims[:, -1] >= threshold - BEYOND) & (ids[:, -1] >= 0))
            r, c = np.nonzero((sims >= threshold - MARGIN) & (ids >= 0) & fine[:, None])
            r, c = verified(graph, q[left], r, ids[r, c], threshold)
            parts.append((left[r], c))
            counts[left[fine]] = np.bincount(r, minlength=len(left))[fine]
            left, width = left[~fine], wider(width, n)
        if np.minimum(counts[rows], sought).sum() >= recall * sought.sum() or beam >= n:
            a, b = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
            return a, b, beam
        beam = wider(beam, n)


def wider(width: int, n: int) -> int:
    """The next width of a beam; beyond WIDEST, and from a third of the graph on, it is a scan, which costs less in a graph of bounded size."""
    return 2 * width if 2 * width <= WIDEST and 6 * width < n else n


def near_vectors(vectors: DataFrame, threshold: float = 0.98, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label, ...): vec_id, n_links, component_id, kept.

    Vectors of equal labels and equal lengths link at a cosine of at least the threshold. A vector that is null, empty or zero, or has a null or
    non-finite component or a null label, links with nothing; a null vec_id is linked with nothing, names no component and is not kept. Rows that
    repeat a vec_id with an equal vector and label are one vector; with other ones, the counts of all of them are added. A cosine that is the
    threshold links. Further columns are ignored. An empty table gives an empty table.
    """
    with scratch(vectors.sparkSession) as keep:
        out = _near_vectors(vectors, threshold, shard, block)
        out = materialise(out, "near-vectors")
        keep.append(out)
    return out


def _near_vectors(vectors: DataFrame, threshold: float, shard: int, block: int) -> DataFrame:
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    values = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("e"), F.col("label").cast("string").alias("label"))
    broken = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = rows.where("vec_id is not null and label is not null and e is not null").where((F.size("e") > 0) & ~broken & F.exists("e", lambda v: v != 0)).distinct()
    if single:
        # Exact: the values were of single precision.
        usable = usable.withColumn("e", F.col("e").cast("array<float>"))
    usable = materialise(usable, "usable")
    nodes = materialise(usable.groupBy("label", "e").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    sizes = nodes.groupBy("label", F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("total")).withColumn("shards", F.ceil(F.col("total") / shard).cast("int"))
    sizes = sizes.select("label", "dim", "shards", F.ceil(F.col("total") / F.col("shards") / block).cast("int").alias("per"))
    placed = nodes.withColumn("dim", F.size("e")).join(sizes, ["label", "dim"])
    placed = materialise(placed.select("label", "dim", "shards", "per", F.pmod(F.xxhash64("e"), F.col("shards")).cast("int").alias("shard"), "node", "copies", "e"), "placed")
    kind = np.float32 if single else np.float64
    graphs = materialise(placed.groupBy("label", "dim", "shard").applyInPandas(lambda g: _build(g, kind), "label string, dim int, shards int, per int, shard int, graph binary, ids binary"), "graphs")
    in_block = placed.withColumn("block", F.pmod(F.xxhash64("e", F.lit(3)), F.col("per")).cast("int"))
    blocks = in_block.groupBy("label", "dim", F.col("shard").alias("from"), "block").applyInPandas(lambda g: _block(g, kind), "label string, dim int, shards int, per int, from int, block int, q binary, qids binary")
    # Tiles of few shards are several tasks, of TOGETHER blocks at least.
    parts = F.ceil(F.col("per") / (TOGETHER * F.col("shards"))).cast("int")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / TILE).cast("int")))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    asked = blocks.select("label", "dim", tile("from").alias("tile"), tiles.alias("target"), F.pmod("block", parts).alias("part"), "from", "block", "q", "qids")
    targets = graphs.select("*", tiles.alias("tile")).select("label", "dim", "tile", tile("shard").alias("target"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "shard", "graph", "ids")
    keys = ["label", "dim", "tile", "target", "part"]
    found = asked.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(lambda q, g: _query(q, g, threshold, kind), "a long, n long, b long")
    found = materialise(found, "found")
    roots = connected_components(found.where("b is not null").select("a", "b"))
    near = found.where("n is not null").groupBy(F.col("a").alias("na")).agg(F.sum("n").alias("n"))
    # A node's id may stand for several vectors only if vec_ids repeat; their counts were added above.
    result = materialise(
        nodes.join(near, F.col("node") == F.col("na"), "left").join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left")
        .select(F.col("label").alias("l"), F.xxhash64("e").alias("h"), F.col("e").alias("re"), (F.coalesce("n", F.lit(1)) - 1).alias("n"), F.coalesce("root", "node").alias("root")),
        "result",
    )
    one = usable.join(result, (F.col("label") == F.col("l")) & (F.xxhash64("e") == F.col("h")) & (F.col("e") == F.col("re")))
    one = materialise(one.groupBy(F.col("vec_id").alias("vid")).agg(F.sum("n").alias("n"), F.min("root").alias("root")), "one")
    return rows.select("vec_id").join(one, F.col("vec_id") == F.col("vid"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept")
    )


def _rows(group: pd.DataFrame, kind) -> tuple[pd.DataFrame, np.ndarray]:
    group = group.sort_values("node", kind="stable")
    return group, np.array(group["e"].tolist(), dtype=kind)


def _build(group: pd.DataFrame, kind) -> pd.DataFrame:
    group, raw = _rows(group, kind)
    ids = np.column_stack((group["node"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)))
    return pd.DataFrame({**{k: group[k].iloc[:1] for k in ("label", "dim", "shards", "per", "shard")}, "graph": [Graph.build(raw).to_bytes()], "ids": [ids.tobytes()]})


def _block(group: pd.DataFrame, kind) -> pd.DataFrame:
    group, raw = _rows(group, kind)
    first = {k: group[k].iloc[:1] for k in ("label", "dim", "shards", "per", "block")}
    return pd.DataFrame({**first, "from": group["shard"].iloc[:1], "q": [raw.tobytes()], "qids": [group["node"].to_numpy(np.int64).tobytes()]})[["label", "dim", "shards", "per", "from", "block", "q", "qids"]]


def _query(blocks: pd.DataFrame, targets: pd.DataFrame, threshold: float, kind) -> pd.DataFrame:
    """Rows (a, n, null) with the weight of a's links in a shard, itself included, and edges (a, null, b) that span what is linked there."""
    out = [pd.DataFrame({k: pd.array([], dtype="Int64") for k in "anb"})]
    for target in targets.itertuples():
        graph, ids = Graph.from_bytes(target.graph), np.frombuffer(target.ids, np.int64).reshape(-1, 2)
        for row in blocks.itertuples():
            qid = np.frombuffer(row.qids, np.int64)
            q = unit(np.frombuffer(row.q, kind).reshape(len(qid), -1))
            place = np.minimum(np.searchsorted(ids[:, 0], qid), len(ids) - 1)
            own = np.where(ids[place, 0] == qid, place, -1)
            a, b, _ = linked(graph, q, threshold, own=own)
            # A unit vector's product with itself may round to just below the threshold only if that is 1.
            missing = own >= 0
            missing[a[own[a] == b]] = False
            n = np.bincount(a, ids[b, 1], len(qid)).astype(np.int64) + np.where(missing, ids[place, 1], 0)
            out.append(pd.DataFrame({"a": qid, "n": pd.array(n, dtype="Int64"), "b": pd.array([None] * len(qid), dtype="Int64")}))
            node, low = spanning_edges(qid[a], ids[b, 0])
            out.append(pd.DataFrame({"a": node, "n": pd.array([None] * len(node), dtype="Int64"), "b": pd.array(low, dtype="Int64")}))
    return pd.concat(out)


def op3_hnsw_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
links as (
  select x.vec_id as a, y.vec_id as b from usable x join usable y
  on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.98),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
lowest as (select a, min(b) as b from reached group by a),
counted as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
from embeddings left join lowest on vec_id = lowest.a left join counted on vec_id = counted.a
"""
