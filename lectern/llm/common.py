"""What the operators share: written intermediates, id filters, connected components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes in bits of an id filter. Its broadcast has at most MOST_BITS / 64 rows of 16 bytes (16 MB), whatever the input.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26



class _Scopes(threading.local):
    """Paths of tables written within the open scopes of scratch(), innermost last, for each thread."""

    def __init__(self):
        self.open: list[set[str]] = []


_scopes = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lectern-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and returns a scan of it: this cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].add(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialise(); only for tables that no later plan reads."""
    for path in _folders(df):
        if "/lectern-" in path:
            delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that were materialised within, but for those of the frames that the body appends to the yielded list.

    What is kept belongs to the enclosing scope, if there is one.
    """
    keep: list[DataFrame] = []
    _scopes.open.append(set())
    try:
        yield keep
    finally:
        mine = _scopes.open.pop()
        names = {path.rsplit("/", 1)[1] for df in keep for path in _folders(df)}
        for path in mine:
            if path.rsplit("/", 1)[1] not in names:
                delete(spark, path)
            elif _scopes.open:
                _scopes.open[-1].add(path)


def smallest_hashes(df: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of a column, ties by the other columns: a sample that does not depend on partitions.

    A threshold leaves little more than the sample before the top is taken, so that what reaches the driver does not grow with the partitions.
    df has few and small columns; it is written once, and read three times. Collect the result within the scope in which this is called.
    """
    df = materialise(df, "keys")
    total = df.count()
    key = F.xxhash64(column)
    least, span, share = -(1 << 63), 1 << 64, 1.25 * (most + 1000) / max(total, 1)
    while share < 1:
        near = df.where(key < F.lit(least + int(span * share)))
        if near.count() >= most:
            df = near
            break
        share *= 2
    return df.orderBy(key, column, *(c for c in df.columns if c != column)).limit(most)


def id_bits(ids: DataFrame, column: str) -> DataFrame:
    """A Bloom filter with one hash as a table (word, bits), of 16 bits per id, but of MOST_BITS at most."""
    total = ids.count()
    size = LEAST_BITS
    while size < min(16 * total, MOST_BITS):
        size *= 2
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size))
    return (
        ids.select(F.floor(at / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
        .withMetadata("word", {"size": size})
    )


def flag_among(df: DataFrame, column: str, bits: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column: false only for ids that are surely not in the filter."""
    size = bits.schema["word"].metadata["size"]
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size))
    small = F.broadcast(bits.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    return (
        df.withColumn("__at", at)
        .join(small, F.floor(F.col("__at") / 64).cast("int") == F.col("__word"), "left")
        .withColumn(flag, F.coalesce(F.expr("(__bits & shiftleft(1L, cast(__at % 64 as int))) != 0L"), F.lit(False)))
        .drop("__at", "__word", "__bits")
    )


def maybe_among(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows of df whose id may be in the filter: all that are, and a few that are not. Only saves shuffle; an exact join follows."""
    return flag_among(df, column, bits, "__maybe").where("__maybe").drop("__maybe")


def spanning_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) for the other nodes of the links u-v: as many edges as nodes, with the same components."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, new[u])
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(names))
    return names[far], names[low[far]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node that can be reached.

    Every round hooks each node to its smallest neighbour, jumps pointers once, and contracts the edges; the maps
    of the rounds are composed at the end. A star, which is what hub-wise linking gives, takes one round. Nothing
    is collected: all state is in written tables. Null ends and loops are ignored.
    """
    e = materialise(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    layers: list[DataFrame] = []
    while not e.isEmpty() or not layers:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(e.select(F.col("b"), F.col("a")))
        hook = materialise(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("p")), "hook")
        up = hook.select(F.col("v").alias("u"), F.col("p").alias("pp"))
        jump = materialise(hook.join(up, hook.p == up.u).select("v", F.col("pp").alias("p")), "jump")
        discard(hook)
        layers.append(jump)
        pa, pb = (jump.select(F.col("v").alias(f"v{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
        smaller = materialise(
            e.join(pa, F.col("a") == F.col("va")).join(pb, F.col("b") == F.col("vb")).where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        discard(e)
        e = smaller
    out = layers[0].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for layer in layers[1:]:
        nxt = layer.select(F.col("v").alias("u"), F.col("p").alias("pp"))
        out = out.join(nxt, out.root == nxt.u, "left").select("node", F.coalesce("pp", "root").alias("root"))
    out = materialise(out, "roots")
    for used in [e, *layers]:
        discard(used)
    return out
