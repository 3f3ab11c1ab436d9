"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts are packed as wholes. A group that holds more than one part in shards * ITEMS of one of the three totals is an item by
itself; those below it are united by hash into shards * ITEMS items of whole groups, in a first pass that leaves the second one, on the
driver, a bounded number of items at any size of input: each, largest first, goes where there is room and the dot product of its vector with the
residual capacity is highest; room for its bytes counts more than room for its tokens and rows, since bytes are the law. Only a group that by itself exceeds the fair share of a shard is split, into as few equal parts as fit, as sizes could not be near equal otherwise.

The slots of a large item are numbered in pieces by the hash of the id, so that no task sorts more than a small part of a shard; its rows stay in one shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialise, scratch

#: Items of small groups per shard; a group of more than the share of one of them is an item of its own.
ITEMS = 512
DIMS = ("size", "tokens", "one")


def count_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (a row of sizes per dimension, the one of the law first).

    An item goes to one of the shards with room for all of it, else to one with room for its bytes, where the dot product with the residual
    capacity is highest; if there is none, where most bytes are left.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    v = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(v), dtype=int)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        room = left >= v[i] - 1e-9
        score = np.where(room.all(axis=1), 2e6, np.where(room[:, 0], 1e6, 0)) + np.where(room[:, 0], left @ v[i], left[:, 0])
        out[i] = s = int(np.argmax(score))
        left[s] -= v[i]
    return out


def assign_shards(docs: DataFrame, shards: int = 8, items: int = ITEMS, tokens=count_tokens) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard (null under this law).

    A null text counts as empty: size 1, crc32 0. Repeated rows and null ids are rows like others; equal texts stay together, unless they alone exceed the
    fair share of a shard. Ties between shards go to the first one. No rows give no rows. A text of any length is one row. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with scratch(spark) as keep:
        base = materialise(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                tokens(text).cast("long").alias("tokens"), F.xxhash64(text).alias("group"), F.lit(1).cast("long").alias("one"),
            ),
            "rows",
        )
        keep.append(base)
        sums = [F.sum(d).cast("double").alias(d) for d in DIMS]
        total = base.agg(*sums).first()
        limit = shards * items
        share = F.greatest(*(F.col(d) / max(1.0, total[d] or 0.0) for d in DIMS))
        # At most 3 * limit groups can exceed 1 / limit of one of three totals.
        heavy = base.groupBy("group").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / limit).collect()
        # group, parts that may go to several shards, and pieces of each part that are numbered by themselves
        parts = [(r["group"], int(min(r["one"], np.ceil(r["share"] * shards))), int(max(1, min(r["one"], np.ceil(r["share"] * limit))))) for r in heavy]
        heavy_df = F.broadcast(spark.createDataFrame(parts, "heavy long, parts int, pieces int"))
        light = F.concat(F.lit("light "), F.pmod(F.xxhash64(F.col("group"), F.lit(1)), F.lit(limit)).cast("string"))
        own = F.concat(F.lit("heavy "), F.col("heavy").cast("string"), F.lit(" "), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("string"))
        piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("pieces")), F.lit(0)).cast("int")
        placed = base.join(heavy_df, F.col("group") == F.col("heavy"), "left").withColumn("item", F.when(F.col("heavy").isNull(), light).otherwise(own)).withColumn("piece", piece).drop("heavy", "parts", "pieces", "group")
        # At most limit light items, and about 6 * limit pieces of heavy ones, as a piece holds at least half of one part in limit.
        counted = placed.groupBy("item", "piece").agg(*sums).orderBy("item", "piece").collect()
    sizes: dict[str, np.ndarray] = {}
    for r in counted:
        sizes[r["item"]] = sizes.get(r["item"], 0) + np.array([r[d] for d in DIMS])
    where = dict(zip(sizes, pack(np.array(list(sizes.values())).reshape(-1, len(DIMS)), shards), strict=True))
    begin, plan = [0] * shards, []
    for r in counted:
        s = int(where[r["item"]])
        plan.append((r["item"], r["piece"], s, begin[s]))
        begin[s] += int(r["one"])
    plan_df = F.broadcast(spark.createDataFrame(plan, "item string, piece int, shard int, begin long"))
    rank = F.row_number().over(Window.partitionBy("item", "piece").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("rank", rank).join(plan_df, ["item", "piece"]).select(
        "doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_vector_bin_packing(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
