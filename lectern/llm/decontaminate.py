"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Tokens are hashed once per text. At every position a few fixed masks pick tokens, ignoring the ones between, and the
hash of what they pick is looked up among the hashes of the benchmark's positions. Around a hit the aligned tokens of document and item are
compared: an overlap needs a window of WINDOW aligned tokens of which at least MATCHES are equal, so that substitutions do not hide a passage and
one shared phrase does not make one. Items that are shorter than the window need the same share of their own length, and those of fewer than
LEAST tokens, where one substitution leaves no phrase, all of their tokens in a row.

The masks miss nothing: every way to place the substitutions that a window may have (3 of 13, 2 of 9 to 12, 1 of 8 tokens) leaves some mask
whole, which the tests check one by one. So which windows are found does not depend on the masks.

The positions of a document are generated and looked up within one stage: only hits leave it. The benchmark's seeds
are broadcast if their number is at most BROADCAST_SEEDS. Beyond it, ids, places and seeds are joined by shuffle, and the tokens of pieces of
documents that have hits are joined to these afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_bits, materialise, maybe_among, scratch

#: Fixed masks: a 1 is a token that the seed reads. They begin and end with one.
MASKS = ("110111", "110001011", "1111001", "101000111")
#: Tokens of the shortest item that may have substitutions.
LEAST = 8
WINDOW, MATCHES = 13, 10
#: Seeds are rows of 24 bytes; so many at most are broadcast.
BROADCAST_SEEDS = 2_000_000
#: Places of a document that are in a piece, where tokens have to be joined to hits.
PIECE = 1024


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case; a null or empty text has none of them."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x))


def _seed(tokens: str, at: Column, mask: str) -> Column:
    """The hash of what a mask picks at a place, null where the text ends before it does."""
    return F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(mask), *(F.get(tokens, at + k) for k, on in enumerate(mask) if on == "1")))


def _places(table: DataFrame, tokens: str, at: str, masks: tuple[str, ...]) -> DataFrame:
    """table with one row per place and mask: its columns, the place, and the seed, which may be null."""
    shortest = min(map(len, masks))
    placed = table.select("*", F.posexplode(F.expr(f"slice({tokens}, 1, greatest(size({tokens}) - {shortest - 1}, 0))")).alias(at, "__token")).drop("__token")
    return placed.select("*", F.explode(F.array(*(_seed(tokens, F.col(at), m) for m in masks))).alias(f"{at}_seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, matches: int = MATCHES, broadcast_seeds: int = BROADCAST_SEEDS, piece: int = PIECE) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_windows (windows that pass), matched (most equal tokens of one), doc_at (first token of the first).

    docs(doc_id, text, ...), benchmark(item_id, text, ...); other columns are ignored. A window may reach beyond either text, where nothing is equal. Null ids,
    null or empty texts and empty tables give no row. Rows that repeat a doc_id or an item_id count as one document or item with the overlaps
    of all of them, a pair of places once. Very long texts are rows like others; what is compared around a hit is of bounded length.
    The masks are whole for the default window and matches, and for others that allow no more substitutions.
    """
    with scratch(docs.sparkSession) as keep:
        out = materialise(_overlaps(docs, benchmark, window, matches, broadcast_seeds, piece), "overlaps")
        keep.append(out)
    return out


def _overlaps(docs: DataFrame, benchmark: DataFrame, window: int, matches: int, broadcast_seeds: int, piece: int) -> DataFrame:
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_version"), token_hashes(F.col("text")).alias("item"))
    items = materialise(items.where(F.size("item") > 0).distinct(), "items")
    # Items too short for the masks are sought whole, by a mask of their own length.
    short = [r["n"] for r in items.where(F.size("item") < LEAST).select(F.size("item").alias("n")).distinct().orderBy("n").collect()]
    long_seeds = _places(items.where(F.size("item") >= LEAST), "item", "item_at", MASKS)
    whole = [items.where(F.size("item") == n).select("*", F.lit(0).alias("item_at"), _seed("item", F.lit(0), "1" * n).alias("item_at_seed")) for n in short]
    for more in whole:
        long_seeds = long_seeds.unionAll(more)
    sought = long_seeds.select(F.col("item_at_seed").alias("seed"), "item_id", "item_version", "item_at").where("seed is not null").distinct()
    masks = (*MASKS, *("1" * n for n in short))
    few = sought.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    read = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes(F.col("text")).alias("tokens"))
    near = F.slice("tokens", F.greatest(F.lit(1), F.col("doc_at") - window + 2), F.lit(2 * window)).alias("near")
    near_at = F.greatest(F.lit(0), F.col("doc_at") - window + 1)
    same_item = (F.col("item_id") == F.col("iid")) & (F.col("item_version") == F.col("iv"))
    texts = items.select(F.col("item_id").alias("iid"), F.col("item_version").alias("iv"), "item")
    if few:
        hits = _places(read, "tokens", "doc_at", masks).join(F.broadcast(sought), F.col("doc_at_seed") == F.col("seed"))
        hits = hits.select("doc_id", "item_id", "item_version", "item_at", F.col("doc_at").cast("long").alias("doc_at"), near, near_at.cast("long").alias("near_at"), F.lit(0).cast("long").alias("begin"))
        hits = hits.join(F.broadcast(texts), same_item)
    else:
        # A piece holds the tokens of its own places and a window's before and behind them; begin is its first token in the text.
        cut = read.select("doc_id", F.xxhash64("tokens").alias("version"), "tokens", F.explode(F.expr(f"sequence(0, cast(greatest(size(tokens) - 1, 0) / {piece} as int))")).alias("piece"))
        begin = F.greatest(F.lit(0), F.col("piece") * piece - window)
        cut = cut.select("doc_id", "version", "piece", begin.cast("long").alias("begin"), F.slice("tokens", begin + 1, (F.col("piece") * piece - begin) + piece + 2 * window).alias("tokens"))
        own = (F.col("doc_at") + F.col("begin") >= F.col("piece") * piece) & (F.col("doc_at") + F.col("begin") < (F.col("piece") + 1) * piece)
        seeds = _places(cut, "tokens", "doc_at", masks).where(own & F.col("doc_at_seed").isNotNull()).select("doc_id", "version", "piece", "doc_at", "doc_at_seed")
        found = materialise(seeds.join(sought, F.col("doc_at_seed") == F.col("seed")).select("doc_id", "version", "piece", "item_id", "item_version", "item_at", "doc_at").distinct(), "hits")
        back = maybe_among(cut, "doc_id", id_bits(found, "doc_id")).distinct().select(F.col("doc_id").alias("did"), F.col("version").alias("dv"), F.col("piece").alias("dp"), "begin", "tokens")
        hits = found.join(back, (F.col("doc_id") == F.col("did")) & (F.col("version") == F.col("dv")) & (F.col("piece") == F.col("dp")))
        hits = hits.select("doc_id", "item_id", "item_version", "item_at", "doc_at", "begin", near, near_at.alias("near_at")).join(texts, same_item)
    size = F.size("item")
    need = F.least(F.lit(window), size)
    required = F.when(size < LEAST, size).otherwise(F.floor((need * matches + window - 1) / window))
    equal = lambda k: F.coalesce((_at("near", F.col("doc_at") - F.col("near_at") + k) == _at("item", F.col("item_at") + k)), F.lit(False)).cast("int")
    around = F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), equal)
    hits = hits.select("*", need.alias("need"), required.cast("int").alias("required"), around.alias("around"))
    # All windows that hold the first token of the seed, by their first token relative to it.
    first = F.sequence(1 - F.col("need"), F.lit(0))
    total = lambda s: F.aggregate(F.slice("around", s + window, F.col("need")), F.lit(0), lambda a, x: a + x)
    windows = F.filter(F.transform(first, lambda s: F.struct((F.col("begin") + F.col("doc_at") + s).alias("d"), (F.col("item_at") + s).alias("i"), total(s).alias("matched"))), lambda w: w["matched"] >= F.col("required"))
    passed = hits.select("doc_id", "item_id", F.explode(windows).alias("w")).groupBy("doc_id", "item_id", "w.d", "w.i").agg(F.max("w.matched").alias("matched"))
    return passed.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("matched").alias("matched"), F.min(F.greatest(F.lit(0), F.col("d"))).cast("long").alias("doc_at"))


def _at(array: str, index: Column) -> Column:
    return F.when(index >= 0, F.get(array, index))


def op10_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as {}"

#: Without masks: all alignments by equal tokens, and all windows of each.
OP10_SQL = f"""
with items as (select item_id, item, len(item) as n, least({WINDOW}, len(item)) as need from (select item_id, {_SQL_TOKENS.format('item')} from benchmark where item_id is not null and text is not null) where len(item) > 0),
limits as (select *, case when n < {LEAST} then n else (need * {MATCHES} + {WINDOW - 1}) // {WINDOW} end as required from items),
docs as (select doc_id, {_SQL_TOKENS.format('tokens')} from documents where doc_id is not null and text is not null),
places as (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as d from docs),
item_places as (select item_id, need, required, unnest(item) as token, generate_subscripts(item, 1) - 1 as i from limits),
aligned as (
  select doc_id, item_id, d - i as behind, any_value(need) as need, any_value(required) as required, list(distinct d) as same
  from places join item_places using (token) group by doc_id, item_id, d - i having count(distinct d) >= any_value(required)),
windows as (select *, unnest(range(list_min(same) - {WINDOW}, list_max(same) + 1)) as d from aligned),
counted as (select doc_id, item_id, d, behind, required, len(list_filter(same, lambda x: x >= d and x < d + need)) as matched from windows)
select doc_id, item_id, count(distinct (d, behind)) as n_windows, max(matched)::int as matched, min(greatest(0, d))::bigint as doc_at
from counted where matched >= required group by doc_id, item_id
"""
