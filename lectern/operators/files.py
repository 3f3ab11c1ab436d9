"""Inventories of files: union, groups of equal content, canonical copies, reports. Ordinals (ord) decide ties: the first row in input order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import archive_path, basename, contains_any, years

# Marks of copies, terms of reference material and of contest material.
NUMBERED_COPIES = ("(2)", "(3)", "(4)")
REFERENCE_TERMS = ("coursebook", "calculus", "solved problems", "cambridge", "bpoc", "textbook")
REFERENCE_KEYWORDS = ("book", "coursebook", "calculus", "solved problems", "cambridge", "bpoc")
BAD_TERMS = ("coursebook", "calculus", "solved problems", "bpoc", "textbook")
GOOD_TERMS = ("contest", "nsmq", "round", "final", "prelim", "question")
# Terms of the categories that paths hint at.
FORMATS = {
    "round_1": ("round 1", "round1"),
    "round_2": ("round 2", "round2"),
    "round_3": ("round 3", "round3"),
    "round_4": ("round 4", "round4"),
    "round_5": ("round 5", "round5"),
    "speed_race": ("speed race",),
    "true_false": ("true or false",),
    "riddles": ("riddle",),
    "problem_of_day": ("problem of the day", "potd"),
    "final": ("final",),
    "prelim": ("prelim",),
    "regional": ("regional",),
}
# Names of special samples.
SPECIAL_SAMPLES = ("speed race", "true or false", "riddle", "problem of the day")
MOST_PATTERNS = 1000
SUBJECTS = {"biology": ("biology",), "chemistry": ("chemistry",), "mathematics": ("math",), "physics": ("physics",)}


def _copy_marks(name: Column) -> Column:
    return F.when(contains_any(name, NUMBERED_COPIES), 5).otherwise(0)


def file_score(path: Column, name: Column, ext: Column) -> Column:
    """The less, the better as the canonical copy among loose files."""
    path, name = F.lower(path), F.lower(name)
    return F.when(path.contains("copy of"), 10).otherwise(0) + _copy_marks(name) + F.when(name.startswith("copy"), 5).otherwise(0) + F.when(ext == ".doc", 2).otherwise(0)


def unified_score(source_type: Column, ext: Column, name: Column, path: Column) -> Column:
    """The less, the better as the canonical copy among loose files and archive members."""
    return (
        F.when(source_type == "archive_member", 10).otherwise(0) + F.when(ext == ".doc", 2).otherwise(0)
        + F.when(F.lower(path).contains("copy of"), 10).otherwise(0) + _copy_marks(F.lower(name))
    )


def loose_candidates(inventory: DataFrame) -> DataFrame:
    keep = (F.lower("extension") != ".zip") & ~F.col("filename").startswith("~$")
    return inventory.where(keep).select("sha256", F.lit("loose_file").alias("source_type"), "filename", "extension", "size_bytes", F.col("relative_path").alias("source_path"))


def archive_candidates(members: DataFrame) -> DataFrame:
    name = basename(F.col("member_path"))
    return members.where(~name.startswith("~$")).select(
        "sha256", F.lit("archive_member").alias("source_type"), name.alias("filename"), "extension", "size_bytes", archive_path(F.col("archive"), F.col("member_path")).alias("source_path")
    )


def unified_corpus(candidates: DataFrame) -> DataFrame:
    """One row per content hash; candidates have an ord column, loose files before members. A single aggregation: no join back."""
    score = unified_score(F.col("source_type"), F.col("extension"), F.col("filename"), F.col("source_path"))
    best = F.min(F.struct(score.alias("score"), "ord", "source_type", "filename", "extension", "source_path", "size_bytes"))
    rows = candidates.groupBy("sha256").agg(best.alias("b"), F.count(F.lit(1)).alias("source_count"), F.array_join(F.array_sort(F.collect_list("source_path")), " | ").alias("all_sources"))
    return rows.select(
        "sha256", F.col("b.source_type").alias("canonical_source_type"), F.col("b.filename").alias("canonical_filename"), F.col("b.extension").alias("canonical_extension"),
        F.col("b.source_path").alias("canonical_path"), F.col("b.size_bytes").alias("size_bytes"), "source_count", "all_sources",
    )


def source_rows(candidates: DataFrame) -> DataFrame:
    """The sources of each content as rows, for contents with too many for one array."""
    return candidates.select("sha256", "source_type", "source_path")


def packages(corpus: DataFrame) -> DataFrame:
    """Canonical sources that are word-processor packages."""
    return corpus.where(F.col("canonical_extension") == ".docx")


def only_in_archives(corpus: DataFrame) -> DataFrame:
    """Canonical sources that no loose file has."""
    return corpus.where(F.col("canonical_source_type") == "archive_member")


def in_group_order(groups: DataFrame, count: str = "duplicate_count") -> DataFrame:
    """Members of duplicate_files(): the largest groups first, groups of equal size and members in input order."""
    return groups.orderBy(F.desc(count), "first", "ord")


def in_path_order(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy(F.lower("canonical_path"), "canonical_path")


def cross_source_duplicates(candidates: DataFrame) -> DataFrame:
    """Members of groups that more than one kind of source has."""
    groups = candidates.groupBy("sha256").agg(F.count(F.lit(1)).alias("source_count"), F.min("source_type").alias("lo"), F.max("source_type").alias("hi")).where("lo <> hi").select("sha256", "source_count")
    return candidates.join(groups, "sha256").select("sha256", "source_count", "source_type", "filename", "extension", "source_path")


def duplicate_files(inventory: DataFrame) -> DataFrame:
    """Members of groups of equal content, with the canonical one marked; inventory has an ord column."""
    score = file_score(F.col("relative_path"), F.col("filename"), F.col("extension"))
    groups = inventory.groupBy("sha256").agg(F.count(F.lit(1)).alias("duplicate_count"), F.min(F.struct(score.alias("s"), "ord")).alias("b"), F.min("ord").alias("first")).where("duplicate_count > 1")
    return inventory.join(groups, "sha256").select("sha256", "duplicate_count", "filename", "extension", "relative_path", (F.col("ord") == F.col("b.ord")).alias("canonical"), "first", "ord")


def canonical_files(inventory: DataFrame) -> DataFrame:
    score = file_score(F.col("relative_path"), F.col("filename"), F.col("extension"))
    return inventory.groupBy("sha256").agg(F.min(F.struct(score.alias("s"), "ord", "relative_path", "extension")).alias("b"), F.count(F.lit(1)).alias("duplicate_count")).select(
        "sha256", F.col("b.relative_path").alias("canonical_path"), F.col("b.extension").alias("canonical_extension"), "duplicate_count"
    )


def hash_groups(df: DataFrame, key: str = "sha256") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def largest_groups(df: DataFrame, k: int = 10, paths: int = 5, key: str = "sha256", path: str = "relative_path") -> DataFrame:
    """The k largest groups with their first few paths."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1").orderBy(F.desc("n"), "first").limit(k)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    members = df.join(F.broadcast(top), key).withColumn("r", rank).where(F.col("r") <= paths)
    return members.groupBy(key, "n", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", path))), lambda x: x[path]).alias("paths"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values, most frequent first, ties by first row."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first")


def year_histogram(df: DataFrame, text: Column) -> DataFrame:
    """Rows per year that a text names; a row counts once per year."""
    return df.select(F.explode(years(text)).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, text: Column, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows per label of which any term is in the text. One pass, no join: a row can count for several labels."""
    low = F.lower(text)
    hits = F.array(*(F.when(contains_any(low, terms), F.lit(name)) for name, terms in labels.items()))
    return df.select(F.explode(F.array_compact(hits)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def reference_candidates(df: DataFrame, text: Column, terms=REFERENCE_TERMS) -> DataFrame:
    return df.where(contains_any(F.lower(text), terms))


def competition_hints(df: DataFrame, path: Column) -> DataFrame:
    low = F.lower(path)
    return df.agg(F.count_if(low.contains("nsmq") | low.contains("smq")).alias("quiz"), F.count_if(low.contains("sharks")).alias("sharks"), F.count_if(low.contains("shark")).alias("shark"))


def totals(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def largest(df: DataFrame, size: str = "size_bytes", k: int = 20, tie: str = "ord") -> DataFrame:
    return df.orderBy(F.desc(size), tie).limit(k)


def sample_score(text: Column, bad=BAD_TERMS, good=GOOD_TERMS) -> Column:
    """Contest material before books."""
    low = F.lower(text)
    return sum((F.when(low.contains(t), -100).otherwise(0) for t in bad), F.lit(0)) + sum((F.when(low.contains(t), 10).otherwise(0) for t in good), F.lit(0))


def best_per_pattern(df: DataFrame, text: Column, patterns: DataFrame, score: Column) -> DataFrame:
    """For each pattern of a small table (pattern, rank) the best row whose text contains it, each row once, in the patterns' order.

    The patterns are a list of at most MOST_PATTERNS, so that the nested-loop join passes over df once; the top row per pattern is an aggregate of ids, to which
    the rows are joined back. ord names a row.
    """
    listed = [(r["pattern"], r["rank"]) for r in patterns.select("pattern", "rank").limit(MOST_PATTERNS + 1).collect()]
    if len(listed) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    small = F.broadcast(df.sparkSession.createDataFrame(listed, patterns.select("pattern", "rank").schema))
    hits = df.select("ord", text.alias("__text"), score.alias("__score")).join(small, F.expr("contains(__text, pattern)"))
    best = hits.groupBy("pattern", "rank").agg(F.max_by("ord", F.struct("__score", -F.col("ord"))).alias("__ord"))
    first = F.row_number().over(Window.partitionBy("__ord").orderBy("rank"))
    best = best.withColumn("__r", first).where("__r = 1").drop("__r")
    return df.join(F.broadcast(best), F.col("ord") == F.col("__ord")).drop("__ord").orderBy("rank")


def united_samples(*samples: DataFrame) -> DataFrame:
    """Samples of several lists, each content once, as the first list has it; columns are those of the first list and list, its number."""
    rows = None
    for k, x in enumerate(samples):
        x = x.withColumn("list", F.lit(k))
        rows = x if rows is None else rows.unionByName(x)
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("list", "rank"))
    return rows.withColumn("__r", first).where("__r = 1").drop("__r").orderBy("list", "rank")
