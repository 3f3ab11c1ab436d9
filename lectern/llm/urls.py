"""URL filter: rules by host and path, and logistic regression over hashed character n-grams where no rule fits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.textvec import LOWER, U, chunks

BITS = 14
ORDERS = (3, 4, 5)

#: The rules of the query: verdict, host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_GOOD_HOSTS = "news.example.org www.library.org docs.museum.edu blog.garden.org m.weather.info archive.history.org school.edu wiki.science.org shop.bakery.org en.recipes.org city.gov health.gov university.edu forum.music.org travel.rivers.org www.meadow.example.net m.harbor.example.net blog.orchard.example.net lantern.example.net www.pebble.example.org m.willow.example.org blog.copper.example.org marble.example.com"
_BAD_HOSTS = "spam-farm.example.org free-casino.biz win-prize.top adult-chat.xxx cheap-pills.biz best-loans.click click-farm.top hot-adult.xxx casino-bonus.org seo-links.top spam-mail.info free-pills.org crack-warez.info bet-now.top link-farm.example.net www.spam-farm.example.net m.casino-win.example.net blog.cheap-pills.example.org cheap-pills.example.com win-money.example.org"
_GOOD_PATHS = "/ /about /en/2021/article.html /de/17 /es/story /fr/page/3 /wiki/Main /docs/index.html /blog/post-12"
_BAD_PATHS = "/ /buy-now /free-bonus /xxx/chat /pills/cheap.html /casino/win /click?aff=1 /loans/fast /en/728"


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small labelled table: invented (host, path, 1 to block)."""
    return [(h, p, k) for k, (hosts, paths) in enumerate(((_GOOD_HOSTS, _GOOD_PATHS), (_BAD_HOSTS, _BAD_PATHS))) for h in hosts.split() for p in paths.split()]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict) or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that ends at each byte, and whether it lies within one text."""
    c = LOWER[data].astype(U)
    place = np.arange(len(c)) - np.repeat(offs[:-1], np.diff(offs))
    h = np.zeros(len(c), U)
    for n in range(max(ORDERS)):
        h = h * U(0x9E3779B97F4A7C15) + np.concatenate((np.zeros(n, U), c))[: len(c)] + U(1)
        if n + 1 in ORDERS:
            yield ((h * U(0xD6E8FEB86659FD93)) >> U(64 - BITS)).astype(np.int64), place >= n


def texts(host: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([f"^{h}${p}" for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)], pa.string())


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        out = [np.empty(0)]
        for _, data, offs in chunks(texts(host, path)):
            z = sum(np.add.reduceat(np.where(inside, self.weight[g], 0), offs[:-1]) for g, inside in _grams(data, offs)) / np.sqrt(np.diff(offs)) + self.bias
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out)


def fit(table: list[tuple[str, str, int]], steps: int = 400, rate: float = 1.0, l2: float = 1e-3) -> Model:
    """Logistic regression by gradient descent over the whole small table."""
    column = texts(pa.array([r[0] for r in table], pa.string()), pa.array([r[1] for r in table], pa.string()))
    x = np.zeros((len(table), 1 << BITS))
    for lo, data, offs in chunks(column):
        own = np.repeat(np.arange(lo, lo + len(offs) - 1), np.diff(offs))
        for g, inside in _grams(data, offs):
            np.add.at(x, (own[inside], g[inside]), 1 / np.sqrt(np.diff(offs)[own[inside] - lo]))
    y = np.array([r[2] for r in table], float)
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps if len(table) else 0):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ e / len(y) + l2 * w)
        b -= rate * e.mean()
    return Model(w, b)


def judge(pages: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url, ...).

    A null url or one without :// has an empty host and path, which no rule fits; the method judges it. Repeated rows, null ids: one result each, and
    equal urls equal ones. A url of any length is judged as a whole. An empty table gives an empty one; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_urls()))
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("by_rule"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(1), batch.column(2)))], names=[*batch.schema.names, "score"])

    return cut.mapInArrow(score, "page_id long, host string, path string, rule string, by_rule string, score double").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
