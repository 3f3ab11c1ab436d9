"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features are densities of a lexicon that is learned from the labelled sample (each fold of it scored with a lexicon of the other folds), the
share of its hits near a word of second person, capitals, punctuation, digits, odd symbols, and rates of obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, smallest_hashes
from lectern.llm.textvec import ALNUM, U, chunks, words

#: The fit uses at most so many labelled documents, those with the smallest hashes of their ids, with whole texts.
TRAIN_ROWS = 20_000
#: The lexicon has at most so many words.
LEXICON = 4096
FOLDS = 5
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
#: Plain insults, so that a small sample is not all that the lexicon rests on.
INSULTS = "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool jerk imbecile"
NEAR = 6
NAMES = ["words", "hits", "hit_rate", "weight_rate", "weight_max", "strong", "insults", "insult_rate", "second", "near", "upper", "punct", "bangs", "digits", "odd", "mixed", "runs", "mean_word"]

_UPPER = np.zeros(256, np.uint8); _UPPER[65:91] = 1
_ALPHA = np.zeros(256, np.uint8); _ALPHA[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1
_DIGIT = np.zeros(256, np.uint8); _DIGIT[48:58] = 1
_PUNCT = np.zeros(256, np.uint8); _PUNCT[[ord(x) for x in ".,;:!?'\"()-"]] = 1
_BANG = np.zeros(256, np.uint8); _BANG[[ord(x) for x in "!?"]] = 1
_ODD = np.zeros(256, np.uint8); _ODD[[ord(x) for x in "@#$%^&*_+=|~<>"]] = 1


def hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]), ALNUM)[0])


def _sums(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def features(data: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of NAMES per text. weights: one per word of the sorted lexicon, or a row of them per text."""
    n = len(offs) - 1
    h, s, e, at = words(data, offs, ALNUM)
    owner = np.repeat(np.arange(n), np.diff(at))
    count = np.diff(at).astype(float)
    some = np.maximum(count, 1)
    size = np.maximum(np.diff(offs), 1).astype(float)
    per = lambda values: np.bincount(owner, values, n)

    weight = np.zeros(len(h))
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        found = np.flatnonzero(lexicon[place] == h)
        weight[found] = weights[place[found]] if weights.ndim == 1 else weights[owner[found], place[found]]
    hit = weight > 0
    best = np.zeros(n)
    np.maximum.at(best, owner[hit], weight[hit])
    insult = np.isin(h, _INSULTS)
    second = np.isin(h, _SECOND)
    places = np.flatnonzero(second)
    near = np.zeros(len(h))
    if len(places):
        for i in np.flatnonzero(hit | insult):
            k = np.searchsorted(places, i)
            near[i] = any(0 <= q < len(places) and abs(places[q] - i) <= NEAR and owner[places[q]] == owner[i] for q in (k - 1, k))
    letters = np.concatenate(([0], np.cumsum(_ALPHA[data], dtype=np.int64)))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int64)))
    mixed = (letters[e] > letters[s]) & (digits[e] > digits[s]) if len(s) else np.zeros(0, bool)
    run = np.zeros(len(data), np.uint8)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (_ALPHA[data[2:]] > 0)
    run_total = np.concatenate(([0], np.cumsum(run, dtype=np.int64)))
    alpha = np.maximum(_sums(_ALPHA, data, offs), 1)
    hits, insults = per(hit), per(insult)
    return np.column_stack(
        [
            np.log1p(count), hits, hits / some, per(weight) / some, best, per(weight > 2.5), insults, insults / some, per(second) / some, per(near) / np.maximum(hits + insults, 1),
            _sums(_UPPER, data, offs) / alpha, _sums(_PUNCT, data, offs) / size, _sums(_BANG, data, offs) / size, _sums(_DIGIT, data, offs) / size, _sums(_ODD, data, offs) / size,
            per(mixed) / some, (run_total[offs[1:]] - run_total[offs[:-1]]) / size, np.bincount(owner, e - s, n) / some,
        ]
    )


_INSULTS, _SECOND = hashes(INSULTS), hashes(SECOND_PERSON)


@dataclass
class Trees:
    """Boosted trees of logistic loss on quantile bins, in complete binary trees of a fixed depth."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    l2: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(width)]
        b = self._binned(x)
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        raw = np.full(n, self.base)
        flat = b + np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            feature, cut, node = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, self.bins, int), np.zeros(n, int)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (width * self.bins) + flat).ravel()
                size = many * width * self.bins
                gs = np.bincount(key, np.repeat(g, width), size).reshape(many, width, self.bins).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, width), size).reshape(many, width, self.bins).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                good = gain.reshape(many, -1).max(axis=1) > 1e-6
                feature[first : first + many] = best // self.bins
                cut[first : first + many] = np.where(good, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            raw += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self._binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (raw, probability) of the pools' centres, both ascending."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of y, sum of raw, count
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), float(r), 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


@dataclass
class Model:
    lexicon: np.ndarray
    weights: np.ndarray
    trees: Trees | None
    at: np.ndarray
    to: np.ndarray
    rate: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offs) - 1, self.rate)
        raw = self.trees.raw(features(data, offs, self.lexicon, self.weights))
        # A hundredth of the plain probability keeps an order among documents of one pool.
        return np.clip(0.99 * np.interp(raw, self.at, self.to) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for lo, data, offs in chunks(batch.column(0)):
            h, _, _, at = words(data, offs, ALNUM)
            own = np.repeat(np.arange(lo, lo + len(offs) - 1), np.diff(at))
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            h, own = h[new], own[new]
            key, at = np.unique(np.column_stack((h, (fold[own] * 2 + toxic[own]).astype(U))), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(np.ascontiguousarray(key[:, 0]).view(np.int64)), pa.array(key[:, 1].astype(np.int64)), pa.array(at.astype(np.int64))], names=["word", "kind", "n"])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    odds = np.log((toxic + 0.1) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((toxic >= 2) & (odds > 1), odds, 0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic). Rows with a null label or id are left out, a null text is empty.

    Of a doc_id that is labelled more than once the largest label counts. Without rows of both labels the score is
    the share of toxic rows (0 without rows).
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        sample = smallest_hashes(known.join(texts.select("id"), "id", "left_semi"), "id", train_rows).toPandas()
    y_all = sample["toxic"].to_numpy(int) if len(sample) else np.zeros(0, int)
    rate = float(y_all.mean()) if len(y_all) else 0.0
    none = Model(np.empty(0, U), np.empty(0), None, np.empty(0), np.empty(0), rate)
    if len(set(y_all.tolist())) < 2:
        return none
    chosen = F.broadcast(spark.createDataFrame(sample))
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")
    rows = texts.join(chosen, "id").select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"), F.col("id").cast("long").alias("id"))
    counts = rows.mapInArrow(_vocabulary, "word long, kind long, n long").groupBy("word").pivot("kind", list(range(2 * FOLDS))).agg(F.sum("n")).na.fill(0)
    tox, all_ = sum(F.col(str(2 * k + 1)) for k in range(FOLDS)), sum(F.col(str(k)) for k in range(2 * FOLDS))
    top = counts.withColumn("tox", tox).withColumn("ratio", (tox + 0.1) / (all_ - tox + 0.5)).where((F.col("tox") >= 3) & (F.col("ratio") > 3 * rate / (1 - rate)))
    lex = top.orderBy(F.desc(F.col("tox") * F.log1p("ratio")), "word").limit(LEXICON).toPandas()
    word = lex["word"].to_numpy(np.int64).view(U) if len(lex) else np.empty(0, U)
    order = np.argsort(word)
    word = word[order]
    table = lex[[str(k) for k in range(2 * FOLDS)]].to_numpy(float)[order] if len(lex) else np.zeros((0, 2 * FOLDS))

    per = rows.groupBy("fold", "toxic").count().collect()
    size = np.zeros((FOLDS, 2))
    for r in per:
        size[r["fold"], r["toxic"]] = r["count"]
    c, t = table[:, 0::2], table[:, 1::2]
    full = _log_odds(t.sum(1), c.sum(1), size[:, 1].sum(), size[:, 0].sum())
    without = np.array([_log_odds(t.sum(1) - t[:, k], c.sum(1) - c[:, k], size[:, 1].sum() - size[k, 1], size[:, 0].sum() - size[k, 0]) for k in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, data, offs in chunks(batch.column(0)):
                n = len(offs) - 1
                f = np.zeros((n, len(NAMES)))
                for k in range(FOLDS):
                    mine = own[lo : lo + n] == k
                    if mine.any():
                        f[mine] = features(data, offs, word, without[k])[mine]
                yield pa.record_batch([batch.column(3).slice(lo, n), batch.column(1).slice(lo, n), *(pa.array(f[:, j]) for j in range(f.shape[1]))], names=["id", "toxic", *NAMES])

    got = rows.mapInArrow(measure, "id long, toxic int, " + ", ".join(f"{x} double" for x in NAMES)).toPandas().sort_values("id", kind="stable")
    x, y, ids = got[NAMES].to_numpy(float), got["toxic"].to_numpy(float), got["id"].to_numpy(np.int64)
    part = np.random.default_rng(11).permutation(len(ids)) % 4
    raw = np.zeros(len(y))
    for k in range(4):
        held = part == k
        raw[held] = Trees().fit(x[~held], y[~held]).raw(x[held]) if 0 < y[~held].sum() < (~held).sum() else 0
    at, to = isotonic(raw, y)
    return Model(word, full, Trees().fit(x, y), at, to, rate)


#: A document that scores at least this is rejected, here and in the pipeline.
THRESHOLD = 0.3


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of docs(doc_id, text, ...), repeated rows and null ids included; a null text counts as empty.

    A text of any length is scored as a whole. Equal texts have equal scores. An empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs in chunks(batch.column(1)):
                p = shared.value.score(data, offs)
                yield pa.record_batch([batch.column(0).slice(lo, len(p)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")


def op7_boosted_tree_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs, labels.where(~held))
    return toxicity(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
