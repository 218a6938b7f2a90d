"""Toxicity by maximum-scoring segments.

Learning: words (runs of letters, lower case) of labelled training texts get log-odds of toxic against clean text with an
informative Dirichlet prior (Monroe et al., 2008: the prior follows the words' overall frequency); a word counts once a text, so that
repetition is no evidence. The same is done for prefixes, since rare words say little by themselves: of a word and its prefixes the
surest (the least chance of its split by binomial tail) speaks for the word. Terms whose log-odds are not large, or not sure
at a false discovery rate (Benjamini and Hochberg), say nothing, whatever the sample's size. A word's score is its log-odds,
drawn towards 0 by one standard deviation, less a drift, so that clean text drifts downwards.

Scoring: one linear scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of a text. Karlin-Altschul statistics say
what is significant: with lambda the root of E[exp(lambda * score)] = 1 over clean words, a segment of score S in a text of n
words has E = n * exp(-lambda * S) (the constant before n is left to the calibration). The significant segments' total and the
extreme value of the best, -ln E, go to a logistic calibration on training texts, which gives a score from 0 to 1.

Learning uses at most MAX_TEXTS labelled texts (those with the smallest hashed ids, whatever the corpus holds). All their terms are counted, tested
and cut by Spark; only the sure ones, which are the model, are collected and sent along with the tasks. Scoring is one narrow pass over
all whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches_as_lists, fold_bucket, settle, table, text_rows

#: Labelled texts to learn from, words remembered; occurrences a term needs; prefix lengths, the longest first.
MAX_TEXTS, MEMO, LEAST, PREFIXES = 30_000, 200_000, 3, (5, 4)
#: Weight of the prior as a share of all counts, false discovery rate and shrunken log-odds of the terms kept; drift a word, E at which a segment is significant.
PRIOR, RATE, LARGE, DRIFT, SIGNIFICANT = 0.02, 0.05, 2.0, 0.1, 0.05

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _terms(found: list[str]):
    """Words, and prefixes of longer words; a prefix is written with a hyphen, which no word has."""
    yield from found
    for w in found:
        for k in PREFIXES:
            if len(w) > k:
                yield f"{w[:k]}-"


def _tail(x: int, n: int, share: float) -> float:
    """log of the chance of x or more hits in n at ``share``."""
    at = math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(share) + (n - x) * math.log1p(-share)
    total, term = 1.0, 1.0
    for k in range(x, n):
        term *= (n - k) / (k + 1) * share / (1 - share)
        total += term
        if term < 1e-9 * total:
            break
    return min(0.0, at + math.log(total))


def kind_of(term: str) -> int:
    """A prefix's length; 0 of a word. Words and the prefixes of a length each are a distribution of their own."""
    return len(term) - 1 if term[-1] == "-" else 0


def evidence(x: int, y: int, na: int, nb: int) -> tuple[float, float]:
    """Of a term in ``x`` toxic and ``y`` clean texts, all of its kind in ``na`` and ``nb``: the log chance of its split, and its log-odds
    drawn towards 0 by one standard deviation."""
    whole, share = PRIOR * (na + nb), na / (na + nb)
    prior = whole * (x + y) / (na + nb)
    d = math.log((x + prior) / (na + whole - x - prior)) - math.log((y + prior) / (nb + whole - y - prior))
    chance = _tail(x, x + y, share) if d > 0 else _tail(y, x + y, 1 - share)
    return chance, math.copysign(max(0.0, abs(d) - math.sqrt(1 / (x + prior) + 1 / (y + prior))), d)


def sure_terms(counted: DataFrame) -> dict[str, tuple[float, float]]:
    """The sure terms' log chance and log-odds; counted (settled): term, kind, toxic, clean."""
    totals = {r.kind: (r.a, r.b) for r in counted.groupBy("kind").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).collect()}
    totals = {k: v for k, v in totals.items() if v[0] and v[1]}

    def run(batches):
        for terms, kinds, xs, ys in batches_as_lists(batches, "term", "kind", "toxic", "clean"):
            out = [(t, k, *evidence(x, y, *totals[k])) for t, k, x, y in zip(terms, kinds, xs, ys)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["term", "kind", "chance", "odds"])

    tested = settle(counted.where((F.col("toxic") + F.col("clean") >= LEAST) & F.col("kind").isin(list(totals))).mapInArrow(run, "term string, kind int, chance double, odds double"))
    # Benjamini and Hochberg: the largest cut c with c <= RATE * (share of chances up to c), from above
    number = {r.kind: r.n for r in tested.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    cut, below = {k: math.log(RATE) for k in number}, None
    while True:
        limit = F.lit(None).cast("double")
        for k, c in cut.items():
            limit = F.when(F.col("kind") == k, F.lit(c)).otherwise(limit)
        sure = tested.where(F.col("chance") <= limit)
        n = {r.kind: r.n for r in sure.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if n == below:
            break
        below, cut = n, {k: math.log(RATE * n[k] / number[k]) for k in n}
        if not cut:
            break
    return {r.term: (r.chance, r.odds) for r in sure.where(F.abs("odds") >= LARGE).collect()}


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (from, to, score), in order. Linear time."""
    left, right, low, high, found = 0.0, 0.0, [], [], []  # cumulative totals before and after each candidate
    for at, s in enumerate(scores):
        left, right = right, right + s
        if s <= 0:
            continue
        start, l = at, left
        j = len(found) - 1
        while True:
            while j >= 0 and low[j] >= l:
                j = found[j][2]  # to the nearest candidate that began lower, as it was linked when it came in
            if j < 0 or high[j] >= right:
                break
            start, l = found[j][0], low[j]
            del found[j:], low[j:], high[j:]
            j = len(found) - 1
        found.append((start, at + 1, j))
        low.append(l)
        high.append(right)
    return [(a, b, h - l) for (a, b, _), l, h in zip(found, low, high)]


@dataclass
class Model:
    score: dict[str, tuple[float, float]]
    rate: float = 1.0  # lambda
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)
    centre: tuple[float, ...] = (0.0, 0.0)

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def of(self, word: str) -> float:
        s = self.memo.get(word)
        if s is None:
            known = [x for term in _terms([word]) if (x := self.score.get(term))]
            s = min(known, default=(0.0, 0.0))[1] - DRIFT
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(word) <= 40:
                self.memo[word] = s
        return s

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """The number of words, and every maximal segment as (from word, to word, score, E)."""
        scores = list(map(self.of, words(text)))
        n = len(scores)
        if not n or max(scores) <= 0:
            return n, []
        return n, [(a, b, s, n * math.exp(-min(700.0, self.rate * s))) for a, b, s in segments(scores)]

    def features(self, n: int, found: list) -> tuple[float, float]:
        """The best segment's -ln E, and the significant segments' score a square root of words."""
        if not found:
            return -math.log1p(math.log(max(n, 1)) + 1.0), 0.0
        best = -math.log(min(f[3] for f in found) + 1e-300)
        # large values count by their logarithm, so that no text is far from all those learned from
        return math.copysign(math.log1p(abs(best)), best), math.log1p(sum(f[2] for f in found if f[3] <= SIGNIFICANT)) / math.sqrt(math.sqrt(max(n, 1)))

    def probability(self, n: int, found: list) -> float:
        z = self.weights[0] + sum(w * (x - c) for w, x, c in zip(self.weights[1:], self.features(n, found), self.centre))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1; by halving. 1 if the scores have none."""
    if not len(scores) or scores.max() <= 0 or share @ scores >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: share @ np.exp(np.minimum(x * scores, 700.0))
    while f(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return max(0.05, min(high, 5.0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the intercept first) by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_texts: int = MAX_TEXTS) -> Model:
    """Learns from rows whose crc32 of doc_id is not ``held`` modulo ``folds``. A null toxic or doc_id is no label; of several
    labels of a document the largest counts. Without both classes the model knows nothing and gives every text the same score."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    chosen = toxic.where(fold_bucket(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_texts)
    sample = settle(text_rows(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text"))  # max_texts ids at most are broadcast

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for ys, texts in batches_as_lists(batches, "toxic", "text"):
            for y, t in zip(ys, texts):
                seen[int(y > 0)].update(set(_terms(list(set(words(t.decode("utf-8", "replace")))))))
        for y, c in seen.items():
            items = list(c.items())
            for i in range(0, len(items), 10_000):
                part = items[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array([n if y else 0 for _, n in part], pa.int64()), pa.array([0 if y else n for _, n in part], pa.int64())], ["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    prefix = F.col("term").endswith("-")
    counted = settle(counted.withColumn("kind", F.when(prefix, F.length("term") - 1).otherwise(0)))
    words_ = counted.where("kind = 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not all(words_):
        return Model({})
    model = Model(sure_terms(counted))

    def scored(batches):
        for terms, clean in batches_as_lists(batches, "term", "clean"):
            total: dict[float, int] = {}
            for t, n in zip(terms, clean):
                total[model.of(t)] = total.get(model.of(t), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.int64())], ["score", "n"])

    # as many scores as the model has terms, at most
    clean = counted.where("kind = 0 and clean > 0").mapInArrow(scored, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").toPandas()
    model.rate = _rate(clean.score.to_numpy(), clean.n.to_numpy(float) / clean.n.sum())

    def measure(batches):
        for ys, texts in batches_as_lists(batches, "toxic", "text"):
            x = [model.features(*model.passages(t.decode("utf-8", "replace"))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in ys], pa.int32()), pa.array([p for p, _ in x], pa.float64()), pa.array([q for _, q in x], pa.float64())], ["y", "best", "mass"])

    # two numbers a text of the bounded sample
    at = sample.mapInArrow(measure, "y int, best double, mass double").toPandas().sort_values(["y", "best", "mass"])
    x = at[["best", "mass"]].to_numpy()
    model.centre = tuple(x.mean(axis=0).tolist())
    model.weights = tuple(_logistic(x - x.mean(axis=0), at.y.to_numpy(float)).tolist())
    return model


def score(docs: DataFrame, model: Model, folds: int = 3, held: int = 1, threshold: float = 0.7, with_passages: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; with ``with_passages`` also every significant passage
    (from word, to word, score, expected number by chance).

    Null and empty texts and texts without words have no segment and get the score of clean text. Texts are never cut. Repeated
    rows give repeated rows; an empty table gives none. Of ``docs`` only doc_id and text are read."""
    rows = text_rows(docs, (fold_bucket(F.col("doc_id"), folds) == held).alias("held_out"))
    kind = pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        for b in batches:
            at = [model.passages(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            p = np.array([model.probability(*x) for x in at], float)
            cols = [b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            if with_passages:
                cols.append(pa.array([[dict(zip(("from_word", "to_word", "score", "expected"), f)) for f in found if f[3] <= SIGNIFICANT] for _, found in at], kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "passages"][: len(cols)])

    extra = ", passages array<struct<from_word: int, to_word: int, score: double, expected: double>>" * with_passages
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + extra)


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
