"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over a text's distinct words, each as a whole and by its first 4 and 5 letters; a run longer than
`LONG` characters also by what 4 and 5 characters stand in it, and a run in a script without spaces by its single characters,
pairs and triples. All are hashed into `DIMENSIONS` weights that only count towards toxicity, so that a long text doesn't outweigh what it holds. It is trained in numpy on two
bounded samples: confirmed toxic texts (P) and texts drawn from all training rows whatever their label (U). With class
prior p and the logistic loss l, it lowers

    p * E_P[l(z)] + max(0, E_U[l(-z)] - p * E_P[l(-z)])

by AdaGrad with an L1 step; where the second part falls below 0, the step goes against it, as in the non-negative
estimator. The class prior is the share of toxic rows among the labelled training rows; the decision is set where as large
a share of U counts as toxic.

Null and empty texts have no words and get the bias alone. Rows that repeat an id or contradicting labels: a document is
toxic if any of its labels says so. Without a single confirmed toxic text, every score is below 1e-9.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import table

DIMENSIONS, LONG = 1 << 20, 16
_word = re.compile(r"\w+")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_unsegmented = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_REMEMBERED = 100_000


def features(word: str) -> tuple[int, ...]:
    return _short(word) if len(word) <= LONG else _features(word)


def _features(word: str) -> tuple[int, ...]:
    forms = {word[:n] for n in (4, 5) if len(word) >= n} | {f"={word}"}
    lengths = (1, 2, 3) if _unsegmented.search(word) else (4, 5) if len(word) > LONG else ()
    forms |= {f"~{word[i : i + n]}" for n in lengths for i in range(len(word) - n + 1)}
    return tuple(zlib.crc32(f.encode()) % DIMENSIONS for f in sorted(forms))


_short = lru_cache(maxsize=_REMEMBERED)(_features)


def distinct_words(text: str | None) -> set[str]:
    return set(_word.findall(text.lower())) if text else set()


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 12, polish: int = 8, batch: int = 256, rate: float = 0.3, l1: float = 1e-2, seed: int = 11) -> Model:
    """positive, unlabelled: the features of each text. In the last `polish` passes the weights that the L1 steps left at 0
    stay there, and the others are no longer drawn to it."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if not positive or not unlabelled:
        return Model(weights, -np.inf)
    prior = min(max(prior, 1e-4), 0.999)
    squares, bias_square = np.full(DIMENSIONS, 1e-8), 1e-8
    rng, steps = np.random.default_rng(seed), max(1, len(unlabelled) // batch)

    def margins(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        ids = np.concatenate(texts) if sizes.sum() else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(texts)), sizes)
        return np.bincount(rows, weights[ids], len(texts)) + bias, ids, rows

    chosen = np.ones(DIMENSIONS, bool)
    for epoch in range(epochs + polish):
        if epoch == epochs:
            chosen, l1 = weights != 0, 0.0
        order = rng.permutation(len(unlabelled))
        for s in range(steps):
            u = [unlabelled[i] for i in order[s * batch : (s + 1) * batch]]
            p = [positive[i] for i in rng.integers(0, len(positive), batch // 2)]
            zp, ip, rp = margins(p)
            zu, iu, ru = margins(u)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            du, dp_negative = su / len(u), -prior * sp / len(p)  # of the estimated risk on negatives
            dp_positive = -prior * (1 - sp) / len(p)
            if negative >= 0:
                dp = dp_positive + dp_negative
            else:
                dp, du = -dp_negative, -du
            slope = np.bincount(np.concatenate([ip, iu]), np.concatenate([dp[rp], du[ru]]), DIMENSIONS) * chosen
            squares += slope**2
            step = rate / np.sqrt(squares)
            weights -= step * slope
            weights = np.maximum(weights - step * l1, 0)
            b = dp.sum() + du.sum()
            bias_square += b * b
            bias -= rate / np.sqrt(bias_square) * b
    # The decision is set where the share of positives among U is the class prior; equal margins stay on the negative side.
    found = np.sort(margins(unlabelled)[0] - bias)[::-1]
    k = min(max(1, round(prior * len(found))), len(found) - 1) if len(found) > 1 else 0
    above, below = found[:k][found[:k] > found[k] + 1e-9], found[k]
    return Model(weights, -float((above[-1] + below) / 2 if len(above) else below + 1.0))


def fit(docs: DataFrame, labels: DataFrame, training: Column, max_positive: int = 4000, max_unlabelled: int = 8000) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic). training: a condition on doc_id. The samples are the rows whose ids
    hash lowest, so they are random but the same again; max_positive and max_unlabelled bound what the driver gets."""
    rows = labels.filter(training & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = rows.agg(F.avg("toxic")).first()[0] or 0.0
    first = F.xxhash64("doc_id", F.lit(23))
    present = docs.select("doc_id").filter(training)
    p = rows.filter("toxic = 1").join(present.distinct(), "doc_id").orderBy(first, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("_p"))
    u = present.orderBy(first, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("_p"))

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([f for w in sorted(distinct_words(t)) for f in features(w)], np.int32).tobytes() for t in texts], dtype=object)

    # at most max_positive + max_unlabelled ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(p.unionByName(u)), "doc_id").select("doc_id", "_p", ids("text").alias("ids"))
    got = sorted(((r["doc_id"], r["_p"], bytes(r["ids"])) for r in chosen.collect()))
    return train(*[[np.frombuffer(b, np.int32) for _, kind, b in got if kind == k] for k in (True, False)], prior)


class Memory(dict):
    """From a word to its part of the margin."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = float(sum(self.weights[f] for f in _features(word)))  # not remembered there as well
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = value
        return value


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out` double, 0 to 1; a column of that name is replaced."""
    kept = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, kept, model.weights[kept], model.bias))  # fixed size: DIMENSIONS weights at most

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        memory, bias = _memory(sent)
        return pd.Series([1 / (1 + np.exp(-np.clip(bias + sum(map(memory.__getitem__, distinct_words(t))), -500, 500))) for t in texts], dtype=float)

    return docs.withColumn(out, scores(F.col(f"`{text}`")))


_memories: dict[str, tuple[Memory, float]] = {}


def _memory(sent) -> tuple[Memory, float]:
    name, kept, values, bias = sent.value
    if name not in _memories:
        weights = np.zeros(DIMENSIONS)
        weights[kept] = values
        _memories.clear()
        _memories[name] = Memory(weights), bias
    return _memories[name]


def remainder(column: str, of: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % of


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; trained without the rows of crc32(doc_id) mod 5 = 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
