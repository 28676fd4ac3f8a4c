"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes (the last one padded); every window of the whole text is
classified, and the text's probabilities are the mean over its windows. The network looks each byte up in an embedding, runs
filters of several widths over it, takes each filter's maximum over the window, and applies a softmax layer. It is trained
in numpy by Adam on windows of a bounded, even sample of labelled texts. For prediction a filter's response at a
place is a sum of table entries, one for each pair of bytes it covers, so that no multiplication is left.

`und` is predicted, with score 0, where the text is null or has no letter, and everywhere if nothing was learned.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import table
from fleetlens.llm.toxicity import remainder

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # (257, EMBEDDING); 256 is padding
    filters: list[np.ndarray]  # for each width: (width, EMBEDDING, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray  # (FILTERS * len(WIDTHS), languages)
    dense_bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    out = np.full(n * WINDOW, 256, np.int32)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Model:
    """x: windows of byte numbers, y: language numbers."""
    rng = np.random.default_rng(seed)
    shapes = [(257, EMBEDDING), *[(w, EMBEDDING, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS), len(languages)), (len(languages),)]
    weights = [rng.normal(0, 0.5 if k == 0 else 0.3, s) if len(s) > 1 else np.zeros(s) for k, s in enumerate(shapes)]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    widths, step = len(WIDTHS), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            rows = order[s : s + batch]
            b, target = x[rows], y[rows]
            n = np.arange(len(b))
            e = weights[0][b]
            pooled, places = [], []
            for k, w in enumerate(WIDTHS):
                response = sum(e[:, j : WINDOW - w + 1 + j] @ weights[1 + k][j] for j in range(w))
                at = response.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(response, at[:, None], 1)[:, 0] + weights[1 + widths + k])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            dz = _softmax(hidden @ weights[-2] + weights[-1])
            dz[n, target] -= 1
            dz /= len(b)
            slopes = [np.zeros(shape) for shape in shapes]
            slopes[-2], slopes[-1] = hidden.T @ dz, dz.sum(axis=0)
            back = (dz @ weights[-2].T) * (raw > 0)
            for k, w in enumerate(WIDTHS):
                d = back[:, k * FILTERS : (k + 1) * FILTERS]
                slopes[1 + widths + k] = d.sum(axis=0)
                for j in range(w):
                    bytes_at = b[n[:, None], places[k] + j]
                    slopes[1 + k][j] = np.einsum("nfe,nf->ef", weights[0][bytes_at], d)
                    np.add.at(slopes[0], bytes_at, d[:, :, None] * weights[1 + k][j].T[None])
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, weights[0], weights[1 : 1 + widths], weights[1 + widths : 1 + 2 * widths], weights[-2], weights[-1])


class Tables:
    """The model as sums of table entries: a pair table for each two bytes of a filter, a single one for an odd byte."""

    def __init__(self, model: Model) -> None:
        self.model = model
        single = [[(model.embedding @ f[j]).astype(np.float32) for j in range(len(f))] for f in model.filters]
        self.pairs = [[(s[j][:, None] + s[j + 1][None]).reshape(-1, FILTERS) for j in range(0, len(s) - 1, 2)] for s in single]
        self.odd = [s[-1] if len(s) % 2 else None for s in single]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled, pair = [], x[:, :-1] * 257 + x[:, 1:]
        for k, w in enumerate(WIDTHS):
            places = WINDOW - w + 1
            response = np.take(self.pairs[k][0], pair[:, :places], axis=0)
            for i, more in enumerate(self.pairs[k][1:], 1):
                response += np.take(more, pair[:, 2 * i : 2 * i + places], axis=0)
            if self.odd[k] is not None:
                response += np.take(self.odd[k], x[:, w - 1 : w - 1 + places], axis=0)
            pooled.append(response.max(axis=1) + self.model.biases[k])
        return _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.model.dense + self.model.dense_bias)

    def predict(self, texts: list[str | None], block: int = 256) -> tuple[list[str], list[float]]:
        """Windows go through the network in blocks of a fixed size, whatever the length of the texts."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return names, scores
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        total, count = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        held, owners, size = [], [], 0

        def run() -> None:
            x, who = np.concatenate(held), np.concatenate(owners)
            for s in range(0, len(x), block):
                np.add.at(total, who[s : s + block], self.probabilities(x[s : s + block]))
            np.add.at(count, who, 1)

        for i in known:
            x = windows(texts[i].encode())
            held.append(x)
            owners.append(np.full(len(x), i))
            size += len(x)
            if size >= 4096 or i == known[-1]:
                run()
                held, owners, size = [], [], 0
        for i in known:
            p = total[i] / count[i]
            names[i], scores[i] = self.model.languages[int(p.argmax())], float(min(1.0, p.max()))
        return names, scores


def fit(docs: DataFrame, training: Column, text: str = "text", language: str = "lang", id: str = "doc_id", texts_per_language: int = 800, windows_per_text: int = 6) -> Model:
    """Learns from the `texts_per_language` texts of each language whose ids hash lowest, at most `windows_per_text` windows,
    evenly spaced, of each: a bounded sample. Languages are those that the training rows name."""
    rows = docs.filter(training & F.col(language).isNotNull() & F.expr(f"length(`{text}`) > 0"))
    languages = sorted(r[0] for r in rows.select(language).distinct().collect())
    if not languages:
        return Model([], np.zeros((257, EMBEDDING)), [np.zeros((w, EMBEDDING, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS)] * len(WIDTHS), np.zeros((FILTERS * len(WIDTHS), 0)), np.zeros(0))

    @F.pandas_udf("binary")
    def some(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = windows(t.encode())
            out.append(w[np.unique(np.linspace(0, len(w) - 1, windows_per_text).astype(int))].astype(np.int16).tobytes())
        return pd.Series(out, dtype=object)

    order = [F.xxhash64(id, F.lit(29)), F.col(id)]
    ids = None
    for name in languages:
        part = rows.filter(F.col(language) == name).select(id).orderBy(*order).limit(texts_per_language)
        ids = part if ids is None else ids.unionByName(part)
    # at most texts_per_language ids of each language
    sample = rows.join(F.broadcast(ids.distinct()), id).select(language, id, some(text).alias("w"))
    got = sorted((r[0], r[1], bytes(r[2])) for r in sample.collect())
    x = [np.frombuffer(w, np.int16).astype(np.int64).reshape(-1, WINDOW) for *_, w in got]
    y = np.repeat([languages.index(g[0]) for g in got], [len(w) for w in x])
    return train(np.concatenate(x), y, languages)


_tables: dict[str, Tables] = {}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (the mean probability); columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tuple(model)))  # of fixed size for each language

    @F.pandas_udf("lang string, score double")
    def languages(texts: pd.Series) -> pd.DataFrame:
        name, parts = sent.value
        if name not in _tables:
            _tables.clear()
            _tables[name] = Tables(Model(*parts))
        names, scores = _tables[name].predict(list(texts))
        return pd.DataFrame({"lang": names, "score": scores})

    found = docs.withColumn("_found_", languages(F.col(f"`{text}`")))
    return found.withColumn("lang_pred", F.col("_found_.lang")).withColumn("score", F.col("_found_.score")).drop("_found_")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; trained without the rows of crc32(doc_id) mod 3 = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, remainder("doc_id", 3) != 1)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
