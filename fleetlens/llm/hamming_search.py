"""Approximate nearest neighbours by multi-index hashing of learned codes.

Codes: vectors are centred, turned onto their principal axes, spread over `BITS` axes, and turned by a rotation that iterative
quantisation learns on a bounded sample; the signs are `BITS` bits. Index: every code is cut into m substrings, each the
key of a table of its own; a row of the index is (table, key, id, code), without the vector. Probing: if two codes
differ in R bits at most, then by the pigeonhole principle they differ in R // m bits at most in one of the first R % m + 1
substrings, or in R // m - 1 at most in another. A query names all keys so near to its own and meets the index by a join
on (table, key), which retrieves every code within R; of several tables that retrieve one, the first counts. Only then vectors
are fetched, and what was retrieved is ranked by their distance. Which m is taken depends on the rows, the queries and R: the
one with the fewest probes and rows met.

R is the Hamming distance within which `SURE` of the sample's true neighbours lie. Queries that find fewer than k neighbours
are compared with every vector, in blocks, so that nothing is left out.

Vectors that are null, zero, hold a null or a non-finite component, or have another length than most of the sample (no
distance is defined to those) take no part, neither do rows without an id. Rows that repeat an id are one candidate each, but
never the query's own; a query that is repeated with other vectors is its least vector.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import staged, table, unstage

BITS, WORDS, SURE = 256, 4, 0.97
#: Widths of a substring to choose from, and how many keys of one table a query may name.
WIDTHS, PROBES = (8, 16, 32), 20_000
#: What a row of a table or a probe costs to make and to send, in rows met.
MADE = 10
#: Rows of one block where queries are compared with every vector.
ROWS = 4096


class Model(NamedTuple):
    mean: np.ndarray
    rotation: np.ndarray  # (dimensions, BITS)
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """`WORDS` unsigned 64-bit integers for each vector."""
        if not len(x):
            return np.zeros((0, WORDS), np.uint64)
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(">u8").astype(np.uint64)


def usable(vector: str) -> Column:
    v = f"`{vector}`"
    sane = f"forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return F.expr(f"coalesce({v} IS NOT NULL AND {sane} AND exists({v}, x -> x <> 0), false)")


def learn(sample: np.ndarray, k: int = 10, rounds: int = 15, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    mean, dims = sample.mean(axis=0), sample.shape[1]
    axes = np.linalg.svd(sample - mean, full_matrices=False)[2].T
    if dims < BITS:  # more bits than axes: the axes are spread over the bits at random
        axes = axes @ np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][: axes.shape[1]]
    axes = axes[:, :BITS]
    if axes.shape[1] < BITS:
        axes = np.pad(axes, ((0, 0), (0, BITS - axes.shape[1])))
    y = (sample - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    model = Model(mean, axes @ turn, BITS)
    n = min(300, len(sample))
    if len(sample) < 50:
        return model
    codes, radii = model.codes(sample), []
    squares = (sample**2).sum(axis=1)
    for i in range(n):
        d = squares - 2 * sample @ sample[i]
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        radii.append(np.bitwise_count(codes[near] ^ codes[i]).sum(axis=1, dtype=np.int64))
    return model._replace(radius=int(np.quantile(np.concatenate(radii), SURE, method="higher")))


def fit(vectors: DataFrame, id: str, vector: str, most: int = 8000) -> Model | None:
    """Learns from the `most` rows whose ids hash lowest; every row is indexed later."""
    rows = vectors.orderBy(F.xxhash64(id, F.lit(31)), id).limit(most).select(F.col(vector).cast("array<double>")).collect()
    if not rows:
        return None
    length = Counter(len(r[0]) for r in rows).most_common(1)[0][0]
    return learn(np.array([r[0] for r in rows if len(r[0]) == length]))


def substrings(codes: np.ndarray, width: int) -> np.ndarray:
    """The codes' substrings from left to right, one column for each."""
    each = 64 // width
    parts = [(codes[:, w] >> np.uint64(64 - width * (j + 1))) & np.uint64((1 << width) - 1) for w in range(WORDS) for j in range(each)]
    return np.stack(parts, axis=1).astype(np.int64)


def near(radius: int, width: int) -> list[int]:
    """In how many bits the key of each table may differ; below 0, the table isn't needed."""
    m = BITS // width
    return [radius // m - (j > radius % m) for j in range(m)]


def flips(width: int, most: int) -> np.ndarray:
    """All masks of at most that many bits."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)], np.int64)


def plan(rows: int, queries: int, radius: int) -> int:
    """The width of a substring for which rows to make and rows to meet cost least."""
    cost = {}
    for width in WIDTHS:
        probes = [sum(math.comb(width, k) for k in range(r + 1)) for r in near(radius, width)]
        if max(probes) <= PROBES or width == WIDTHS[0]:
            cost[width] = MADE * (queries * sum(probes) + rows * len(probes)) + queries * rows * sum(probes) / 2**width
    return min(cost, key=cost.get)


def _rows(batches: Iterator[pa.RecordBatch], width: int, masks: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, code's words): (table and key in one number, id, words), for each table every key that a mask gives."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            ids, words = part.column(0).to_numpy(), np.stack([part.column(1 + w).to_numpy() for w in range(WORDS)], axis=1)
            keys, names, owner = substrings(words.view(np.uint64), width), [], []
            for j, mask in enumerate(masks):
                if mask is not None:
                    names.append(((keys[:, j, None] ^ mask[None]) + (j << 32)).ravel())
                    owner.append(np.repeat(np.arange(len(ids)), len(mask)))
            owner = np.concatenate(owner)
            columns = {"name": np.concatenate(names), "id": ids[owner]} | {f"c{w}": np.ascontiguousarray(words[owner, w]) for w in range(WORDS)}
            yield pa.record_batch(columns)


def retrieve(index: DataFrame, queries: DataFrame, radius: int, width: int) -> DataFrame:
    """(q, i), once each: the ids of the queries and of the rows of the index (i, c0, ...) whose codes differ in radius bits at most."""
    least = near(radius, width)
    words = [f"c{w}" for w in range(WORDS)]
    kind = "name long, id long, " + ", ".join(f"{w} long" for w in words)
    one = [np.zeros(1, np.int64) if r >= 0 else None for r in least]
    many = [flips(width, r) if r >= 0 else None for r in least]
    held = index.select("i", *words).mapInArrow(lambda b: _rows(b, width, one), kind)
    asked = queries.select("i", *words).mapInArrow(lambda b: _rows(b, width, many), kind).select("name", F.col("id").alias("q"), *[F.col(w).alias(f"q{w}") for w in words])
    differ = [f"({w} ^ q{w})" for w in words]
    # the first table whose keys are so near is the one that counts
    first, each = [], 64 // width
    for j, r in enumerate(least):
        if r >= 0:
            key = f"(shiftrightunsigned({differ[j // each]}, {64 - width * (j % each + 1)}) & {(1 << width) - 1}L)"
            first.append(f"WHEN bit_count({key}) <= {r} THEN {j}L")
    # what the steps in Python give isn't known to the planner, which would take it for small
    met = held.join(asked.hint("merge"), "name").filter(F.expr(" + ".join(f"bit_count({d})" for d in differ) + f" <= {radius}"))
    return met.filter(F.expr(f"shiftright(name, 32) = CASE {' '.join(first)} END")).filter("id <> q").select("q", F.col("id").alias("i"))


def _every(rows: DataFrame, asked: DataFrame, total: int, k: int) -> DataFrame:
    """(query_id, id, score): the best of each block of rows, all queries against all rows."""
    blocks = max(1, -(-total // ROWS))

    def block(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(queries):
            x, ids = np.stack(index["v"].to_numpy()), index["i"].to_numpy()
            for q, v in zip(queries["q"], queries["w"], strict=True):
                others = np.flatnonzero(ids != q)
                d = np.sqrt(((x[others] - v) ** 2).sum(axis=1))
                first = np.lexsort((ids[others], d))[:k]
                found.append(pd.DataFrame({"query_id": q, "id": ids[others][first], "score": d[first]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    index = rows.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("long").alias("b"))
    dealt = asked.select(F.col("i").alias("q"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("d"))
    return index.groupBy("b").cogroup(dealt.groupBy("d")).applyInPandas(block, "query_id long, id long, score double")


def search(vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, <id>, score) of each query row's k nearest others. queries: a condition on the rows."""
    rows = vectors.filter(usable(vector) & F.col(id).isNotNull()).select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    model = fit(rows, "i", "v")
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id)
    if model is None:
        return empty
    dims = len(model.mean)
    sent = vectors.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tuple(model)))  # dimensions x BITS numbers
    words = [f"c{w}" for w in range(WORDS)]

    @F.pandas_udf(", ".join(f"{w} long" for w in words))
    def code(batch: pd.Series) -> pd.DataFrame:
        found = Model(*sent.value[1]).codes(np.stack(batch.to_numpy())) if len(batch) else np.zeros((0, WORDS), np.uint64)
        return pd.DataFrame(found.view(np.int64), columns=words)

    rows = staged(rows.filter(F.size("v") == dims).withColumn("c", code("v")).select("i", "v", "q", "c.*"), "codes")
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    if not asked:
        return empty

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((np.stack(a.to_numpy()) - np.stack(b.to_numpy())) ** 2).sum(axis=1)) if len(a) else [], dtype=float)

    def best(scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    questions = rows.filter("q").groupBy("i").agg(F.min(F.struct("v", *words)).alias("x")).select("i", "x.*")
    pairs = retrieve(rows, questions, model.radius, plan(total, asked, model.radius))
    both = pairs.join(rows.select("i", "v"), "i").join(questions.select(F.col("i").alias("q"), F.col("v").alias("w")), "q")
    found = staged(best(both.select(F.col("q").alias("query_id"), F.col("i").alias("id"), distance("v", "w").alias("score"))), "neighbours")
    short = questions.join(found.filter(F.col("rank") == min(k, total - 1)).select("query_id"), F.col("i") == F.col("query_id"), "left_anti")
    if not short.isEmpty():
        again = best(_every(rows, short, total, k))
        return found.join(short.select("i"), F.col("query_id") == F.col("i"), "left_anti").unionByName(again).select("query_id", "rank", F.col("id").alias(id), "score")
    unstage(rows)
    return found.select("query_id", "rank", F.col("id").alias(id), "score")


def op8_hamming_search(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100; recall 0.9 or more against brute force (README has figures)."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
