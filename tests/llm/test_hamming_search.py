import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.hamming_search import BITS, WORDS, fit, near, op8_hamming_search, plan, retrieve, search, substrings


def brute(rows, every, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    return {q: sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in good if i != q)[:k] for q, v in good if q % every == 0}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_recall_and_scores(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 4000)] * 0.6 + rng.normal(size=(4000, 64))).astype(np.float32)
    x[50:80] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None), (10_001, [0.0] * 64), (10_002, [float("nan")] * 64), (10_003, [None] * 64), (10_100, [math.inf] * 64), (None, x[0].tolist())]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, truth = answers(op8_hamming_search(spark, str(tmp_path))), brute(rows, 100)
    assert set(got) == set(truth)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        assert all(math.isclose(s, math.dist(vectors[q], vectors[i]), rel_tol=1e-12, abs_tol=1e-12) for s, i in found)


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(search(df, F.col("vec_id") % 2 == 0)) == brute(rows, 2)
    assert search(df.limit(0), F.lit(True)).count() == 0 and search(df.limit(1), F.lit(True)).count() == 0
    assert search(df, F.lit(False)).count() == 0


def code_rows(spark, codes):
    words = codes.view(np.int64).tolist()
    return spark.createDataFrame([(i, *w) for i, w in enumerate(words)], "i long, c0 long, c1 long, c2 long, c3 long")


@pytest.mark.parametrize("radius, width", [(3, 32), (17, 16), (31, 16), (40, 8), (70, 8), (5, 8)])
def test_probing_retrieves_every_code_within_the_radius(spark, radius, width):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 2**63, (400, WORDS)).astype(np.uint64) * np.uint64(2)
    for i in range(10, 400):  # at all distances from the first ten
        codes[i] = codes[i % 10]
        for b in rng.permutation(BITS)[: i // 5]:
            codes[i, b // 64] ^= np.uint64(1 << int(b % 64))
    got = [(r.q, r.i) for r in retrieve(code_rows(spark, codes), code_rows(spark, codes[:10]), radius, width).collect()]
    differ = np.bitwise_count(codes[:10, None] ^ codes[None]).sum(axis=2)
    assert len(got) == len(set(got)) and set(got) == {(q, i) for q, i in zip(*map(lambda x: x.tolist(), np.nonzero(differ <= radius))) if q != i}


def test_few_rows_of_a_clustered_table_are_probed(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(600, 64)), 12, axis=0) + 0.1 * rng.normal(size=(7200, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    model = fit(df, "i", "v")
    width = plan(len(x), 72, model.radius)
    codes = model.codes(x)
    keys = substrings(codes, width)
    probed = []
    for q in range(0, 7200, 100):
        close = np.bitwise_count(keys ^ keys[q]) <= np.array(near(model.radius, width))
        probed.append(close.any(axis=1).mean())
    assert np.mean(probed) < 0.05
    got, truth = answers(search(df.toDF("vec_id", "embedding"), F.col("vec_id") % 100 == 0)), brute(list(enumerate(x)), 100)
    assert sum(len({i for _, i in got[q]} & {i for _, i in truth[q]}) for q in truth) >= 0.9 * sum(map(len, truth.values()))
