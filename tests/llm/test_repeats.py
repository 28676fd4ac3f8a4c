import hashlib
import random

import numpy as np

from fleetlens.llm.repeats import LENGTH, blocks, op10_repeats


def brute(rows):
    first, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            first.setdefault(b[p : p + LENGTH], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - LENGTH + 1):
            if i is not None and first[b[p : p + LENGTH]] < i:
                gone[p + 1 : p + 1 + LENGTH] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages, rows = [text(rng.choice([49, 50, 51, 60, 75, 120, 400])) for _ in range(14)], []
    for _ in range(110):
        parts = [text(rng.randrange(0, 200)) for _ in range(4)]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(len(parts)), p if rng.random() < 0.6 else p[rng.randrange(20) : len(p) - rng.randrange(20)])
        rows.append("".join(parts))
    rows += [rows[3], rows[3], rows[5] + "x", "y" + rows[5][:-3], "z" * 49, "z" * 50, "z" * 51, "ab" * 300, "ba" * 200, "x" + rows[9][7:90] + "y", None, "", passages[6] * 3, "é" * 40]
    rng.shuffle(rows)
    return [(7 * k - 50, t) for k, t in enumerate(rows)]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, starts int").repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_repeats(spark, str(tmp_path)).collect()}


def test_against_brute_force(spark, tmp_path):
    rows = corpus(1) + [(None, "q" * 80), (5000, "q" * 80)]
    got, truth = run(spark, tmp_path, rows), brute(rows)
    assert {k: v for k, v in got.items() if v != truth[k]} == {} and len(got) == len(truth)


def test_many_buckets(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        line = "a very common line that many documents share, word for word, again and again"
        rows = corpus(2) + [(10_000 + k, f"{k * 7919} {line} {k * k}") for k in range(150)]
        got, truth = run(spark, tmp_path, rows), brute(rows)
        assert {k: v for k, v in got.items() if v != truth[k]} == {}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_blocks_cover_every_start_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 300, 1000)]
    who, lo, hi = blocks(texts)[:3]
    for k, t in enumerate(texts):
        starts = [p for a, b in zip(lo[who == k], hi[who == k]) for p in range(a, b + 1)]
        assert starts == list(range(max(0, len(t) - LENGTH + 1)))
