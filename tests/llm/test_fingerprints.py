import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from fleetlens.llm.fingerprints import fingerprints, likeness, op1_fingerprints, samples


def terms(text, n=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_collision_rate_is_the_weighted_similarity(spark):
    rng, pairs = random.Random(3), []
    for k in range(400):
        shared, line = prose(rng, 30 + 5 * (k % 60)), prose(rng, 12)
        a = " ".join([shared, prose(rng, 10 + k % 90), *[line] * (k % 7)])
        b = " ".join([shared, prose(rng, 5 + k % 50), *[line] * (k % 4 * 3)])
        pairs.append((k, a, b, jaccard(a, b)))
    df = spark.createDataFrame(pairs, "k int, a string, b string, j double").withColumns({"x": samples("a"), "y": samples("b")})
    errors = [r.e for r in df.select((likeness("x", "y") - F.col("j")).alias("e")).collect()]
    assert abs(sum(errors) / len(errors)) < 0.012
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.06


def test_query(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i * i - 7, prose(rng, rng.randrange(1, 300))) for i in range(60)]
    docs += [(5000, None), (5001, ""), (5002, "one two"), (5003, docs[4][1]), (5004, docs[4][1]), (5005, "🙂 é " * 40 + "\t\n"), (None, "null id"), (9000, prose(rng, 9000)), (9001, "same " * 500)]
    rng.shuffle(docs)
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, next_text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - (jaccard(text, edited) if text or edited else 1)) < 0.25
        assert abs(got[i].near_next - (jaccard(text, after) if text or after else 1)) < 0.25
    assert got[5003].fingerprint == got[5004].fingerprint == got[docs[[d[0] for d in docs].index(9)][0]].fingerprint
    assert got[5000].fingerprint == got[5001].fingerprint == ""


def test_empty_and_clashing_columns(spark):
    assert fingerprints(spark.createDataFrame([], "text string")).count() == 0
    one = spark.createDataFrame([("a b", "old", 1)], "text string, fingerprint string, x int")
    assert len(fingerprints(one).first().fingerprint) == 6 * 128
