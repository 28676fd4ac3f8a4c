import random
import zlib

import numpy as np

from fleetlens.llm.toxicity import fit, op6_toxicity, remainder, score, train


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic = rng.random() < 0.12
        words = [f"{rng.choice(['ba', 'ke', 'lo', 'mi'])}{rng.randrange(900)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grubk", "snorv", "Blech"]) + rng.choice("abcdef") * rng.randrange(1, 4))
        rows.append((i, " ".join(words), int(toxic), rng.random() < 0.5))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(3000)
    spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "abc", "x"), (7, rows[7][1], "x")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y, known in rows if known] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 3004
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    test = [(by[i].predicted, y) for i, _, y, _ in rows if by[i].held_out]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert sum(p for p, y in test if y) / sum(y for _, y in test) > 0.9
    assert by[5000].score == by[5001].score < 0.5


def test_no_positive_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", 0.3), (2, None, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in score(docs, fit(docs, labels, remainder("doc_id", 5) >= 0)).collect())
    none = docs.limit(0)
    assert score(none, fit(none, labels.limit(0), remainder("doc_id", 5) >= 0)).count() == 0


def test_risk_correction_finds_the_positives_among_the_unlabelled():
    rng = np.random.default_rng(2)
    draw = lambda toxic: np.concatenate([rng.integers(1000, 3000, 30), rng.integers(0, 20, 3) if toxic else np.zeros(0, int)]).astype(np.int64)
    model = train([draw(True) for _ in range(300)], [draw(k % 10 == 0) for k in range(2000)], 0.1)
    margin = lambda x: model.weights[x].sum() + model.bias
    assert np.mean([margin(draw(True)) > 0 for _ in range(300)]) > 0.9 and np.mean([margin(draw(False)) < 0 for _ in range(300)]) > 0.97


def held_out(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels, remainder("doc_id", 5) != 0)
    got = {r.doc_id: r.score >= 0.5 for r in score(docs, model).filter(remainder("doc_id", 5) == 0).collect()}
    pairs = [(got[i], y) for i, _, y in rows if i in got]
    return sum(p == y for p, y in pairs) / len(pairs), sum(p for p, y in pairs if y) / sum(y for _, y in pairs)


def test_held_out_short_words_and_scripts_without_spaces(spark):
    rng, short, runs = random.Random(4), [], []
    for i in range(2000):
        toxic = rng.random() < 0.12
        words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice(["", "l", "m", "n"]) for _ in range(rng.randrange(20, 60))]
        clauses = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(8, 20))) for _ in range(5)]
        if toxic:
            words += rng.sample(["ass", "die", "kys"], 2)
            clauses[rng.randrange(5)] += rng.choice(["\u9f98\u9f99\u9f9a", "\u9f9b\u9f9c"]) + chr(0x4E00 + rng.randrange(3000))
        short.append((i, " ".join(words), int(toxic)))
        runs.append((i, "\u3002".join(clauses), int(toxic)))
    for rows in (short, runs):
        accuracy, recall = held_out(spark, rows)
        assert accuracy > 0.95 and recall > 0.9
