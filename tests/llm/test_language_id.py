import random
import zlib

import numpy as np

from fleetlens.llm.language_id import WIDTHS, WINDOW, Tables, fit, op7_language_id, predict, train, windows
from fleetlens.llm.toxicity import remainder

SOUNDS = {"aa": ["tion", "the", "ing", "er", "wh"], "bb": ["eau", "é", "ment", "le", "qu"], "cc": ["sch", "ung", "ü", "ei", "tz"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, text(rng, lang := rng.choice(list(SOUNDS)), rng.randrange(4, 300)), lang) for i in range(900)]
    odd = [(2000, None, "aa"), (2001, "", "bb"), (2002, "12 .. 34", "aa"), (2003, text(rng, "cc", 9000), None), (None, text(rng, "bb", 30), None), (5, rows[5][1], rows[5][2])]
    spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    test = [by[i].lang_pred == lang for i, _, lang in rows if by[i].held_out]
    assert np.mean(test) > 0.97
    assert [by[i].lang_pred for i in (2000, 2001, 2002, 2003, None)] == ["und", "und", "und", "cc", "bb"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None, 3.5)], "doc_id long, text string, lang string, score double")
    assert [(r.lang_pred, r.score) for r in predict(docs, fit(docs, remainder("doc_id", 3) >= 0)).collect()] == [("und", 0.0)]
    assert predict(docs.limit(0), fit(docs.limit(0), remainder("doc_id", 3) >= 0)).count() == 0


def test_tables_give_the_networks_probabilities():
    rng = np.random.default_rng(1)
    x = np.concatenate([windows(bytes(rng.integers(0, 256, 700).astype(np.uint8))), windows(b"short")]).astype(np.int64)
    model = train(x, np.arange(len(x)) % 2, ["a", "b"], epochs=2)
    e = model.embedding[x]
    pooled = [np.max([[sum(e[n, p + j] @ f[j] for j in range(w)) for p in range(WINDOW - w + 1)] for n in range(len(x))], axis=1) + b for w, f, b in zip(WIDTHS, model.filters, model.biases, strict=True)]
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.dense + model.dense_bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(Tables(model).probabilities(x.astype(np.int32)), p, atol=1e-4)
