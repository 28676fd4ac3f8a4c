import random
import struct
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline
from fleetlens.llm import toxicity
from fleetlens.llm.common import BATCH, BATCH_BYTES
from fleetlens.llm.secret_scan import find
from tests.llm.test_jaccard_join import brute
from tests.llm.test_source_mix import check


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(12), []
    word = lambda: f"{rng.choice('abcde')}{rng.randrange(2000)}"
    toxic = set()
    for i in range(700):
        words = [word() for _ in range(rng.randrange(30, 150))]
        if rng.random() < 0.12:
            toxic.add(i)
            words += [f"grubk{rng.choice('xyz')}" for _ in range(4)]
        rows.append([i, " ".join(words), "en", f"s{i % 4}"])
    for i in range(700, 760):
        rows.append([i, rows[(i * 7) % 300][1] + (" tail" if i % 2 else ""), "fr", "s9"])
    rows[3][1] += " token = 0123456789abcdef0123456789"
    rows += [[800, None, None, None], [801, "", "en", None], [802, "short", None, None], [802, "short", None, None]]
    toxic |= {i for i in range(700, 760) if (i * 7) % 300 in toxic}
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i in toxic)) for i in range(0, 700, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows, toxic


def test_each_stage(spark, folder, tmp_path):
    where, rows, toxic = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        out = stage(spark, docs, where)
        if name != "encode":
            assert out.columns == pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r) for r in docs.collect()]
        if name == "toxicity":
            gone = {r[0] for r in rows} - {i for i, _ in kept[name]}
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.02 * len(rows)
        elif name == "near_duplicates":
            given = sorted({(r.doc_id, r.text) for r in before.collect()}, key=lambda x: x[0])
            classes = brute(given, 5, 80)
            assert sorted(i for i, _ in kept[name]) == sorted(i for i, t in given if classes[i][1] == i)
        elif name == "secrets":
            assert sorted(i for i, _ in kept[name]) == sorted(i for i, _ in kept["near_duplicates"])
            assert not any(find(r.text) for _, r in kept[name])
            assert {i: r.text for i, r in kept[name] if i != 3} == {i: r.text for i, r in kept["near_duplicates"] if i != 3}
        elif name == "mix":
            times = {}
            for i, r in kept[name]:
                times[i] = times.get(i, 0) + 1
            given = [r for _, r in kept["secrets"]]
            sizes = {r.doc_id: len((r.text or "").split()) for r in given}
            assert max(times.values()) <= 2
            by = {}
            for r in given:
                by[r.source] = by.get(r.source, 0) + sizes[r.doc_id]
            from tests.llm.test_source_mix import wanted

            goal = wanted(by)
            checked = [{"source": r.source, "size": sizes[r.doc_id], "taken": sizes[r.doc_id] * times.get(r.doc_id, 0), "source_size": by[r.source], "target": goal[r.source]} for r in given]
            check(checked)
        else:
            import base64

            import public_tokenizers as P
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
            known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {i: r.text for i, r in kept["mix"]}
            assert len(kept[name]) == len(kept["mix"])
            assert all(struct.unpack(f"<{r.n_tokens}I", r.ids) == tuple(known.encode_ordinary(texts[i])) for i, r in kept[name])


def test_run_gives_the_stages_rows(spark, folder):
    where = folder[0]
    assert sorted(map(str, pipeline.run(spark, where).collect())) == sorted(map(str, pipeline.run(spark, where).collect())) != []


def test_stages_hand_out_small_batches(spark, folder):
    before = spark.conf.get(BATCH)
    try:
        for given, wanted in (("64m", BATCH_BYTES), (str(1 << 30), BATCH_BYTES), (str(1 << 16), 1 << 16)):
            for _, stage in pipeline.STAGES:
                spark.conf.set(BATCH, given)
                try:
                    stage(spark, None, folder)
                except AttributeError:  # no documents
                    pass
                assert int(spark.conf.get(BATCH).rstrip("b")) == wanted
    finally:
        spark.conf.set(BATCH, before)


def test_scores_are_remembered_once(monkeypatch):
    memory = toxicity.Memory(np.ones(toxicity.DIMENSIONS))
    held = toxicity._short.cache_info().currsize
    assert all(memory[f"word{i}"] > 0 for i in range(100))
    assert len(memory) == 100 and toxicity._short.cache_info().currsize == held


def test_only_labelled_texts_meet_the_labels(spark, tmp_path, monkeypatch):
    from corpus_pipeline import mix_sources, source_mix

    met, with_quality = [], source_mix.with_quality
    monkeypatch.setattr(source_mix, "with_quality", lambda df, labels: (met.append([r.doc_id for r in df.collect()]), with_quality(df, labels))[1])
    spark.createDataFrame([(3, 1, 0), (999, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"some words {i}", "en", "ab"[i % 2], 12) for i in range(50)] + [(None, "no id", "en", "a", 5)]
    out = mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()
    assert out and met == [[3]]  # all 51 before
