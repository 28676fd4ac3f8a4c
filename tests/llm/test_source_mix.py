import math
import re

import pytest

from fleetlens.llm.source_mix import mix, op3_source_mix


def wanted(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by repeated dealing out."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= limit * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, biggest_part=0.5):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] or 0 for r in v) for s, v in by.items()}
    goal = wanted(sizes)
    for s, v in by.items():
        for r in v:
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], goal[s], rel_tol=1e-9, abs_tol=1e-9)
            assert 0 <= r["taken"] <= 2 * (r["size"] or 0) and (not r["size"] or r["taken"] % r["size"] == 0)
            assert r["taken"] >= (r["size"] or 0) * math.floor(goal[s] / sizes[s] + 1e-12) if sizes[s] else True
        assert abs(sum(r["taken"] for r in v) - goal[s]) <= biggest_part * max((r["size"] or 0) for r in v) + 1e-6


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", (i * 37) % 211, "x") for i in range(4000)] + [(None, None, 5, "y"), (7, None, None, None), (7, "", 0, "z"), (9, "tiny", 3, "z"), (9, "tiny", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size int, taken string")
    out = mix(df).collect()
    assert len(out) == len(rows)
    check([r.asDict() for r in out])
    assert sorted(map(str, out)) == sorted(map(str, mix(df.repartition(7)).collect()))


def test_quality_scales_the_keys(spark):
    rows = [(i, "a", 10, 4.0 if i % 2 else 1.0) for i in range(6000)] + [(10_000 + i, "b", 10, 1.0) for i in range(12_000)]
    out = [r for r in mix(spark.createDataFrame(rows, "doc_id long, source string, size int, q double"), quality="q", weights=(1,), share=0.3).collect() if r["source"] == "a"]
    share = [sum(r["taken"] for r in out if r["q"] == q) / sum(r["size"] for r in out if r["q"] == q) for q in (4.0, 1.0)]
    # keys under a bound x: shares 1 - exp(-4 x) and 1 - exp(-x)
    assert share[0] == pytest.approx(1 - (1 - share[1]) ** 4, abs=0.04) and share[0] > 2 * share[1]


def test_query_and_empty_table(spark, tmp_path):
    docs = [(i, None if i == 3 else "w x " * (i % 9) + "\t\n\x1f", f"s{i % 4}" if i % 5 else None) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)] + [(6, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.asDict() for r in op3_source_mix(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for i, text, source in docs:
        assert got[i]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        got[i]["source"] = source
    check(list(got.values()))
    assert mix(spark.createDataFrame([], "doc_id long, source string, size int")).count() == 0
