import random

import numpy as np
import pytest

import fleetlens.llm.jaccard_join as jaccard_join
from fleetlens.llm.common import BATCH, staged
from fleetlens.llm.graph import components
from fleetlens.llm.jaccard_join import Bands, first_of_class, join, op4_jaccard_join, shingles


def sets(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, percent):
    s, root = [sets(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(s[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def corpus(seed, families=25, copies=12):
    rng, out = random.Random(seed), []
    word = lambda: f"{rng.choice('abXYz')}{rng.randrange(3000)}"
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 9, 12, 20, 40, 90, 160, 300]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(0, 1 + len(w) // 12)] if rng.random() < 0.5 else w + [word() for _ in range(len(w) // 15)]
            out.append(rng.choice([" ", "\t", " \n "]).join(w))
    out += [None, "", " \t", "one", "One", "two words", "TWO\x0bwords", "é É", "É É", "a " * 50]
    rng.shuffle(out)
    return list(enumerate(out, start=100))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 70)])
def test_all_links_between_classes(spark, width, percent):
    rows = corpus(width)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, component int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(df, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_blocks_and_the_query(spark, monkeypatch, tmp_path):
    from fleetlens.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "MOST", 5)
    rows = corpus(77, families=4, copies=60)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard_join(spark, str(tmp_path)).collect()} == brute(rows, 3, 90)
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot, most", [(2, 2048), (2, 4), (3, 7)])
def test_groups_of_hot_signatures(hot, most, monkeypatch):
    """Each two sets that share a signature share a group, whatever is dealt out, over batches of any length."""
    import pyarrow as pa

    from fleetlens.llm import jaccard_join as j

    monkeypatch.setattr(j, "HOT", hot)
    monkeypatch.setattr(j, "MOST", most)
    texts = [t for _, t in corpus(5, families=6, copies=30)]
    plain, rows = {}, []
    for part in (texts[::2], texts[1::2]):  # two tasks
        for b in j._signature_rows(iter([pa.record_batch({"t": pa.array(part, pa.string())})]), 3, 80, 3):
            rows += list(zip(*(c.to_pylist() for c in b.columns)))
    for s, _, n in rows:
        plain.setdefault(s, set()).add(n)
    want = {(a, b) for ns in plain.values() for a in ns for b in ns if a < b}
    got = {}
    for task in range(3):
        mine = sorted(r for r in rows if hash((r[0], max(r[1], 0))) % 3 == task)
        batches = [pa.record_batch({"s": [r[0] for r in some], "t": pa.array([r[1] for r in some], pa.int32()), "n": [r[2] for r in some]}) for k in range(0, len(mine), 17) if (some := mine[k : k + 17])]
        for b in j._group_rows(iter(batches)):
            for g, n in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(g, set()).add(n)
    assert {(a, b) for ns in got.values() for a in ns for b in ns if a < b} == want


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words)), (5, " ".join([*words, "more"])), (7, " ".join(words[:-1])), (7, "something else of a few words"), (9, "something else of a few words"), (None, "no copy of this one"), (None, None), (3, "")]
    got = sorted(join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got if r.n_shingles > 20] == [(5, 5), (7, 5), (None, 5)]
    assert [(r.doc_id, r.component_id) for r in got if 0 < r.n_shingles < 20] == [(7, 7), (9, 7), (None, None)]
    assert [(r.doc_id, r.component_id) for r in got if not r.n_shingles] == [(3, 3), (None, None)]
    kept = first_of_class(spark.createDataFrame(rows + rows, "doc_id long, text string"), width=3, percent=90).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("5", " ".join([*words, "more"])), ("7", "something else of a few words"), ("None", "no copy of this one")]
    assert sum(not r.text for r in kept) == 4


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    rng, bands = np.random.default_rng(percent), Bands(percent)
    for _ in range(300):
        n = int(rng.integers(5, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
            signature, owner = bands.signatures([a, b])
            assert set(signature[owner == 0]) & set(signature[owner == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (200, 100), (300, 300), (7, 7), (1000, 999), (999, 1000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 200: 50, 999: 999, 1000: 999}


def test_shingles_match_the_words():
    assert len(shingles("A b C a B c", 3)) == 3 and len(shingles("a b", 3)) == 1 and len(shingles(None, 3)) == 0
    assert list(shingles("A b", 5)) == list(shingles("a\tB", 5)) != list(shingles("a b c", 5))


def test_workers_get_their_rows_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(BATCH)
    wide = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    got = [r["n"] for r in staged(wide.mapInArrow(sizes, "n long"), "sizes", 1 << 20).collect()]
    assert sum(got) == 2000 and max(got) < 300 and spark.conf.get(BATCH) == before

    seen = []
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name, batch=None: (seen.append((name, batch)), staged(df, name, batch))[1])
    join(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "q")], "doc_id long, text string")).collect()
    assert {n for n, b in seen if b} == {"shingle_sets", "groups", "sets", "compared", "partners"}


def test_only_texts_that_are_needed_move(spark, monkeypatch):
    moved, one_each = [], jaccard_join._one_each
    monkeypatch.setattr(jaccard_join, "_one_each", lambda df, *others: (moved.append(df.count()), one_each(df, *others))[1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(200)]
    rows += [(500, rows[7][1] + " more"), (501, rows[8][1]), (502, ""), (503, None)]
    kept = first_of_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == rows[:200] and len(kept) == 202
    assert len(moved) > 1 and max(moved) == 4  # of two classes; 204 or 202 rows before


def test_signatures_come_in_turns(spark, monkeypatch):
    """Each set has all its signatures over the turns, none twice; first_of_class holds half of them at once."""
    import pyarrow as pa

    texts = [t for _, t in corpus(8, families=6)]

    def rows(*turn):
        made = jaccard_join._signature_rows(iter([pa.record_batch({"t": pa.array(texts, pa.string())})]), 3, 80, 1, *turn)
        return [r for b in made for r in zip(*(c.to_pylist() for c in b.columns))]

    turns = [rows(k, 2) for k in range(2)]
    assert sorted(turns[0] + turns[1]) == sorted(rows()) and min(map(len, turns)) > 0.4 * len(rows())
    assert not {r[0] for r in turns[0]} & {r[0] for r in turns[1]}
    seen = []
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name, batch=None: (seen.append(name), staged(df, name, batch))[1])
    given = corpus(9, families=5)
    kept = first_of_class(spark.createDataFrame(given, "doc_id long, text string"), width=5, percent=80).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, (_, least) in brute(given, 5, 80).items() if k == least)
    assert seen.count("groups") == 2


def test_steps_on_small_tables_are_few_and_in_few_tasks(spark, monkeypatch):
    from fleetlens.llm import graph

    sizes = []
    monkeypatch.setattr(graph, "staged", lambda df, name: (out := staged(df, name), sizes.append(len(out.inputFiles())))[0])
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i % 10) for i in range(10, 400)], "a long, b long")
        assert dict(components(edges, "a", "b").collect()) == {i: i % 10 for i in range(400)}
        assert len(sizes) == 2 and sizes[-1] <= 8  # stars are seen to be stars: 10 tables of up to 40 files before
        sizes.clear()
        chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
        assert dict(components(chain, "a", "b").collect()) == {i: 0 for i in range(201)} and max(sizes[1:]) <= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
