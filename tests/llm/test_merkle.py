import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm.merkle import fold, manifest, op13_merkle_manifest, proof_digest, row_digest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes, arity):
    """The root, and each node's path of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i - i % arity
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + arity])))
            at[leaf] = i // arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], digest(r)))
    roots = {}
    for g, leaves in groups.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        roots[g] = grow([d for _, d in leaves], arity)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, over = grow([roots[g][0] for g in names], arity)
    return sorted((str(k), d, roots[g][0], root, p + over[i]) for i, g in enumerate(names) for (k, d), p in zip(groups[g], roots[g][1]))


def table(n):
    langs = ["en"] * 5 + ["de", None, "é", "z"]
    rows = [(7 * i % n if i % 9 else None, f"s{i % 3}" if i % 4 else None, langs[i % 9] if i != 3 else "lone", i if i % 5 else None, "ü" * (i % 6) if i % 7 else None) for i in range(n)]
    return [*rows, rows[4], rows[4], rows[9]] if n > 9 else rows


@pytest.mark.parametrize("n, arity, levels", [(0, 2, 10), (1, 2, 1), (2, 2, 3), (70, 2, 2), (70, 3, 2), (257, 2, 10), (150, 5, 1)])
def test_trees_and_paths(spark, n, arity, levels):
    rows = table(n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({"leaf": F.lit("mine"), "_g": F.lit(1)})
    got = manifest(df, row_digest([F.col(c) for c in COLUMNS]), "doc_id", "lang", arity=arity, levels=levels)
    got = got.withColumn("again", fold(F.col("leaf"), F.col("path"))).withColumn("proof", proof_digest(F.col("path"))).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got) == (brute(rows, arity) if rows else [])
    assert all(r.again == r.root and r.proof == h(*[a + b for a, b in r.path]) for r in got)


def test_the_query_finds_what_was_changed(spark, tmp_path):
    rows = table(60)
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_merkle_manifest(spark, str(tmp_path)).collect()
    held = {digest(r): r for r in rows}
    bad = 0
    for r in got:
        row = held[r.leaf]
        changed = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        assert r.verified != changed and (r.folded_root == r.root) == r.verified
        bad += changed
    assert bad and len(got) == len(rows)
