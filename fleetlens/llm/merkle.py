"""Merkle manifest of a dataset: a digest for each row, a tree over each group's digests, and a tree over the groups' roots.

Rows get their place in their group by range partitions that are sorted once: place = rows before the partition + place in it, so
no task holds a group. A round then deals the nodes out in aligned blocks of arity ** levels of one group, and climbs all levels of a
block by windows in it: at level l every (arity ** l)-th row stands for a node, its siblings are that many rows before and
after it (lag and lead at fixed offsets, masked by the node's slot in its run and by the run's length), and the first child
hashes the parent. The blocks' roots, a thousandth as many, are the next round's nodes. Paths come back down by joins on the block.

Null columns count as absent. Rows are ordered by key, nulls first, those of one key by their digest; repeated rows are leaves
each. A null group is a group, before all others. An empty table gives no rows. Columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import parts, staged, unstage

PATH = "array<struct<left:string,right:string>>"


def row_digest(columns: list[Column]) -> Column:
    """sha256 of the values one after the other: - for null, else the number of bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings, from the lowest level up."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(_g, ...) with the place `_i` in its group, from 0, and the group's size `_n`; and the staged table behind it."""
    keys = ["_g", *order]
    ranged = rows.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle_sorted")  # partition and place in it
    part = F.shiftright("_at", 33)
    each = ranged.groupBy("_g", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    # a row for each group and partition that holds some of it
    before = F.sum("_many").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_many")
    each = each.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_many").over(Window.partitionBy("_g")).alias("_n"))
    return ranged.withColumn("_part", part).join(each, ["_g", "_part"]).withColumn("_i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), ranged


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes(_g, _i, _n, _h, ...) with `_path`, the siblings on the way to the block's root, and `_up`, that root, on its first row."""
    block = Window.partitionBy("_g", F.expr(f"_i DIV {arity**levels}L")).orderBy("_i")
    out = nodes.withColumn("_up", F.col("_h"))
    for level in range(levels):
        stride = arity**level
        slot, go_on = F.expr(f"(_i DIV {stride}L) % {arity}"), F.col("_n") > stride  # more than one node is left
        left = [F.when(slot >= j, F.lag("_up", j * stride).over(block)) for j in range(arity - 1, 0, -1)]
        right = [F.when((slot + j < arity) & (F.col("_i") + j * stride < F.col("_n")), F.lead("_up", j * stride).over(block)) for j in range(1, arity)]
        out = out.withColumns({"_left": F.concat_ws("", *left), "_right": F.concat_ws("", *right)})
        step = F.when(go_on & (F.col("_i") % stride == 0), F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        parent = F.when(F.col("_i") % (stride * arity) == 0, F.sha2(F.concat("_up", "_right"), 256))
        out = out.withColumns({f"_s{level}": step, "_up": F.when(go_on, parent).otherwise(F.col("_up"))})
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the last node at or before a row is its ancestor
    steps = [F.last(f"_s{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    out = out.withColumn("_path", F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(PATH))
    return out.drop("_left", "_right", *[f"_s{level}" for level in range(levels)])


def _tree(rows: DataFrame, order: list[str], arity: int, levels: int, over: bool) -> DataFrame:
    """rows(_g, _h, ...) with `_path` and `_sub`, the root of their group; with `over`, the path goes on to `_root`, that of all groups."""
    size = arity**levels
    nodes, behind = _placed(rows, order)
    most = nodes.agg(F.max("_n")).first()[0] or 1
    rounds = []
    while True:
        rounds.append(staged(_climbed(nodes, arity, levels), "merkle_level"))
        if most <= size:
            break
        nodes = rounds[-1].filter(F.col("_i") % size == 0).select("_g", F.expr(f"_i DIV {size}L").alias("_i"), F.expr(f"(_n + {size - 1}L) DIV {size}L").alias("_n"), F.col("_up").alias("_h"))
        most = -(-most // size)
    unstage(behind)
    above = rounds[-1].filter("_i = 0").select("_g", F.lit(0).cast("bigint").alias("_b"), F.col("_up").alias("_sub"))
    if over:
        groups = _tree(above.select(F.lit("").alias("_g"), F.col("_g").alias("_of"), F.col("_sub").alias("_h")), ["_of"], arity, levels, False)
        above = above.join(groups.select(F.col("_of").alias("_g"), F.col("_path").alias("_rest"), F.col("_sub").alias("_root")), "_g")
    else:
        above = above.withColumns({"_rest": F.array().cast(PATH), "_root": F.col("_sub")})
    for one in reversed(rounds):
        one = one.withColumn("_b", F.expr(f"_i DIV {size}L")).join(above, ["_g", "_b"])
        one = one.withColumn("_path", F.concat("_path", "_rest"))
        above = one.select("_g", F.col("_i").alias("_b"), F.col("_path").alias("_rest"), "_sub", "_root")
    return one.drop("_b", "_rest", "_up", "_n")


def manifest(df: DataFrame, leaf: Column, key: str, group: str, keep: dict[str, Column] | None = None, arity: int = 2, levels: int = 10) -> DataFrame:
    """key, `leaf`, `subroot`, `root`, `path` (the siblings' digests to the left and right of each node from the leaf up, as
    `fold` takes them), and the columns of keep. A block has arity ** levels rows."""
    if arity < 2 or levels < 1:
        raise ValueError("a run has two nodes or more, a block one level or more")
    g = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    extra = dict(keep or {})
    rows = staged(df.select(g.alias("_g"), F.col(f"`{key}`").alias("_key"), leaf.alias("_h"), *[c.alias(f"_keep_{n}") for n, c in extra.items()]), "merkle_leaves")
    tree = _tree(rows, ["_key", "_h"], arity, levels, True)
    unstage(rows)
    return tree.select(F.col("_key").alias(key), F.col("_h").alias("leaf"), F.col("_sub").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"), *[F.col(f"_keep_{n}").alias(n) for n in extra])


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, by language; rows whose key's checksum 7 divides are folded as if n_chars were one more."""
    from fleetlens.llm.common import table

    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    tampered = row_digest([*columns[:3], changed, columns[4]])
    out = manifest(docs, row_digest(columns), "doc_id", "lang", {"claimed": tampered})
    out = out.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
