"""N-gram Jaccard self-join by PartEnum signatures.

A text's set holds its distinct shingles of `width` words (64-bit hashes); texts with equal sets are one node. Two sets
of similarity q or more, the smaller in the band of sizes t, differ in at most k = (1 - q) / q * (largest size of t)
shingles, and the larger one is of band t or t + 1. For t, the domain of shingles is cut into n1 = k // 2 + 1 + s
partitions of three parts each. At least 1 + s partitions hold one differing shingle at most, so there two of the
three parts agree: every set emits, for its own band and the one below, the hash of each two parts of each partition, and
similar sets share one. A pair of parts without a shingle would join unrelated sets; it is emitted only by sets in
which more than s partitions have one, as other sets have a good partition without it.

The nodes that share a signature are a group; groups of the same nodes are one. Its sets are compared, not all with all:

1. Each node meets the first of its groups. Pairs that pass a filter are compared exactly; the true links give each node a
   label, the least node that it is linked with so far.
2. In groups with more than one label, each node names its likeliest partners among the nodes of other labels; they are
   compared exactly, and labels and failures noted. This is repeated, with 4, then 16 times as many partners named each time,
   until no node has a partner left that could be linked. A group in which no node names one is finished, and one of two
   nodes is after the first step.

So members of one class, however many, are not compared with each other. The filter keeps each set's shingles as a bit
map of at least as many bits, in which every shingle flips one bit: two maps differ in no more bits than their sets
in shingles, so no link is lost by it. Sizes and maps go with the nodes; the shingles of a pair that passes the filter are made
again from its texts, which are picked where they lie by a map of bits (`common.likely`) before they move. In a group of more than `MOST` nodes, those of its commonest label stand in blocks, and
the others meet each block: the work is (nodes) * (nodes not of that label). A signature that one task sees often is dealt
out over many tasks.

Null, empty and word-less texts have an empty set and no links. Rows that repeat an id or have none are linked as their texts
are; a class is named by its least id, and by null only if none of its rows has an id. Nodes are 64-bit hashes of sets: n
different sets meet by chance n^2 / 2^65 times.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import BATCH_BYTES, WORD, likely, parts, small, staged, table, unstage
from fleetlens.llm.graph import components

U = np.uint64
_P1, _P2, _P3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_ALL = (1 << 64) - 1
#: Shingles whose signatures are made at a time; nodes compared at a time; sets of one task with a signature that make it hot.
AT_ONCE, MOST, HOT = 200_000, 2048, 32
#: Parts of a partition; a signature is of all of them but one.
PARTS = 2
#: The bits of a signature that are sent: 40. Those left out would cost the exchange up to three bytes a row. n signatures meet by chance
#: n^2 / 2^41 times (some 2,000 times in 65 million, 7 million times in 4 billion); such groups are compared in vain.
SENT = U(_ALL ^ 0xFFFFFF)
#: Hashes that a task remembers at most; it forgets all of them beyond.
REMEMBERED = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * _P2
    x = (x ^ (x >> U(27))) * _P3
    return x ^ (x >> U(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = value
        return value


_words = Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles, ascending. Only A-Z are lower-cased, and words end at space and tab to carriage return."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, U) * _P1
    for k in range(n):
        out = mix(out * _P1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def node(s: np.ndarray) -> int:
    """The hash of a set."""
    if not len(s):
        return 0
    return int(mix(np.array([int(mix(s + _P1).sum(dtype=U)) ^ (len(s) * int(_P2) & _ALL)], U)).view(np.int64)[0])


def bits(s: np.ndarray) -> np.ndarray:
    """A bit map in which every shingle flips one bit: 64-bit words, once to twice as many bits as shingles. Of unrelated
    sets about half the bits differ, of linked ones (80 %) two ninths at most."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(size - 1)).astype(np.int64), minlength=size) & 1).view(U)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The map that fewer words would have given."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def allowed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """In how many shingles linked sets of those sizes differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Sizes from least[t] to least[t + 1] - 1 are band t."""

    def __init__(self, percent: int, parts: int = PARTS) -> None:
        least = [1]
        while least[-1] < 1 << 40:
            least.append(least[-1] * 100 // percent + 1)
        self.least = np.array(least)
        most = self.least[1:] - 1
        k = most * (100 - percent) // percent
        base = k // 2 + 1
        # so many spare ones that few sets have more partitions with an empty part (1.4 % at 80 % on texts of some 400 words)
        self.slack = 1 + -(-base * (100 - percent) ** 2 // 1600)
        self.partitions = np.where(k > 0, base + self.slack, 0)  # sets that may not differ at all are one node anyway
        self.percent, self.parts = percent, parts

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signature, number of the set)."""
        sizes = np.array([len(s) for s in sets])
        who = np.flatnonzero(sizes)
        band = np.searchsorted(self.least, sizes[who], side="right") - 1
        below = (band > 0) & (-(-sizes[who] * self.percent // 100) < self.least[band])
        owner, tag = np.concatenate([who, who[below]]), np.concatenate([band, band[below] - 1])
        some = self.partitions[tag] > 0
        owner, tag = owner[some], tag[some]
        if not len(owner):
            return np.zeros(0, U), np.zeros(0, np.int64)
        n1, n2 = self.partitions[tag], self.parts
        elements = np.concatenate([sets[o] for o in owner])
        entry = np.repeat(np.arange(len(owner)), sizes[owner])
        first = np.concatenate([[0], np.cumsum(n2 * n1)])
        place = ((elements >> U(33)).astype(np.int64) % n1[entry]) * n2 + (elements & U(0xFFFFFFFF)).astype(np.int64) % n2
        cell = first[entry] + place
        total = np.zeros(first[-1], U)
        np.add.at(total, cell, mix(elements + _P3))
        count = np.bincount(cell, minlength=first[-1]).reshape(-1, n2)
        total = total.reshape(-1, n2)
        row_entry = np.repeat(np.arange(len(owner)), n1)  # of each partition
        number = np.arange(len(row_entry)) - first[row_entry] // n2
        rest, filled = total.sum(axis=1, dtype=U)[:, None] - total, count.sum(axis=1)[:, None] - count > 0
        weak = np.bincount(row_entry, ~filled.all(axis=1), len(owner))
        emitted = filled | (weak > self.slack[tag])[row_entry][:, None]
        name = mix((tag[row_entry].astype(U) * _P1 + number.astype(U))[:, None] * _P2 + np.arange(n2, dtype=U)[None])
        return mix(rest ^ name)[emitted] & SENT, np.broadcast_to(owner[row_entry][:, None], emitted.shape)[emitted]


def _signature_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int, salts: int, turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
    """(signature, tag, node), of the signatures whose turn it is. Sets with a hot signature get tags above 0, one of them a row
    with tag -1 that says so."""
    bands, seen = Bands(percent), set()  # equal sets of a task give their signatures once

    def made(sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        signature, owner = bands.signatures(sets)
        if turns > 1:
            mine = (signature >> U(32)) % U(turns) == turn
            signature, owner = signature[mine], owner[mine]
        node, tag = np.array(nodes, np.int64)[owner], np.zeros(len(owner), np.int32)
        if salts > 1 and len(signature):
            _, first, place, count = np.unique(signature, return_index=True, return_inverse=True, return_counts=True)
            hot = count >= HOT
            if hot.any():
                chosen = hot[place]
                tag[chosen] = 1 + node[chosen] % salts
                first = first[hot]
                signature, node, tag = np.append(signature, signature[first]), np.append(node, node[first]), np.append(tag, np.full(len(first), -1, np.int32))
        return pa.record_batch({"signature": signature.view(np.int64), "tag": tag, "node": node})

    sets, nodes, size = [], [], 0
    for batch in batches:
        for text in batch.column(0):
            s = shingles(text.as_py(), width)
            if len(s) and (k := node(s)) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(k)
                sets.append(s)
                nodes.append(k)
                size += len(s)
                if size >= AT_ONCE:
                    yield made(sets, nodes)
                    sets, nodes, size = [], [], 0
    if sets:
        yield made(sets, nodes)


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (signature, tag, node), sorted: (group, node) of the groups of two nodes or more. A group within one task is
    named by its nodes; one that is hot or has more than `MOST` nodes by its signature."""
    seen: set[int] = set()
    # the open group: its signature and tag, its nodes not yet given out, and whether it is named by its signature
    signature, tag, nodes, wide = None, None, np.zeros(0, np.int64), False

    def rows(groups: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"group": np.ascontiguousarray(groups), "node": np.ascontiguousarray(of)})

    def by_signature(s: int, of: np.ndarray) -> pa.RecordBatch:
        return rows(np.full(len(of), int(mix(np.array([s], np.int64).view(U) ^ _P1).view(np.int64)[0])), of)

    def closed(s: int, t: int, of: np.ndarray, named: bool) -> Iterator[pa.RecordBatch]:
        if named or t > 0:
            if len(of):
                yield by_signature(s, of)
        elif len(of) > 1:
            name = int(mix(np.array([int(mix(of.view(U)).sum(dtype=U)) ^ len(of)], U)).view(np.int64)[0])
            if name not in seen:
                seen.add(name)
                yield rows(np.full(len(of), name), of)

    for batch in batches:
        if not batch.num_rows:
            continue
        s, t, n = (batch.column(c).to_numpy() for c in range(3))
        starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1])]))
        ends = np.append(starts[1:], len(s))
        plain = (t[starts] == 0) & (t[ends - 1] == 0) & (ends - starts <= MOST)
        plain[0] = plain[-1] = False
        # the groups that lie within the batch, all at once
        which = np.flatnonzero(plain & (ends - starts > 1))
        if len(which):
            inside = np.repeat(plain & (ends - starts > 1), ends - starts)
            ss, nn = s[inside], n[inside]
            fresh = np.concatenate([[True], (ss[1:] != ss[:-1]) | (nn[1:] != nn[:-1])])  # several tasks can hold a set
            ss, nn = ss[fresh], nn[fresh]
            at = np.flatnonzero(np.concatenate([[True], ss[1:] != ss[:-1]]))
            size = np.diff(np.append(at, len(ss)))
            name = mix(np.add.reduceat(mix(nn.view(U)), at) ^ size.astype(U)).view(np.int64)
            _, first = np.unique(name, return_index=True)
            first = np.array([k for k in first if size[k] > 1 and int(name[k]) not in seen], np.int64)
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(name[first].tolist())
            chosen = np.zeros(len(at), bool)
            chosen[first] = True
            inside = np.repeat(chosen, size)
            yield rows(np.repeat(name, size)[inside], nn[inside])
        # the others: the first and the last, which go on over batches, and the wide ones
        for k in np.flatnonzero(~plain):
            a, b = starts[k], ends[k]
            if signature is not None and s[a] != signature:
                yield from closed(signature, tag, nodes, wide)
                signature = None
            if signature is None:
                signature, tag, nodes, wide = s[a], t[a], np.zeros(0, np.int64), bool(t[a] != 0)
            nodes = np.unique(np.concatenate([nodes, n[a:b]]))
            if len(nodes) > MOST:
                yield by_signature(signature, nodes)
                nodes, wide = nodes[:0], True
    if signature is not None:
        yield from closed(signature, tag, nodes, wide)


def _likeliest(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, maps: list[bytes], failed: list[list[int] | None], most: int, percent: int) -> np.ndarray:
    """Rows (a, b), a < b: each node's `most` likeliest partners of another label. failed: with which a node is known not to be linked."""
    words = min(map(len, maps)) // 8
    bit = np.stack([folded(np.frombuffer(m, U), words) for m in maps])
    place, out, rows = {n: i for i, n in enumerate(nodes.tolist())}, [], max(1, 500_000 // (len(nodes) * words))
    for at in range(0, len(nodes), rows):
        some = slice(at, at + rows)
        differ = np.bitwise_count(bit[some, None] ^ bit[None]).sum(axis=2, dtype=np.int64)
        bound = allowed(sizes[some, None], sizes[None], percent)
        possible = (differ <= bound) & (np.abs(sizes[some, None] - sizes[None]) <= bound) & (labels[some, None] != labels[None])
        if not possible.any():
            continue
        for i, known in enumerate(failed[some]):
            for f in known or ():
                if f in place:
                    possible[i, place[f]] = False
        k = min(most, len(nodes))
        best = np.argpartition(np.where(possible, differ, np.iinfo(np.int64).max), k - 1, axis=1)[:, :k]
        i, j = np.nonzero(np.take_along_axis(possible, best, axis=1))
        x, y = nodes[at + i], nodes[best[i, j]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _named(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (group, kind, x, y, node, label, n, bits, failed), sorted by the first four: (group, a, b), the pairs that nodes of
    one block name. Blocks are small and many, so they are read from one stream and not as groups of their own."""
    held: list[pa.RecordBatch] = []

    def pairs(block: pa.Table) -> np.ndarray:
        node, label, n = (block.column(c).to_numpy() for c in (4, 5, 6))
        both = _likeliest(node, label, n, block.column(7).to_pylist(), block.column(8).to_pylist(), most, percent)
        return np.concatenate([np.full((len(both), 1), block.column(0)[0].as_py()), both], axis=1)

    def found(out: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.record_batch({name: np.ascontiguousarray(rows[:, k]) for k, name in enumerate(("group", "a", "b"))})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])).tolist()
        goes_on = held and all(held[-1].column(c)[held[-1].num_rows - 1] == batch.column(c)[0] for c in range(4))
        out = []
        if held and not goes_on:
            out.append(pairs(pa.Table.from_batches(held)))
            held = []
        if len(starts) > 1 and held:
            out.append(pairs(pa.Table.from_batches([*held, batch.slice(0, starts[1])])))
            held, starts = [], starts[1:]
        for a, b in zip(starts, starts[1:], strict=False):
            out.append(pairs(pa.Table.from_batches([batch.slice(a, b - a)])))
        held.append(batch.slice(starts[-1]))
        yield found(out)
    if held:
        yield found([pairs(pa.Table.from_batches(held))])


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with each of the columns of both nodes, as <column>_a and <column>_b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the filter, by maps (node, n, bits)."""

    @F.pandas_udf("boolean")
    def possible(n_a: pd.Series, n_b: pd.Series, of_a: pd.Series, of_b: pd.Series) -> pd.Series:
        out = []
        for na, nb, a, b in zip(n_a, n_b, of_a, of_b, strict=True):
            x, y = np.frombuffer(a, U), np.frombuffer(b, U)
            words = min(len(x), len(y))
            out.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= allowed(na, nb, percent))
        return pd.Series(out, dtype=bool)

    near = F.abs(F.col("n_a") - F.col("n_b")) <= F.expr(f"(n_a + n_b) * {100 - percent} DIV {100 + percent}")
    return _both(pairs, maps, "n", "bits").filter(near).filter(possible("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


def _compared(pairs: DataFrame, docs: DataFrame, maps: DataFrame, width: int, percent: int) -> DataFrame:
    """Staged pairs (a, b) with `linked`, exactly. Of docs (_id, _text) only the texts of nodes in pairs move, one each."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts])

    @F.pandas_udf("boolean")
    def linked(of_a: pd.Series, of_b: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(of_a, of_b, strict=True):
            x, y = np.frombuffer(a, U), np.frombuffer(b, U)
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = staged(nodes.join(maps, "node").select("node", "least._id", "least._h"), "wanted")
    texts = likely(docs, F.xxhash64("_text"), wanted, "_h").filter("_likely").drop("_likely")
    sets = staged(_one_each(texts, "_id", "_text", wanted).select("node", packed("_row._text").alias("shingles")), "sets", BATCH_BYTES)
    out = staged(_both(pairs, sets, "shingles").select("a", "b", linked("shingles_a", "shingles_b").alias("linked")), "compared", BATCH_BYTES)
    unstage(wanted, sets)
    return out


def _partners(groups: DataFrame, labels: DataFrame, maps: DataFrame, failed: DataFrame, most: int, percent: int) -> DataFrame:
    """(group, a, b): the pairs named in groups of more than one label."""
    labelled = staged(groups.join(small(labels), "node", "left").select("group", "node", F.coalesce("component", "node").alias("label")), "labelled")
    each = labelled.groupBy("group", "label").agg(F.count("*").alias("m"))
    kinds = each.groupBy("group").agg(F.sum("m").alias("all"), F.max("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("common"), F.count("*").alias("labels"))
    dealt = labelled.join(kinds.filter("labels > 1"), "group")
    hashed = "xxhash64(node)"
    own = f"CAST(pmod({hashed}, ceil(m / {MOST})) AS INT)"  # block of a node with the commonest label
    others = f"CAST(ceil((all - m) / {MOST}) AS INT)"
    place = f"CAST(pmod({hashed}, {others}) AS INT)"  # block of another node
    deal = F.expr(
        f"CASE WHEN all <= {MOST} THEN array(struct(0 AS kind, 0 AS x, 0 AS y)) "
        f"WHEN label = common THEN transform(sequence(0, {others} - 1), o -> struct(1 AS kind, {own} AS x, o AS y)) "
        f"ELSE concat(transform(sequence(0, CAST(ceil(m / {MOST}) AS INT) - 1), b -> struct(1 AS kind, b AS x, {place} AS y)), "
        f"transform(sequence(0, {others} - 1), o -> struct(2 AS kind, least(o, {place}) AS x, greatest(o, {place}) AS y))) END"
    )
    dealt = dealt.select("group", "node", "label", F.inline(deal))
    known = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed"))
    held = dealt.join(maps.select("node", "n", "bits"), "node").join(known, "node", "left")
    key = ["group", "kind", "x", "y"]
    blocks = held.repartition(*key).sortWithinPartitions(*key).select(*key, "node", "label", "n", "bits", "failed")
    out = staged(blocks.mapInArrow(lambda b: _named(b, most, percent), "group long, a long, b long"), "partners", BATCH_BYTES)
    unstage(labelled)
    return out


def _one_each(df: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """One row of df (as `_row`) for each row of wanted (_id, _h: hash of the text, and others), of all with that id and text.
    Rows with their texts move once: they are joined and freed of repeats by the same keys."""

    def keys(i: Column, h: Column) -> list[Column]:
        return [F.coalesce(i.cast("string"), F.lit("")).alias("_key"), i.isNull().alias("_none"), h.alias("_hash")]

    names = ["_key", "_none", "_hash"]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *keys(F.col(f"`{id}`"), F.xxhash64(F.col(f"`{text}`"))))
    named = wanted.select(*keys(F.col("_id"), F.col("_h")), *[c for c in wanted.columns if c not in ("_id", "_h")])
    return rows.join(named, names).dropDuplicates(names).drop(*names)


def resolve(df: DataFrame, id: str, text: str, width: int, percent: int, turns: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: the rows (_id, _h: hash of the text, n: size of the set, node), and (node, least: of the class, the
    least (whether the id is null, id, hash of the text), m: the rows of the class). turns: in how many turns all signatures
    are made and grouped; each holds its share of them on disk at once, and reads the texts again."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))

    @F.pandas_udf("n long, node long, bits binary")
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, width) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in found], "node": [node(s) for s in found], "bits": [bits(s).tobytes() if len(s) else None for s in found]})

    rows = staged(docs.select("_id", F.xxhash64("_text").alias("_h"), measured("_text").alias("_s")).select("_id", "_h", "_s.*"), "shingle_sets", BATCH_BYTES)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h"))
    each = rows.filter("n > 0").groupBy("node").agg(first.alias("least"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = staged(each, "nodes")

    salts = parts(spark)
    each_turn = []
    for turn in range(turns):
        signed = docs.select("_text").mapInArrow(lambda b, turn=turn: _signature_rows(b, width, percent, salts, turn, turns), "signature long, tag int, node long")
        # signature and node next to each other, as two runs of zeros about each would cost the exchange more bytes
        signed = signed.select("tag", "signature", "node").repartition("signature", F.greatest("tag", F.lit(0))).sortWithinPartitions("signature", "tag", "node")
        each_turn.append(staged(signed.select("signature", "tag", "node").mapInArrow(_group_rows, "group long, node long"), "groups", BATCH_BYTES))
    together = functools.reduce(DataFrame.unionByName, each_turn).dropDuplicates(["group", "node"])
    heads = together.groupBy("group").agg(F.min("node").alias("b"), F.count("*").alias("m"))
    headed = staged(together.join(heads, "group"), "headed")
    unstage(*each_turn)

    maps = staged(nodes.join(headed.select("node").distinct(), "node", "left_semi").select("node", "least", "n", "bits"), "maps")
    stars = headed.filter("node > b").select(F.col("node").alias("a"), "b").distinct()
    pairs = staged(_possible(stars, maps, percent), "compared", BATCH_BYTES)
    known = [_compared(pairs, docs, maps, width, percent)]
    unstage(pairs)
    larger = headed.filter("m > 2").select("group", "node")
    labels, most, open_groups, pairs = components(known[0].filter("linked"), "a", "b"), 1, larger, None
    while True:
        links = known[0]
        for more in known[1:]:
            links = links.unionByName(more)
        before, pairs = pairs, _partners(open_groups, labels, maps, links.filter("NOT linked").select("a", "b"), most, percent)
        if before is not None:
            unstage(before)
        if pairs.isEmpty():
            break
        known.append(_compared(pairs.select("a", "b").distinct(), docs, maps, width, percent))
        found = known[-1].filter("linked").select("a", "b")
        if not found.isEmpty():  # classes only grow: what was found before is stars about their labels
            known_as, labels = labels, components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), "a", "b")
            unstage(known_as)
        open_groups, most = larger.join(pairs.select("group").distinct(), "group", "left_semi"), most * (4 if most == 1 else 16)

    of = nodes.join(labels, "node", "left").select("node", "least", "m", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("least"), F.sum("m").alias("m"))
    classes = staged(of.select("node", "component").join(least, "component").select("node", "least", "m"), "classes")
    unstage(nodes, headed, maps, labels, pairs, *known)
    return rows, classes


def join(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles long, component_id): one row for each row of df; component_id is the least id reachable."""
    rows, classes = resolve(df, id, text, width, percent)
    out = rows.join(classes, "node", "left")
    return out.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least._id")).otherwise(F.col("_id")).alias("component_id"))


def first_of_class(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df of which no class has more than one: the one of least id (null ids last, then by a hash of the text).
    Rows without words belong to no class and all stay. Signatures come in two turns: at five words and 80 % they would be most of
    the disk at once."""
    rows, classes = resolve(df, id, text, width, percent, turns=2)
    # only the texts of classes of several rows move; the others are all there is of their class
    several = staged(rows.join(classes.filter("m > 1").select("node"), "node").select("_h").distinct(), "several")
    kept = likely(classes.select("least").distinct().select("least._id", "least._h"), F.col("_h"), several, "_h").filter("_likely").drop("_likely")
    found = likely(df, F.xxhash64(F.col(f"`{text}`")), several, "_h")
    wordless = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD)
    moved, left = found.filter(F.col("_likely") & ~wordless).drop("_likely"), found.filter(~F.col("_likely") | wordless).drop("_likely")
    return _one_each(moved, id, text, kept).select("_row.*").unionByName(left)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of whole texts by links of 90 % of their three-word shingles."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)
