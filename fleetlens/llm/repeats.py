"""Removal of repeated byte strings with sorted, range-partitioned suffixes.

A byte goes if it lies in a `LENGTH`-byte string that also starts in a document with a smaller id. Sorting every suffix of
the corpus with its bytes would move some sixty times its size, so suffixes are thinned out, without loss, and stand as
leading tokens, which are hashes of their first bytes:

1. Every string's anchor is its least-hashed substring of `GRAM` bytes. A block is a longest run of strings with the same
   anchor in place. Blocks are ordered by the token of their anchor, then by that of all their bytes, then by document. A
   block that occurs in a document with a smaller id is settled. Blocks of one anchor that differ as a whole can
   still share strings: the first of each kind goes on. Strings with an anchor found nowhere else occur nowhere else.
2. The suffixes that start in those blocks, cut after `LENGTH` bytes, are ordered by their token and by document, and those of
   a later document than the first of their run are settled.

Both steps range-partition the tokens, sort each bucket by its keys in turn, and compare neighbours. Tokens are uniform, so
evenly spaced splitters stand for sampled ones, and equal tokens never lie on both sides of a boundary.

Null texts are empty; rows with a null id are kept whole and repeat nothing. A string's fate depends on its bytes and its id
alone, so rows that repeat an id share it. An id is never smaller than itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import staged, table

U = np.uint64
LENGTH, GRAM = 50, 24
WIDE = LENGTH - GRAM + 1
#: Bytes of text worked on at a time; bytes of the corpus for each range of the tokens.
AT_ONCE, SHARE = 1 << 19, 2 << 20
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_BASE = [U(int(x) | 1) for x in _rng.integers(2**61, 2**62, 6)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_kept["up"]) < n:
        base = int(_BASE[5])
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            x = np.full(n, U(b))
            x[0] = 1
            _kept[name] = np.multiply.accumulate(x)
    return _kept["up"][:n], _kept["down"][:n]


_kept = {"up": np.zeros(0, U), "down": np.zeros(0, U)}


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first start, last start, anchor's token, block's token) of each block, in order; and, of the
    joined texts, where each text starts and the token of the string at each place (of no meaning across texts)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, ends = len(data), np.cumsum(sizes)
    none = (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U)] * 2, ends - sizes, np.zeros(0, U))
    if n < LENGTH:
        return none
    b = _BYTE[data]
    h2 = b[:-1] * _BASE[0] + b[1:]
    h4 = h2[:-2] * _BASE[1] + h2[2:]
    h8 = h4[:-4] * _BASE[2] + h4[4:]
    h16 = h8[:-8] * _BASE[3] + h8[8:]
    gram = mix(h16[: n - GRAM + 1] * _BASE[4] + h8[16 : 16 + n - GRAM + 1])
    low = U((1 << 31) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=U)
    width = 1
    while 2 * width <= WIDE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(gram) - WIDE + 1], least[WIDE - width :][: len(gram) - WIDE + 1])
    anchor = (least & low).astype(np.int64)
    start = np.flatnonzero(np.repeat(ends, sizes)[: len(anchor)] - np.arange(len(anchor)) >= LENGTH)
    if not len(start):
        return none
    at = anchor[start]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    lo, hi = start[first], start[last]
    up, down = _powers(n)
    total = np.concatenate([[U(0)], np.cumsum(b * up, dtype=U)])
    whole = mix((total[hi + LENGTH] - total[lo]) * down[lo] + (hi - lo).astype(U) * _M1)
    string = mix((total[LENGTH:] - total[: n - LENGTH + 1]) * down[: n - LENGTH + 1])
    who = np.searchsorted(ends, lo, side="right")
    offset = ends - sizes
    return who, lo - offset[who], hi - offset[who], gram[at[first]], whole, offset, string


def _starts(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers from each lo to its hi."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[np.ndarray, list[bytes], list]]:
    """(ids, texts, the third column if there is one) of some rows at a time; more than AT_ONCE bytes only for one long text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            ids, third = some.column(0).to_numpy(), some.column(2) if some.num_columns > 2 else None
            held, size, first = [], 0, 0
            for i, t in enumerate(some.column(1)):
                held.append(t.as_py().encode())
                size += len(held[-1])
                if size >= AT_ONCE or i + 1 == some.num_rows:
                    yield ids[first : i + 1], held, [third[k].as_py() for k in range(first, i + 1)] if third is not None else []
                    held, size, first = [], 0, i + 1


def _dealt(first: np.ndarray, second: np.ndarray, docs: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows of (range of the first token, packed columns), one for each range that is met."""
    number = (first >> U(32)).astype(np.int64) * ranges >> 32
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(ranges + 1))
    filled = np.flatnonzero(np.diff(cuts))
    packed = [(first[order] & U(0xFFFFFFFF)).astype(np.uint32) if second is not first else np.zeros(len(order), "V0"), second[order], docs[order]]
    columns = [pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in filled], pa.binary()) for x in packed]
    return pa.record_batch([pa.array(filled, pa.int64()), *columns], ["bucket", "first", "second", "doc"])


def _block_rows(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for ids, texts, _ in _in_parts(batches):
        who, _, _, anchor, whole, _, _ = blocks(texts)
        yield _dealt(anchor, whole, ids[who], ranges)


def _string_rows(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The strings that start in open blocks; a block's token names it."""
    for ids, texts, opened in _in_parts(batches):
        who, lo, hi, _, whole, offset, string = blocks(texts)
        # a block is open for its own text only
        mark = mix(whole + who.astype(U) * _M2)
        wanted = np.concatenate([mix(np.asarray(x, np.int64).view(U) + np.full(1, k, U) * _M2) for k, x in enumerate(opened)]) if opened else np.zeros(0, U)
        inside = np.isin(mark, wanted)
        starts = _starts((lo + offset[who])[inside], (hi + offset[who])[inside])
        owner, tokens = np.repeat(who[inside], (hi - lo + 1)[inside]), string[starts]
        yield _dealt(tokens, tokens, ids[owner], ranges)


def _sorted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's columns in order of first, second, doc; whether first is new, whether first or second is. First is left
    out where second says all."""
    first, second, doc = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("first", np.uint32), ("second", U), ("doc", np.int64)))
    first = first if len(first) else np.zeros(len(second), np.uint32)
    order = np.lexsort((doc, second, first))
    first, second, doc = first[order], second[order], doc[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    return first, second, doc, new, new | np.concatenate([[True], second[1:] != second[:-1]])


def _told(doc: np.ndarray, token: np.ndarray, open_: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc": doc, "token": token.view(np.int64), "open": open_}).drop_duplicates()


def _settle_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc, token, open): blocks that an earlier document has (not open), and those to be compared string by string (open)."""
    _, whole, doc, new_anchor, new_block = _sorted(pdf)
    settled = doc > doc[new_block][np.cumsum(new_block) - 1]
    group = np.cumsum(new_anchor) - 1
    going_on = new_block & (np.bincount(group, new_block)[group] > 1)
    chosen = settled | going_on
    return _told(doc[chosen], whole[chosen], going_on[chosen])


def _settle_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    _, string, doc, _, new = _sorted(pdf)
    settled = doc > doc[new][np.cumsum(new) - 1]
    return _told(doc[settled], string[settled], np.zeros(settled.sum(), bool))


def covered(text: bytes, found: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (starts, ends) of the bytes in strings that are settled, by their block or by themselves."""
    _, lo, hi, _, whole, _, string = blocks([text])
    inside = np.isin(whole, found)
    lo, hi = lo[inside], hi[inside]
    single = np.flatnonzero(np.isin(string, strings)) if len(strings) else np.zeros(0, np.int64)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, np.concatenate([lo, single]), 1)
    np.add.at(change, np.concatenate([hi, single]) + LENGTH, -1)
    gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    return edges[::2], edges[1::2]


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, starts, ends, kept_sha256): of each row the removed runs, in bytes, and the hash of what stays."""
    docs = df.select(F.col(f"`{id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    texts = docs.filter((F.octet_length("_text") >= LENGTH) & F.col("_id").isNotNull())
    total = docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    ranges = max(64, int(total // SHARE))
    row, told = "bucket long, first binary, second binary, doc binary", "doc long, token long, open boolean"

    dealt = texts.mapInArrow(lambda b: _block_rows(b, ranges), row)
    settled = staged(dealt.groupBy("bucket").applyInPandas(_settle_blocks, told), "blocks")
    # what is told of documents grows with the corpus; it is never broadcast
    opened = settled.filter("open").groupBy("doc").agg(F.collect_list("token").alias("_open")).hint("merge")
    strings = texts.join(opened, F.col("_id") == F.col("doc")).select("_id", "_text", "_open").mapInArrow(lambda b: _string_rows(b, ranges), row)
    single = staged(strings.groupBy("bucket").applyInPandas(_settle_strings, told), "strings")

    by_doc = lambda t, name: t.groupBy("doc").agg(F.collect_list("token").alias(name))
    known = by_doc(settled.filter("NOT open"), "_blocks").join(by_doc(single, "_strings"), "doc", "full_outer").hint("merge")

    @F.pandas_udf("starts array<int>, ends array<int>, kept_sha256 string")
    def cut(batch: pd.Series, found: pd.Series, strings: pd.Series) -> pd.DataFrame:
        out, tokens = [], lambda x: np.asarray([] if x is None else x, np.int64).view(U)
        for t, b, s in zip(batch, found, strings, strict=True):
            data = t.encode()
            lo, hi = covered(data, tokens(b), tokens(s)) if b is not None or s is not None else (np.zeros(0, np.int64),) * 2
            digest, at = hashlib.sha256(), 0
            for x, y in zip(lo, hi, strict=True):
                digest.update(data[at:x])
                at = y
            digest.update(data[at:])
            out.append((lo.tolist(), hi.tolist(), digest.hexdigest()))
        return pd.DataFrame(out, columns=["starts", "ends", "kept_sha256"])

    whole = docs.join(known, F.col("_id") == F.col("doc"), "left").withColumn("_cut", cut("_text", "_blocks", "_strings"))
    return whole.select(F.col("_id").alias(id), F.octet_length("_text").cast("long").alias("n_bytes"), "_cut.starts", "_cut.ends", "_cut.kept_sha256")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that repeat 50 bytes of an earlier document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("CAST(aggregate(zip_with(ends, starts, (e, s) -> e - s), 0, (a, x) -> a + x) AS BIGINT)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
