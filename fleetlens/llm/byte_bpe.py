"""Byte-level BPE encoding and decoding.

Documents of up to `chunk` characters are pre-tokenised and encoded in place. Longer ones are cut into overlapping
chunks that are dealt out over the cluster, each pre-tokenised from its own first character and encoded. Two
neighbours are stitched at the first pre-token boundary that both see inside their overlap: matching only looks
ahead, so from a shared boundary on both would split the text alike. Boundaries so near a chunk's end that the cut
may have made them don't count. A chunk gives its ids between its two seams. A document that has a
seam without a shared boundary (one pre-token longer than the overlap) is put together again from the bytes of its chunks'
ids and encoded whole. Decoding concatenates the bytes of the ids.

Null texts count as empty and give no ids. Repeated rows are encoded one by one, but for those that follow each other, which
are encoded once. A column named like a result is replaced; the text column isn't returned.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import packed_row

#: Characters at a chunk's end whose boundaries depend on what follows: the longest lookahead or fixed alternative.
MARGIN = 8
KEPT_PIECES, KEPT_LENGTH = 300_000, 48


class Encoder(dict):
    """From a pre-token to its ids, packed as little-endian unsigned 32-bit integers; remembers short pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, data: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it was joined to its left neighbour
        left = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != j:
                continue
            end[i], end[middle] = j, 0
            if j < n:
                left[j] = i
                if (r := ranks.get(data[i : end[j]])) is not None:
                    heapq.heappush(queue, (r, i, end[j]))
            if (k := left[i]) >= 0 and (r := ranks.get(data[k:j])) is not None:
                heapq.heappush(queue, (r, k, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def scan(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids, and for each pre-token where it starts, in characters, and how many ids stand before it."""
        pieces = self.find(text)
        packed = list(map(self.__getitem__, pieces))
        sizes = np.array([list(map(len, pieces)), [len(p) // 4 for p in packed]], np.int64).reshape(2, -1)
        return b"".join(packed), (np.cumsum(sizes, axis=1) - sizes).T.astype(np.int32)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I") if len(packed) else ()))


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def _vocabulary(df: DataFrame, path: str):
    """The rank file (of fixed size, under 1 MB) is read once, by the driver, and sent to the executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", chunk: int = 16_384, overlap: int = 256, decoded: str | None = None,
) -> DataFrame:
    """The columns of df without the text, and `ids` binary (little-endian unsigned 32-bit integers), `n_tokens` long.
    With decoded, the bytes of the ids come back in a column of that name, from the same pass over each piece."""
    vocabulary = _vocabulary(df, vocabulary_path)

    def both(e: Encoder, packed: list[bytes]) -> pd.DataFrame:
        back = [e.decode(p) if decoded else None for p in packed]
        return pd.DataFrame({"ids": pd.Series(packed, dtype=object), "back": pd.Series(back, dtype=object)})

    @F.pandas_udf("ids binary, back binary")
    def whole(texts: pd.Series) -> pd.DataFrame:
        e, out, last = encoder(vocabulary.value, pattern), [], None
        for t in texts:
            out.append(out[-1] if t == last else e.encode(t))
            last = t
        return both(e, out)

    @F.pandas_udf("ids binary, left binary, right binary")
    def scanned(texts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        """left, right: the boundaries in the overlaps with the chunks before and after, as the scan gives them."""
        e, rows = encoder(vocabulary.value, pattern), []
        for t, last in zip(texts, lasts, strict=True):
            ids, at = e.scan(t)
            sure = len(t) if last else len(t) - MARGIN
            rows.append((ids, at[at[:, 0] < overlap - MARGIN].tobytes(), at[(at[:, 0] >= chunk) & (at[:, 0] <= sure)].tobytes()))
        return pd.DataFrame(rows, columns=["ids", "left", "right"])

    @F.pandas_udf("ids binary, back binary")
    def stitched(ids: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        e, out = encoder(vocabulary.value, pattern), []
        for some, left, right in zip(ids, lefts, rights, strict=True):
            start, pieces = 0, []
            for k, packed in enumerate(some):
                if k + 1 == len(some):
                    pieces.append(packed[4 * start :])
                    break
                a, b = (np.frombuffer(x, np.int32).reshape(-1, 2) for x in (right[k], left[k + 1]))
                shared, i, j = np.intersect1d(a[:, 0] - chunk, b[:, 0], assume_unique=True, return_indices=True)
                if not len(shared):
                    parts = [e.decode(p).decode() for p in some]
                    pieces = [e.encode("".join([*(p[:chunk] for p in parts[:-1]), parts[-1]]))]
                    break
                pieces.append(packed[4 * start : 4 * int(a[i[0], 1])])
                start = int(b[j[0], 1])
            out.append(b"".join(pieces))
        return both(e, out)

    made = ["ids", "n_tokens", *([decoded] if decoded else [])]
    rows = packed_row(df.withColumn("_text_", F.coalesce(F.col(f"`{text}`"), F.lit(""))), ["_text_"], ["_text_", text, *made]).withColumnRenamed("__text_", "_text")
    rows = rows.withColumn("_n", F.length("_text"))
    short = rows.filter(F.col("_n") <= chunk).select("_row", whole("_text").alias("_out"))

    # Chunk k holds the characters from k * chunk on, and `overlap` more than its share.
    long = rows.filter(F.col("_n") > chunk).withColumn("_key", F.monotonically_increasing_id())
    chunks = (
        long.withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((_n - 1) DIV {chunk} AS INT)"))))
        .withColumn("_part", F.expr(f"substring(_text, _k * {chunk} + 1, {chunk + overlap})"))
        .withColumn("_last", F.expr(f"_k * {chunk} + {chunk + overlap} >= _n"))
        .select("_key", "_k", "_last", "_part", F.when(F.col("_k") == 0, F.col("_row")).alias("_row"))
        .repartition("_key", "_k")
        .select("_key", "_k", "_row", scanned("_part", "_last").alias("_s"))
    )
    joined = chunks.groupBy("_key").agg(F.max("_row").alias("_row"), F.sort_array(F.collect_list(F.struct("_k", "_s"))).alias("_all"))
    joined = joined.select("_row", stitched(*[F.expr(f"transform(_all, x -> x._s.{c})") for c in ("ids", "left", "right")]).alias("_out"))
    out = short.unionByName(joined).select("_row", "_out.ids", "_out.back")
    kept = [c for c in df.columns if c not in (text, *made)]
    back = [F.col("back").alias(decoded)] if decoded else []
    return out.select(*[F.col(f"_row.`{c}`") for c in kept], "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), *back)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out` binary: the bytes of the packed ids, one after the other. Null ids give null."""
    vocabulary = _vocabulary(df, vocabulary_path)

    @F.pandas_udf("binary")
    def unpack(packed: pd.Series) -> pd.Series:
        e = encoder(vocabulary.value, "x")
        return pd.Series([None if p is None else e.decode(p) for p in packed], dtype=object)

    return df.withColumn(out, unpack(F.col(f"`{ids}`")))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded, and decoded from the ids."""
    import public_tokenizers

    from fleetlens.llm.common import table

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
