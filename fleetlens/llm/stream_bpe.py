"""BPE encoding and decoding as streaming transducers, by a tokenizer file of byte-level merges.

A text goes through in blocks. The splitter gives pre-tokens by the classes of neighbouring characters and keeps back what the next
block can still change. Pre-tokens are merged at once; one that outgrows a block goes on into a merger that keeps a window of bytes:
its tokens are emitted once they are stable, that is, once they end at least the sufficient lookahead before the window's end.

The lookahead comes from the merge list. Let two texts share their first bytes up to some place. While the merges are applied in order,
the end of their shared tokens moves left only if a merge (u, v) takes u before that end and v after it in one of them, and then by
u's length. The next merge to move it must come later in the list, and its right part, which stands where u stood, begins with u.
So the end moves at most by the largest sum of left parts over such chains; it is found by one pass over the merges.

Decoding maps ids to bytes and bytes to text by an incremental UTF-8 machine: a sequence that ends with a block is kept for
the next one, and each maximal malformed one gives one replacement character.

Null texts count as empty and give no ids; null ids give null. Special tokens of the file are found in texts first, as the
library does. Ids that no token has are skipped when decoding. Repeated rows are encoded one by one; short
pre-tokens are remembered. A column named like a result is replaced.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Characters before and after a place that decide whether a pre-token starts there: the longest contraction has three.
MARGIN = 4
KEPT_PIECES, KEPT_LENGTH = 300_000, 48
#: Rows whose results stand in memory at once.
ROWS = 256
NONE = 1 << 62
OTHER, LETTER, NUMBER, SPACE = range(4)
# White space of the pre-tokenizer's pattern, its contractions, and letters and numbers that Unicode 16 added.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[SPACES] = SPACE
    return out


def starts(text: str, edges: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start in texts that stand one after the other; edges has each text's start, and the end of all."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
    after_blank = np.concatenate([[False], code[:-1] == 0x20])
    last = ~edge[1:] & (np.concatenate([kind[1:], [SPACE]]) != SPACE)  # what follows is in the same text and no space
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | last, np.where(before == SPACE, ~after_blank, before != kind)) | edge[:-1]
    for i in np.flatnonzero((code == 0x27) & (edge[:-1] | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & ~after_blank))).tolist():
        for c in CONTRACTIONS:
            if text.startswith(c, i + 1) and not edge[i + 1 : i + 1 + len(c)].any():
                start[i + 1 : i + 1 + len(c)] = False
                if i + 1 + len(c) < n:
                    start[i + 1 + len(c)] = True
                break
    return np.flatnonzero(start)


class Merges(dict):
    """From a pre-token to its ids, as bytes of little-endian 32-bit integers; remembers short pre-tokens."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level tokenizer file")
        # the printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        vocab = model["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        byte = {b: vocab.get(c) for c, b in chars.items()}
        if None in byte.values():
            raise ValueError("the vocabulary lacks a byte")
        self.byte = [byte[b] for b in range(256)]
        self.rank: dict[int, int] = {}  # by the two ids, as the halves of a number
        self.made: list[int] = []  # by rank
        made, parts = set(self.byte), []
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in made or v not in made:
                raise ValueError("a merge uses a token before it is made")
            made.add(w)
            self.rank.setdefault(u << 32 | v, k)
            self.made.append(w)
            parts.append((self.tokens[u], self.tokens[v]))
        self.lookahead = lookahead(parts)
        self.window = 2 * self.lookahead + 256

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) < self.window:
            ids = self.merge(data)
        else:
            m = Merger(self)
            ids = m.feed(data) + m.close()
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, data: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until no pair is in the list."""
        ids, find, made = [self.byte[b] for b in data], self.rank.get, self.made
        ranks = [find(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = find(ids[i] << 32 | ids[i + 1], NONE)
        return ids


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token can't change any more: the largest sum of left parts over chains of merges, each later than the one
    before it and with a right part that begins with that one's left part."""
    best: dict[bytes, int] = {}
    for left, right in merges:
        chain = len(left) + max((best.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        best[left] = max(best.get(left, 0), chain)
    return max(best.values(), default=0)


class Merger:
    """Merges the bytes of one pre-token as they come; holds a window at most."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        m, out = self.merges, []
        for at in range(0, len(data), m.window):
            self.held += data[at : at + m.window]
            if len(self.held) >= m.window:
                stable, end = len(self.held) - m.lookahead, 0
                for i in m.merge(self.held):
                    if end + len(m.tokens[i]) > stable:
                        break
                    end += len(m.tokens[i])
                    out.append(i)
                self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Encoder:
    """One text, block by block: feed gives the packed ids that are stable, close the rest."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.open, self.past, self.text = merges, None, "", ""
        names = sorted(merges.special, key=len, reverse=True)
        self.find = re.compile("|".join(map(re.escape, names))).search if names else lambda text: None
        self.keep = max([MARGIN, *(len(n) - 1 for n in names)])

    def feed(self, block: str) -> bytes:
        self.text += block
        out = []
        while found := self.find(self.text):
            rest = self.text[found.end() :]
            self.text = self.text[: found.start()]
            out += [self._cut(0, True), np.array([self.merges.special[found[0]]], "<i4").tobytes()]
            self.text, self.past = rest, ""
        out.append(self._cut(self.keep, False))
        return b"".join(out)

    def close(self) -> bytes:
        return self._cut(0, True)

    def _cut(self, keep: int, ends: bool) -> bytes:
        """Emits the pre-tokens that are whole; with ends, all. A piece that has grown over a block goes to a merger."""
        m, out = self.merges, []
        text, lead = self.past + self.text, len(self.past)
        at = starts(text, np.array([0, len(text)])) if text else np.empty(0, int)
        first = [lead] if self.open is None and len(text) > lead else []  # what stands before was emitted: here a pre-token goes on or starts
        at = [*first, *at[(at > lead if first else at >= lead) & (at < len(text) - keep)].tolist()]
        if self.open is not None and (at or ends):
            upto = at[0] if at else len(text)
            out.append(np.array(self.open.feed(text[lead:upto].encode()) + self.open.close(), "<i4").tobytes())
            self.open, lead = None, upto
        if ends:
            at.append(len(text))
        out += [m[text[a:b]] for a, b in zip(at, at[1:])]
        lead = at[-1] if at else lead
        if not ends and (self.open is not None or len(text) - lead > BLOCK):
            sure = max(lead, len(text) - keep)
            self.open = self.open or Merger(m)
            out.append(np.array(self.open.feed(text[lead:sure].encode()), "<i4").tobytes())
            lead = sure
        self.past, self.text = text[max(0, lead - MARGIN) : lead], text[lead:]
        if ends:
            self.past = self.text = ""
        return b"".join(out)


class Decoder:
    """Ids to text, as they come."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join([self.tokens.get(i, b"") for i in ids]))

    def close(self) -> str:
        return self.machine.decode(b"", True)


def encode_text(m: Merges, text: str) -> bytes:
    e = Encoder(m)
    return b"".join([*[e.feed(text[i : i + BLOCK]) for i in range(0, len(text), BLOCK)], e.close()])


def encode_texts(m: Merges, texts: Iterable[str]) -> Iterator[bytes]:
    """The packed ids of each text. Short texts without special tokens go through the splitter together, long ones as streams."""
    group: list[str] = []
    special = re.compile("|".join(map(re.escape, m.special))).search if m.special else lambda text: None

    def flush() -> Iterator[bytes]:
        text, edges = "".join(group), np.cumsum([0, *map(len, group)])
        at = starts(text, edges) if text else np.empty(0, int)
        packed = [m[text[a:b]] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(text)])]
        cuts = np.searchsorted(at, edges).tolist()
        yield from (b"".join(packed[a:b]) for a, b in zip(cuts, cuts[1:]))
        group.clear()

    size = 0
    for text in texts:
        if len(text) > BLOCK or special(text):
            yield from flush()
            size = 0
            yield encode_text(m, text)
            continue
        group.append(text)
        size += len(text)
        if size > BLOCK:
            yield from flush()
            size = 0
    yield from flush()


def decode_ids(m: Merges, ids: np.ndarray) -> str:
    d = Decoder(m.tokens)
    return "".join([*[d.feed(ids[i : i + BLOCK].tolist()) for i in range(0, len(ids), BLOCK)], d.close()])


@lru_cache(maxsize=2)
def merges(file: bytes) -> Merges:
    return Merges(file)


def _file(df: DataFrame, path: str):
    """The tokenizer file (of fixed size, a few MB) is read once, by the driver, and sent to the executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """df with `ids` array<int> and `n_tokens` long; with decoded, also the text of the ids in a column of that name."""
    file = _file(df, path)

    @F.pandas_udf("ids array<int>, back string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = merges(file.value)
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                ids = [np.frombuffer(p, "<i4") for p in encode_texts(m, (t or "" for t in texts.iloc[at : at + ROWS]))]
                back = [decode_ids(m, i) if decoded else None for i in ids]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "back": pd.Series(back, dtype=object)})

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("ids", "n_tokens", decoded)]
    out = df.select(*kept, run(F.col(f"`{text}`")).alias("_out"))
    back = [F.col("_out.back").alias(decoded)] if decoded else []
    return out.select(*kept, F.col("_out.ids").alias("ids"), F.size("_out.ids").cast("long").alias("n_tokens"), *back)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the ids."""
    file = _file(df, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merges(file.value)
        for rows in batches:
            for at in range(0, len(rows), ROWS):
                yield pd.Series([None if r is None else decode_ids(m, np.asarray(r)) for r in rows.iloc[at : at + ROWS]], dtype=object)

    return df.withColumn(out, run(F.col(f"`{ids}`")))


def op11_stream_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded, and decoded from the ids."""
    import public_tokenizers

    from fleetlens.llm.common import table

    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", "n_tokens", F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
