"""Personal data, and information-theoretic sanitisation of what gives it away.

Four kinds of entities are found by fixed patterns: email, ip, card, phone. Then the whole corpus tells which words
reveal an entity e, that is either one value (this address, this number) or a kind: over all documents, p(e) is the share that
holds it, p(t) the share that holds the word t outside entities, and p(t, e) the share that holds both, anywhere in the text.
The word's pointwise mutual information log2(p(t, e) / (p(t) p(e))), as a share of the entity's information -log2 p(e), is what
it discloses: 1 where the word never occurs without it. Words that disclose `DISCLOSED` or more of some entity are findings of
kind `term` wherever they stand outside entities, in every document, unless chance explains it: were the word's documents drawn at
random, so many would hold the entity with a probability of at most exp(-df(t) KL(p(e | t), p(e))), and that times the
number of pairs looked at must stay below `CHANCE`. `sanitise` generalises every finding to its kind.

Null and empty texts have no findings. Repeated rows count one by one. A column named `personal` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import spans
from fleetlens.llm.common import packed_row, staged, table

BASE = ["email", "ip", "card", "phone"]
DISCLOSED, CHANCE = 0.7, 0.01
BITS, ROWS, REMEMBERED = 1 << 22, 500, 200_000
_name = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"\w+")
_digits = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ leftwards to the first character that can't stand in a name, but not into the match before."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _name:
            start -= 1
        host = _host.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            least = host.end()
        at = text.find("@", max(at + 1, least))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def entities(text: str | None) -> list[spans.Span]:
    if not text:
        return []
    found: list[spans.Span] = [(a, 0, "email", b) for a, b in emails(text)] if "@" in text else []
    if _digits.search(text):
        if text.count(".") >= 3:
            found += [(m.start(), 1, "ip", m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            found += [(m.start(), 3, "phone", m.end()) for m in _phone.finditer(text) if 9 <= len(_digits.findall(m[0])) <= 15]
    return sorted(found)


def value(text: str, found: spans.Span) -> str:
    """The entity in one form, however it is written."""
    start, _, kind, end = found
    if kind == "email":
        return text[start:end].lower()
    if kind == "ip":
        return ".".join(p.lstrip("0") or "0" for p in text[start:end].split("."))
    return "".join(_digits.findall(text[start:end]))


def lowered(text: str) -> str:
    """In lower case, at unchanged places."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def outside(text: str, starts: list[int], ends: list[int]) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words that share no character with an entity; starts are sorted."""
    out, i, until = [], 0, -1
    for m in _word.finditer(lowered(text)):
        while i < len(starts) and starts[i] < m.end():
            until = max(until, ends[i])
            i += 1
        if until <= m.start():
            out.append((m[0], m.start(), m.end()))
    return out


def distinct_words(text: str | None, starts: list[int], ends: list[int]) -> list[str]:
    if not text:
        return []
    return list({w for w, _, _ in outside(text, starts, ends)} if len(starts) else set(_word.findall(lowered(text))))


def bitmap(terms: DataFrame) -> bytes:
    """One byte for each of `BITS` hash values: whether a term has it. Of a fixed size, whatever the number of terms."""
    bit = F.crc32("_term").bitwiseAND(BITS - 1)
    words = terms.select(bit.alias("_b")).groupBy(F.expr("_b DIV 32").alias("_i")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b % 32 AS INT)))").alias("_w")).collect()
    out = bytearray(BITS)
    for r in words:
        for k in range(32):
            out[r["_i"] * 32 + k] = r["_w"] >> k & 1
    return bytes(out)


def occurrences(df: DataFrame, text: str, terms: DataFrame, places: bool) -> DataFrame:
    """Of the words outside entities that are among terms (distinct, `_term`): in how many rows each stands
    (_term, _dt); or for each row and term its places (_h, _term, _at: starts, packed)."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap(terms))  # BITS bytes

    def packed(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["_term", "_n"])

    def counted(batches):
        bits, counts = sent.value, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), ([], [], [])
                for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not t or not any(bits[crc32(w.encode()) & BITS - 1] for w in set(_word.findall(lowered(t)))):
                        continue
                    found = sorted(entities(t))
                    starts, ends = [s[0] for s in found], [s[3] for s in found]
                    if not places:
                        counts.update(w for w in distinct_words(t, starts, ends) if bits[crc32(w.encode()) & BITS - 1])
                        continue
                    where: dict[str, list[int]] = {}
                    for w, a, _ in outside(t, starts, ends):
                        if bits[crc32(w.encode()) & BITS - 1]:
                            where.setdefault(w, []).append(a)
                    for w, starts_of in where.items():
                        for c, x in zip(out, (h, w, starts_of), strict=True):
                            c.append(x)
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32()))], ["_h", "_term", "_at"])
                elif len(counts) > REMEMBERED:
                    yield packed(counts)
                    counts.clear()
        if counts:
            yield packed(counts)

    texts = df.select(digest(text).alias("_h"), F.col(f"`{text}`").alias("_text"))
    if places:
        return texts.mapInArrow(counted, "_h binary, _term string, _at array<int>").join(terms, "_term")
    return texts.mapInArrow(counted, "_term string, _n long").groupBy("_term").agg(F.sum("_n").alias("_dt")).join(terms, "_term")


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(f"`{text}`"), 256))


def detect(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with `personal`: struct of kinds, starts and ends, entities and terms. keep_text=False leaves the text out."""
    made = ["personal", *([] if keep_text else [text])]

    @F.pandas_udf(spans.TYPE + ", held array<string>, words array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        each = [sorted(entities(t)) for t in texts]
        out = spans.columns(each)
        out["held"] = [sorted({f"{s[2]}:{value(t, s)}" for s in f} | {s[2] for s in f}) for t, f in zip(texts, each, strict=True)]
        out["words"] = [distinct_words(t, a, b) if a else [] for t, a, b in zip(texts, out["starts"], out["ends"], strict=True)]
        return pd.DataFrame(out)

    rows = packed_row(df.withColumn("_text_", F.col(f"`{text}`")), ["_text_"], ["_text_", *made])
    rows = rows.select("_row", digest("__text_").alias("_h"), found("__text_").alias("_f"))
    plain = F.struct(*[F.col(f"_f.{c}").alias(c) for c in ("kinds", "starts", "ends")])
    rows = rows.select("_row", "_h", plain.alias("_f"), F.transform("_f.held", lambda h: F.xxhash64(h)).alias("_held"), F.col("_f.words").alias("_words"))
    rows = staged(rows.withColumn("_key", F.monotonically_increasing_id()), "pii")

    n, pairs = rows.agg(F.count("*"), F.sum(F.size("_held").cast("long") * F.size("_words"))).first()
    bar, n = math.log(max(pairs or 0, 1) / CHANCE), float(max(n, 1))

    # A pair in k documents is at most as sure as k ln(n / _de), so the two filters by the bar lose nothing.
    held = rows.select("_key", F.explode("_held").alias("_e"))
    known = held.groupBy("_e").agg(F.count("*").alias("_de")).filter((F.col("_de") < n) & (F.col("_de") * F.log(n / F.col("_de")) >= bar))
    near = held.join(known, "_e").join(rows.filter(F.size("_held") > 0).select("_key", "_words"), "_key")
    both = near.select("_e", "_de", F.explode("_words").alias("_term")).groupBy("_term", "_e", "_de").agg(F.count("*").alias("_dte"))
    both = staged(both.filter(F.col("_dte") * F.log(n / F.col("_de")) >= bar), "pii_pairs")
    holds = occurrences(df, text, both.select("_term").distinct(), False)
    p, q = F.col("_de") / n, F.col("_dte") / F.col("_dt")
    sure = F.col("_dt") * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    revealing = both.join(holds, "_term").filter((F.log(q / p) >= -F.log(p) * DISCLOSED) & (sure >= bar))
    # Written, so that their size decides how they are joined.
    revealing = staged(revealing.select("_term").distinct(), "pii_terms")
    hits = occurrences(df, text, revealing, True).dropDuplicates(["_h", "_term"])  # equal texts have equal places
    hits = staged(hits.groupBy("_h").agg(F.collect_list(F.struct("_at", F.length("_term").alias("_n"))).alias("_t")), "pii_hits")

    entity = F.transform(F.arrays_zip("_f.starts", "_f.kinds", "_f.ends"), lambda x: F.struct(x["starts"].alias("s"), F.array_position(F.array(*map(F.lit, BASE)), x["kinds"]).cast("int").alias("o"), x["kinds"].alias("k"), x["ends"].alias("e")))
    term = F.flatten(F.transform("_t", lambda t: F.transform(t["_at"], lambda a: F.struct(a.alias("s"), F.lit(9).alias("o"), F.lit("term").alias("k"), (a + t["_n"]).alias("e")))))
    term = F.coalesce(term, F.array().cast("array<struct<s:int,o:int,k:string,e:int>>"))
    out = rows.select("_h", "_row", "_f").join(hits, "_h", "left").withColumn("_all", F.sort_array(F.concat(entity, term)))
    fields = [F.expr(f"transform(_all, x -> x.{f})").alias(n) for f, n in (("k", "kinds"), ("s", "starts"), ("e", "ends"))]
    return out.select(*[F.col(f"_row.`{c}`") for c in df.columns if c not in made], F.struct(*fields).alias("personal"))


def sanitise(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every finding generalised to its kind in angle brackets, and `personal`, the findings."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
        return pd.Series([t if not t else spans.replaced(t, list(k), list(a), list(b)) for t, k, a, b in zip(texts, found["kinds"], found["starts"], found["ends"], strict=True)], dtype=object)

    return detect(df, text).withColumn(text, replaced(F.col(f"`{text}`"), F.col("personal")))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Findings in every whole text of documents."""
    rows = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [spans.count("personal", k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(spans.joined("personal", BASE), 256).alias("base_sha256"), spans.joined("personal").alias("spans"))
