"""Document fingerprints by consistent weighted sampling, in column expressions only.

A document's terms are its shingles of `WIDTH` words (lower case), each weighted by how often it occurs; a text of fewer
words is one term. The axis of a term's weight is cut into unit cells; the document fills as many as the term's weight.
Each cell falls by its hash into one of `SAMPLES` bins, so that weight is spread over the bins evenly, and there makes one
consistent weighted sample: its hash gives it one of `DRAWS` fixed draws, r and c from Gamma(2, 1) and b uniform; weight S
lies at t = floor(ln S / r + b) and ranks at ln a = ln c - r * (t - b + 1), where t is 0 for the unit weight of a cell;
equal ranks go by further bits of the hash. A bin's sample is the cell of the lowest rank. Two documents have the same
sample in a bin with probability sum(min(S, S')) / sum(max(S, S')), the generalised Jaccard similarity, so the share
of equal samples estimates it. A bin without cells borrows from the first filled bin of its own fixed order of bins,
which keeps that probability.

Null and word-less texts have the empty fingerprint: likeness 1 to each other, 0 to any other. Equal texts have
equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import longs, parts, range_bucket, splitters, table

WIDTH, SAMPLES, DRAWS = 5, 128, 1024
#: A sample is packed as bin (above bit 55), rank (31 bits), identity (24 bits), so that sorting puts each bin's lowest rank first.
KEPT, LOW, BINS = 2**24 - 1, 2**55 - 1, (SAMPLES - 1) << 55
#: Ranks are kept to 1 / SCALE, from -SHIFT up.
SHIFT, SCALE = 60, 2**24


def let(value: str, name: str, body: str) -> str:
    """SQL text that computes value once and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _draws() -> list[tuple[float, float, float]]:
    """r, ln c and b of each draw; a sum of two exponential variates is one from Gamma(2, 1)."""
    out = []
    for k in range(DRAWS):
        h = hashlib.sha256(b"draw %d" % k).digest()
        u = [(int.from_bytes(h[6 * i : 6 * i + 6], "big") + 0.5) / 2**48 for i in range(5)]
        out.append((-math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3])), u[4]))
    return out


def _constant(values: list, kind: str) -> str:
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS ARRAY<{kind}>)"


def samples(text: str) -> Column:
    """Of the named text column: array<bigint> of `SAMPLES` identities, or an empty array for a text without words.

    Texts without a repeated term need no weights."""
    rank = _constant([int((c - r * (1 - b) + SHIFT) * SCALE) << 24 for r, c, b in _draws()], "BIGINT")
    # The low bits of a cell choose its draw and are its identity; the bits above 55 are its bin.
    sample = f"(x & {BINS | KEPT}) | get({rank}, CAST(x & {DRAWS - 1} AS INT))"
    hashes = "transform(filter(split(lower(v), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"
    terms = (
        f"IF(size(h) >= {WIDTH}, transform(sequence(0, size(h) - {WIDTH}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WIDTH))})), "
        "IF(size(h) = 0, CAST(array() AS ARRAY<BIGINT>), array(xxhash64(h))))"
    )
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[greatest(i - 1, 0)])"
    weight = "coalesce(get(f, j + 1), size(s)) - i"
    cells = let("sort_array(e)", "s", let(starts, "f", f"flatten(transform(f, (i, j) -> transform(sequence(1, {weight}), o -> IF(o = 1, s[i], xxhash64(s[i], o)))))"))
    drawn = f"transform({let('array_distinct(e)', 'u', f'IF(size(u) = size(e), u, {cells})')}, x -> {sample})"
    empties = _constant([(b << 55) | LOW for b in range(SAMPLES)], "BIGINT")
    ranked = let(f"sort_array(concat({drawn}, {empties}))", "p", let(f"concat(array({2**62}L), p)", "q", f"filter(p, (x, i) -> (x ^ q[i]) >= {2**55}L)"))
    others = [f"get(filter(transform({_constant(list(range(a, z)), 'INT')}, k -> m[(b + k * o) % {SAMPLES}]), y -> (y & {LOW}) <> {LOW}), 0)" for a, z in ((1, 5), (5, 21), (21, SAMPLES))]
    borrowed = let(f"2 * CAST(xxhash64(b) & {SAMPLES // 2 - 1} AS INT) + 1", "o", f"coalesce({', '.join(others)})")
    filled = f"transform(m, (x, b) -> IF((x & {LOW}) = {LOW}, {borrowed}, x) & {KEPT})"
    body = let(hashes, "h", let(terms, "e", f"IF(size(e) = 0, CAST(array() AS ARRAY<BIGINT>), {let(ranked, 'm', filled)})"))
    return F.expr(let(f"coalesce(`{text}`, '')", "v", body))


def as_text(drawn: str) -> Column:
    """The samples as lower-case hexadecimal digits, six for each."""
    return F.expr(f"array_join(transform(`{drawn}`, x -> lower(substring(hex(x | {KEPT + 1}), 2))), '')")


def likeness(a: str, b: str) -> Column:
    """The share of equal samples."""
    same = f"size(filter(zip_with(`{a}`, `{b}`, (x, y) -> x = y), e -> e)) / {float(SAMPLES)}D"
    return F.expr(f"CASE WHEN size(`{a}`) = 0 AND size(`{b}`) = 0 THEN 1.0D WHEN size(`{a}`) = 0 OR size(`{b}`) = 0 THEN 0.0D ELSE {same} END")


def with_next(df: DataFrame, id: str, carried: list[str]) -> DataFrame:
    """df with next_<c> for each carried column: its value in the row that follows in ascending order of the id
    (nulls first; rows that repeat an id by their carried values), after the last that of the first. The ids are cut
    into ranges; each range is one window, and the first row of a range is also dealt, as a guest, to the range before."""
    cuts = splitters(df, id, 4 * parts(df.sparkSession))
    rows = df.withColumn("_range", range_bucket(id, cuts))
    # one row for each of a bounded number of ranges
    heads = sorted((r["_range"], None if r["_nulls"] else r["_least"]) for r in rows.groupBy("_range").agg(F.min(id).alias("_least"), F.count_if(F.col(id).isNull()).alias("_nulls")).collect())
    if not heads:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    head: list[int | None] = [None] * (len(cuts) + 1)
    before: list[int | None] = [None] * (len(cuts) + 1)
    for k, (r, least) in enumerate(heads):
        head[r], before[r] = least, heads[k - 1][0]
    rows = rows.withColumn("_first", F.expr(f"`{id}` <=> get({longs(head)}, _range)")).withColumn("_before", F.expr(f"get({longs(before)}, _range)").cast("int"))
    dealt = rows.select(*df.columns, F.posexplode(F.when(F.col("_first"), F.array("_range", "_before")).otherwise(F.array("_range"))).alias("_guest", "_in"))
    order = Window.partitionBy("_in").orderBy("_guest", F.col(id).asc_nulls_first(), *carried)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter("_guest = 0").drop("_guest", "_in")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with `out`, the text's fingerprint; a column of that name is replaced."""
    return df.withColumn("_samples_", samples(text)).withColumn(out, as_text("_samples_")).drop("_samples_")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("drawn", samples("text")), "doc_id", ["text", "drawn"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("CAST(n_chars DIV 2 AS INT)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - half), substring(next_text, 1, half))"))
    rows = rows.withColumn("edited_drawn", samples("edited"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("drawn").alias("fingerprint"),
        as_text("edited_drawn").alias("edited_fingerprint"), likeness("drawn", "edited_drawn").alias("near_edited"),
        likeness("drawn", "next_drawn").alias("near_next"),
    )
