"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words: its share by weight, held under `limit` times the source's own size, the
excess dealt out again by weight. A source gives all its documents as often as its target holds it whole (complete
epochs); what is left of the target is filled by documents in the order of exponential keys -ln(u) / quality, whose
u comes from a hash of the document's id: without replacement, a document of twice the quality is twice as likely to be
next. The last document is taken if that brings the source nearer to its target.

A source's documents are summed by ranges of their keys first; only the range in which the target is reached is put in
order, and its last document taken is all that is known of the choice: the documents themselves are never moved or sorted.
Targets are computed on a table of one row per source, the ranges on one of a bounded number of rows per source, so sources are
taken to be far fewer than documents.

Null sources are one source, ordered last. Null sizes count as 0, null or unknown qualities as 1. Rows that repeat an
id share a key and go by a hash of their columns; rows equal in that as well are taken together. A column named like a
result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, packed_row, parts, staged, table, unstage

MADE = ["source_size", "target", "taken"]


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(_none, _src, _total), one row per source, with _target. The weights repeat over the sources in code-point
    order. The level at which sum(min(cap, level * weight)) meets the sum to share is the greatest of the levels that
    each number of capped sources would give, the sources being capped in the order of cap / weight."""
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy("_none", "_src")))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.get(kinds, (F.col("_rank") - 1) % len(weights))).withColumn("_cap", F.col("_total") * limit)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    levels = (
        ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("_total").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") * share - F.col("_before")) / F.col("_open"))
        .withColumn("_top", F.max("_level").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return levels.select("_none", "_src", "_total", F.least("_cap", F.col("_top") * F.col("_weight")).alias("_target"))


def mix(
    df: DataFrame, size: str = "size", source: str = "source", id: str = "doc_id", quality: str | None = None, tie: str | None = None,
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 17,
) -> DataFrame:
    """df with source_size long, target double and taken long: how many words of the document the mix takes, a
    multiple of its size. quality: a column of positive weights. tie: a column that orders rows of one id (a hash of all columns
    that can be hashed, if there is none)."""
    ranges = 4 * parts(df.sparkSession)
    used = [size, source, id, *([quality] if quality else []), *([tie] if tie else [])]
    hashed = F.col(f"`{tie}`") if tie else F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    rows = packed_row(df.withColumn("_tie_", hashed), [*used, "_tie_"], [*MADE, "_tie_"])
    weight = F.coalesce(F.when(F.col(f"_{quality}") > 0, F.col(f"_{quality}").cast("double")), F.lit(1.0)) if quality else F.lit(1.0)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(f"_{id}"), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rows = rows.select(
        "_row", F.col(f"_{source}").isNull().alias("_none"), F.coalesce(F.col(f"_{source}"), F.lit("")).alias("_src"),
        F.coalesce(F.col(f"_{size}"), F.lit(0)).cast("long").alias("_size"), (-F.log(uniform) / weight).alias("_key"), F.col("__tie_").alias("_tie"),
    )
    rows = rows.withColumn("_range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("_key"))) * ranges)).cast("int"))
    part = ["_none", "_src", "_range"]
    slim = staged(rows.groupBy(*part, "_key", "_tie").agg(F.sum("_size").alias("_size")), "mix")
    sums = slim.groupBy(*part).agg(F.sum("_size").alias("_sum"))
    wanted = targets(sums.groupBy("_none", "_src").agg(F.sum("_sum").alias("_total")), weights, share, limit)
    epochs = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0)
    wanted = wanted.withColumn("_epochs", epochs).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_total"))
    earlier = Window.partitionBy("_none", "_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(wanted, ["_none", "_src"])
    reached = offsets.filter((F.col("_offset") <= F.col("_rest")) & (F.col("_rest") < F.col("_offset") + F.col("_sum"))).select(*part, "_offset", "_rest")
    within = Window.partitionBy("_none", "_src").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.join(reached, part).withColumn("_left", F.col("_rest") - F.col("_offset") - F.coalesce(F.sum("_size").over(within), F.lit(0)))
    last = placed.groupBy(*part).agg(F.max(F.when(F.col("_left") >= F.col("_size") / 2, F.struct("_key", "_tie"))).alias("_cut"))
    # one row for each source, written so that Spark knows its size when it chooses how to join it
    cuts = staged(wanted.join(last.withColumnRenamed("_range", "_at"), ["_none", "_src"], "left"), "mix_cuts")
    unstage(slim)
    place = F.struct("_key", "_tie")
    extra = F.coalesce((F.col("_range") < F.col("_at")) | ((F.col("_range") == F.col("_at")) & (place <= F.col("_cut"))), F.lit(False)).cast("long")
    return rows.join(cuts, ["_none", "_src"]).select(
        *[F.col(f"_row.`{c}`") for c in df.columns if c not in MADE],
        F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * (F.col("_epochs") + extra)).cast("long").alias("taken"),
    )


def with_quality(df: DataFrame, labels: DataFrame, id: str = "doc_id", good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """df with mix_quality: good or bad where labels (doc_id, quality 0/1) judge the document, else 1. Contradicting
    labels count as bad."""
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_judged")).agg(F.min("quality").alias("_quality"))
    joined = df.join(judged, F.col(id) == F.col("_judged"), "left")
    return joined.withColumn("mix_quality", F.when(F.col("_quality") == 1, good).when(F.col("_quality") == 0, bad).otherwise(1.0)).drop("_judged", "_quality")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 5, 2, 1, 150 % of all words, no more than twice a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size"))
    rated = staged(with_quality(docs, table(spark, sf_dir, "labels")), "mix_sizes")  # so that the words are counted once
    return mix(rated, quality="mix_quality").select("doc_id", "size", "source_size", "target", "taken")
