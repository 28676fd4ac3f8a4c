"""From raw documents to encoded training data, in five stages. Each keeps the columns of documents but for the last.

toxicity: documents scored 0.5 or more go. near_duplicates: five-word shingles, similarity 0.8 or more; the least
doc_id of each class stays. secrets: what the scan finds is replaced by its kind. mix: weights 5, 2, 1 over the sources, 150 %
of all words, twice a source at most; a document that the mix takes twice stands twice, one that it doesn't take goes.
encode: ids of the byte-level vocabulary.

The executors' JVM and Python workers live through all stages and keep the memory that any of them took. So a session that
runs a stage hands texts to its workers in batches of 2 MB instead of 64.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe, jaccard_join, secret_scan, source_mix, toxicity
from fleetlens.llm.common import BATCH, BATCH_BYTES, likely, staged, table, unstage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """Stays set in the session, as a stage's rows are made after it returns; fewer bytes, given as a number, are kept."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark.conf.get(BATCH).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels of the kept documents; null and empty texts stay."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.lit(True))
    return toxicity.score(docs, model, out="_toxic_score").filter("_toxic_score < 0.5").select(*COLUMNS)


@_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that of the least doc_id; rows with a null doc_id are members of their class and stay only
    where it has no other. Null texts and texts without words are no duplicates."""
    return jaccard_join.first_of_class(docs.select(*COLUMNS), width=5, percent=80)


@_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; null texts stay null."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words go; null sources are one source. Copies of a document stand next to each other."""
    labels = table(spark, sf_dir, "labels")
    # only the texts of documents that have a label move to it
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    marked = likely(docs.select(*COLUMNS), hashed, labels.filter("doc_id IS NOT NULL").select(hashed.alias("_h")), "_h")
    judged, rest = (marked.filter(which).select(*COLUMNS, source_mix.words().alias("_words"), F.xxhash64("doc_id", "text").alias("_tie")) for which in ("_likely", "NOT _likely"))
    rated = source_mix.with_quality(judged, labels).unionByName(rest.withColumn("mix_quality", F.lit(1.0)))
    mixed = source_mix.mix(rated, size="_words", quality="mix_quality", tie="_tie")
    times = F.when(F.col("_words") > 0, F.expr("CAST(taken DIV _words AS INT)")).otherwise(0)
    return mixed.withColumn("_times", times).filter("_times > 0").select(*COLUMNS, F.explode(F.expr("sequence(1, _times)")).alias("_copy")).select(*COLUMNS)


@_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (packed little-endian unsigned 32-bit integers); null texts have no ids."""
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("encode", encode),
]
#: Learned scores, hashed signatures and hashed keys have no form in SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
