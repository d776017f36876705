"""A training corpus from raw documents, stage by stage.

Each stage works on what the one before kept, through the operators of
``arbora.llm``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, decontaminate, language_id, near_dedup, toxicity
from arbora.llm.common import free_name, table
from arbora.llm.queries import WORD_BPE, vocabulary
from arbora.session import materialize

# A text is toxic from this score on.
TOXIC = 0.5
# Text that costs more bits per byte under every learnt language is in none of them.
MOST_BITS = 6.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the string-kernel machine calls toxic; it learns from all labelled documents."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"), "toxic")
    labelled = docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("labelled_id"))
    score = free_name(docs, "toxicity_score")
    kept = toxicity.score(docs, toxicity.train(labelled), name=score).filter(F.col(score) < TOXIC)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter and those that no learnt language explains."""
    prefix = free_name(docs, "found_")
    found = language_id.identify(docs, language_id.train(docs), prefix=prefix)
    bits = F.col(f"{prefix}bits") / F.greatest(F.octet_length("text"), F.lit(1))
    known = (F.col(f"{prefix}pred") != language_id.UNKNOWN) & (bits <= MOST_BITS)
    return found.filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a copy of a benchmark item."""
    leaks = free_name(docs, "leaks_found")
    flagged = decontaminate.flag(docs, table(spark, sf_dir, "benchmark"), name=leaks)
    return flagged.filter(F.size(leaks) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number, and digests of ids and decoded text."""
    path = vocabulary(WORD_BPE)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_foreign),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

# Trained models and hashes decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name).df
    return docs
