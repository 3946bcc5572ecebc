"""A training-corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Language ID drops documents without a recognisable language, near-dedup keeps one document of each group, benchmark
decontamination drops documents that hold a benchmark window, the secret scan replaces secrets in the texts, and
byte-level BPE turns the texts into token ids. All stages but the last return the columns of documents. A stage is
written as Parquet and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.names import free_names
from sluice.llm import byte_bpe, contamination, language, near_dup, secret_scan
from sluice.llm.store import released, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; a missing lang becomes the prediction. Where no row has a lang to learn
    from, documents with a letter stay."""
    model = language.fit(docs.where(~language.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = free_names(docs.columns, "found", "score", "spans")
    found = language.label_languages(docs, model, names=names).where(F.col(names[0]) != "und")
    return found.withColumn("lang", F.coalesce("lang", names[0])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without secrets; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding the ids gives the text."""
    ranks = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("byte_bpe", tokenize)]
#: SQL cannot express a language model, min-max hashing, or ranked merges; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            released(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
