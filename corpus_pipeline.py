"""From raw documents to token digests: language, toxicity, near-duplicates, source mixture, byte-level BPE.

STAGES are applied in order. Each gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import byte_bpe, language_id, minhash_dedup, mixing, toxicity
from tracemill.llm.common import id_remainder, table
from tracemill.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and texts between two codewords."""
    model = language_id.fit_sample(docs, id_remainder("doc_id", 3) != 1)
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model predicts to be toxic."""
    model = toxicity.fit_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), id_remainder("doc_id", 4) != 2)
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), model, with_spans=False)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of texts linked at a 5-word Jaccard similarity of 0.8 or more; SimHash and MinHash give the candidates."""
    return minhash_dedup.keep_one(docs.select(*COLUMNS))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: up to two times, or not at all."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and both digests of every row."""
    tokens = byte_bpe.tokenize(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", detect_language),
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_to_targets),
    ("byte_bpe", encode),
]

# Learned models and 64-bit fingerprints have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
