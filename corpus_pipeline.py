"""The corpus pipeline: documents through five operators, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages but
the last return the columns of documents. A caller that runs stages one by one
writes each result as Parquet and reads it again as the next one's input, and so
does ``run``. SQL cannot express the stages, hence no oracle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quizlake.llm import bpe, mixing, ngram_join, pii, quality
from quizlake.llm.queries import MOST, SEED, SHARE, WEIGHTS, read_bytes
from quizlake.session import stage
from quizlake.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the rules or lose too much."""
    return quality.quality_filter(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, 5, (80, 100))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out to reach each source's target."""
    return mixing.mixed_documents(docs, WEIGHTS, SHARE, MOST, SEED)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, read_bytes("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("PII", redact_pii),
          ("mixing sources", mix_sources), ("byte-level BPE", byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
