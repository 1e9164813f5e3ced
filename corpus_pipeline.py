"""From raw documents to token ids: five stages, each a table of its own in the shared folder.

Cases, by stage.  Null, empty and wordless texts fail the base rules of ``quality_rules`` and
so never reach a later stage; a text that ``line_dedup`` empties stays as an empty text, is
linked with nothing, holds no benchmark item and gives no ids.  Repeated rows of one id are
one document for counts and links: they stay or go together, and come back as often as they
came.  Rows without an id do not count as documents of a line and are never removed as
copies or as contaminated.  Extra columns pass all stages but the last, whatever their
names; the last returns its own.  No documents give no rows; no benchmark removes nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import bpe, decontam, linededup, neardup, quality
from palisade.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and with them documents that lose too much or fail the base rules."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go from all of them."""
    return linededup.filter_lines(docs, min_documents=10, min_key_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, similarity 0.8."""
    return neardup.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids of what is left."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# MinHash banding, template windows and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
