"""From raw documents to token ids: quality, near-duplicates, secrets, mixing, encoding. Each stage works on what the one before kept.

Null texts count as empty ones, texts of any length are treated whole, an empty table gives none, and columns beside ``doc_id`` and
``text`` stay as they are, whatever their names; rows that share an id are each treated by their own text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm.bpe import encode
from pagelattice.llm.common import stash, table
from pagelattice.llm.mixing import resampled
from pagelattice.llm.near_dedup import one_of_each
from pagelattice.llm.quality import good
from pagelattice.llm.secrets import redacted


def thin(spark: SparkSession) -> None:
    """Whole texts go to Python in smaller batches than the default of 10,000 rows: less memory in executors and workers alike."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(size)) not in range(1, 2001):
        spark.conf.set(size, "2000")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is below the threshold go."""
    thin(spark)
    return good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.
    Of rows that share an id, each is judged by its own text."""
    thin(spark)
    return one_of_each(docs, width=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the rates say that bring the expected words of the domains to their targets: plain ones stay."""
    thin(spark)
    return resampled(docs, table(spark, sf_dir, "labels"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again as a check."""
    thin(spark)
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("encode", encode_stage)]
#: SQL can't train a network; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
