"""A corpus pipeline over `documents`: quality, near copies, benchmark leaks, secrets, then token ids.

Every stage takes null ids, null and empty texts, repeated rows, further columns and an empty table: nulls count as empty
texts, rows stay apart whatever their ids (near_copies: rows of one id stay or go together), further columns come along
but in the last stage, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import read, written
from tessella.llm.decontaminate import decontaminate
from tessella.llm.pieces import encode_documents
from tessella.llm.quality import classify, trained
from tessella.llm.secrets import redact_documents
from tessella.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, trained(docs, read(spark, sf_dir, "labels")), keep_rejected=False, scores=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every document."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("tokens", tokens)]

#: No stage of it can be said in SQL as a whole; a test holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what goes on to the next is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
