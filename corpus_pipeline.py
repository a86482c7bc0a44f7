"""A training corpus from raw documents: five stages, each by one operator of ``provenir.llm``.

Rejected documents go; repeated lines go, keeping the first; of near-duplicate
documents one stays; sources are mixed to target weights in training order (a
document may come out several times or not at all); the result is packed into
sequences. Every stage reads what the one before wrote. The first four return
the columns of ``documents``; the last one a row for each piece.

Rows without doc_id, null texts, repeated rows and empty tables are handled as
the operators' docstrings say: null or short texts fail the quality rules.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from provenir.llm.common import table  # noqa: E402
from provenir.llm.line_dedup import drop_lines  # noqa: E402
from provenir.llm.minhash_dedup import drop_near_duplicates  # noqa: E402
from provenir.llm.packing import pack  # noqa: E402
from provenir.llm.quality_rules import keep_good  # noqa: E402
from provenir.llm.source_mixing import training_order  # noqa: E402
from provenir.session import materialize  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line of their class repeats."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents by the targets of their sources, in training order."""
    return training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Edit-distance classes, tokenizers and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
