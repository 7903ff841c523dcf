"""A training corpus from ``documents``: quality, near-duplicates, repeated passages, contamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and gives it to the next stage. All but the last
return the columns of ``documents``; the last repeats rows as the mix takes them and
numbers the repeats in ``copy``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandcall.llm import byte_cnn, mixing, phrase_index, sentence_spans, simhash_trees  # noqa: E402
from strandcall.llm.common import table  # noqa: E402
from strandcall.session import stage  # noqa: E402

LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at ``LEAST_SCORE`` or more."""
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, net).where(F.col("score") >= LEAST_SCORE).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    return simhash_trees.first_of_each(docs, words=3, bits=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stood before; ``n_chars`` follows the text."""
    return sentence_spans.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``."""
    found = phrase_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, budget=1.5, most=2)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The classifier's scores, SimHash and the word runs have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
