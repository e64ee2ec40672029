"""Documents to training tokens: quality, line dedup, near dedup, decontamination, byte-level BPE.

Each stage reads what the one before it kept. The first four return the columns of documents; the last adds
n_tokens, token_ids and whether decoding the ids gave the text back (round_trip). Columns of documents are never renamed or
replaced: where one has such a name, the added column is called n_tokens_2 and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, contamination, lines, neardup, quality
from tidemark.llm.common import stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~quality.held_out())
    return quality.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines that stand at a lesser place."""
    return lines.dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe.encode(docs, *bpe.default_files())


STAGES = [("quality", good_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("byte_bpe", tokenize)]

#: Trained scores and recursive merges are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
