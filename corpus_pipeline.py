"""A corpus from raw documents to packed sequences, stage by stage.  Part of subpackage ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenpulse.llm import decontaminate, linededup, packing, quality, simhash
from screenpulse.llm.common import dealt, forget_since, read, saved, saved_so_far


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays."""
    return linededup.dedup_lines(docs, chars_col="n_chars")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    return simhash.drop_near_duplicates(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, as pieces of sequences of 4096."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", simhash_dedup), ("decontamination", benchmark_filter), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  Once a stage's output is written, what it and the stage before wrote on the way is deleted."""
    docs, mark = dealt(read(spark, sf_dir, "documents")), saved_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        forget_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and a tokenizer are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
