"""One query for each corpus operator, over its whole table, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, linededup, packing, pii, quality, secretscan, simhash, toxicity
from .common import dealt, read
from .oracle import SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
    evidence = F.array_join(F.transform(F.slice("neighbours", 1, 3), lambda n: n["doc_id"].cast("string")), ",")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), evidence.alias("evidence"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(dealt(read(spark, sf_dir, "documents"))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find_secrets(dealt(read(spark, sf_dir, "documents"))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(dealt(read(spark, sf_dir, "documents"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")).drop("k_text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (first-last,...), text_sha256 of the text that stays."""
    parted = linededup.with_runs(dealt(read(spark, sf_dir, "documents")))
    runs = F.coalesce("runs", F.array().cast("array<struct<first:long,last:long>>"))
    text = F.coalesce("new_text", "row.text", F.lit(""))
    lines = F.when(F.coalesce("row.text", F.lit("")) == "", 0).otherwise(F.size(F.split("row.text", "\n", -1)))
    return parted.select(
        F.col("row.doc_id").alias("doc_id"),
        lines.cast("long").alias("n_lines"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1).alias("n_deleted"),
        F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",").alias("deleted"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(dealt(read(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(dealt(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep.doc_id").alias("component_id"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(dealt(read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_secret_scan, op4_packing, op5_quality, op6_line_dedup, op7_decontamination, op8_nearest_vectors, op9_simhash, op10_chat_format)}
__all__ = ["QUERIES", "SQL"]
