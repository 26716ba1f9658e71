"""Retrieval evaluation: an extension that the reference only describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits(question_id, rank, source), expected(question_id, source) to (question_id, n_expected, n_found, recall, reciprocal_rank)."""
    found = expected.distinct().join(hits.groupBy("question_id", "source").agg(F.min("rank").alias("rank")), ["question_id", "source"], "left")
    agg = found.groupBy("question_id").agg(F.count("*").alias("n_expected"), F.count("rank").alias("n_found"), F.min("rank").alias("best"))
    return agg.select("question_id", "n_expected", "n_found", (F.col("n_found") / F.col("n_expected")).alias("recall"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))
