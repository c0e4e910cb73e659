"""Labels for training, and the rows held out from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, out: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == out, F.lit(False))


def training_labels(labels: DataFrame, column: str, folds: int, out: int) -> DataFrame:
    """``(doc_id, y)`` outside the held-out fold; of several labels the highest counts, null ones do not."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    return (
        rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
