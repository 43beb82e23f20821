"""Labelled rows for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is in fold 0 of ``crc32(doc_id as text) mod folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int = 5, label: str = "quality") -> DataFrame:
    """``text`` and ``label`` of at most ``max_rows`` labelled ids outside of fold 0, in the order of a hash of the id.

    Rows with a null id or label are left out. A document with several labels has the largest.
    ``max_rows`` bounds what is broadcast here and what a fit gathers.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).drop("doc_id")
