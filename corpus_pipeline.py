"""A training-data pipeline over ``documents`` in five stages.

Each stage takes all rows that the one before kept, written as Parquet and read
again. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import classifier, line_dedup, neardup, packing, rules
from driftwatch.llm.queries import GOOD
from driftwatch.llm.tokens import default_vocabulary
from driftwatch.session import bound_batches, materialize, table


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier predicts as label 0."""
    bound_batches(spark)
    trees = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.score(docs, trees, name="_score").where(F.col("_score") >= GOOD).select(*docs.columns)


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the isolation forest reject."""
    bound_batches(spark)
    forest, cut = rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.apply_rules(docs, forest, cut).where("kept").select(*docs.columns)


def without_known_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that a document of smaller id holds; ``n_chars`` follows."""
    bound_batches(spark)
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates: SimHash over five-word shingles, similarity 0.8 or more."""
    bound_batches(spark)
    return neardup.keep_first(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences."""
    bound_batches(spark)
    return packing.pack(docs, *default_vocabulary())


STAGES = [
    ("quality classifier", by_classifier),
    ("quality rules", by_rules),
    ("line dedup", without_known_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("packing", packed),
]

#: SQL can express neither the trained models, nor XXH64 fingerprints of shingles, nor tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
