"""A corpus pipeline: quality rules, exact dedup, SimHash near-dedup, PII surrogates, best-fit packing.

Every stage takes what its predecessor kept as docs and returns it as a DataFrame; all but the last return the
columns of documents.  A null id counts as any other value; repeated rows are handled as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import drop_stored, n_stored, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep."""
    from tesselar.llm.quality_rules import keep_good

    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the smallest id, of each group of equal texts."""
    from tesselar.llm.exact_dedup import survivors

    return survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (SimHash operator on word shingles, similarity 0.8): that with the smallest id."""
    from tesselar.llm.simhash import without_near_copies

    return without_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates in the place of personal data and n_chars of the new texts."""
    from tesselar.llm.pii import surrogates

    return surrogates(docs).withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of at most 2048 tokens."""
    from tesselar.llm.packing import best_fit
    from tesselar.llm.queries import vocabulary

    return best_fit(docs, vocabulary())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("pii", pii), ("packing", pack)]
#: Tokenization and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = n_stored()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, since, but=docs)  # the stage's own tables and its input have been read
    return STAGES[-1][1](spark, docs, sf_dir)
