"""The training-data pipeline: quality, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import decontamination, packing, pii, quality, simhash
from loomlog.llm.storage import drop_made, made, new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, learned from ``labels``, doesn't reject."""
    rated = quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.train(docs, rated))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of texts with a Jaccard similarity of 0.8 or more (five-word shingles; SimHash trees give the candidates)."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window (or whole shorter item) of ``benchmark``."""
    return decontamination.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with kinds in place of personal data, and without terms that give it away; n_chars follows."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_classifier), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("pii", sanitise), ("packing", pack)]

#: Neither the classifier nor the fingerprints nor the packing can be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``. A stage's own intermediate tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path, mark = new_path(spark, name), made()
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        out.write.parquet(path)
        drop_made(spark, mark)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE_QUERIES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
