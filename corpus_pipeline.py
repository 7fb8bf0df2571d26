"""The training-data pipeline: five stages over documents, each one of the operators in tessera.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
result as Parquet into the shared folder and reads it again as the next stage's
documents, so a lost executor costs one stage's work at most. A stage's output is
removed once the next one is written; the last stage reads the fourth's.

Every stage takes texts of any length whole, keeps all columns whatever their names,
and gives an empty table for an empty one. What else is defined: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, mixing, secrets, simhash
from tessera.llm.tables import discard, save, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or mostly in none of the languages learned.

    A null or empty text has no letters and goes; a null id or language is no reason to go;
    repeated rows are judged alike; without any language to learn from all documents go.
    """
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies: the one with the smallest id, any one of its repeated rows.

    Null and empty texts are copies of one another; a null id is larger than any other.
    """
    return simhash.deduplicated(docs, distance=3, shingle=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of eight words of any benchmark item, or all of a shorter item.

    A null or empty text holds none and stays; items without words, or with a null id, drop
    nothing; repeated rows and items change nothing; with an empty benchmark all stay.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=8, least_items=1)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows. All rows stay; null and empty texts are left as they are."""
    return secrets.redacted(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken words.

    These get longer names where they would clash. A null or empty text has no words and is
    never taken; a null source is a source; rows with equal id, source and size are taken or
    left together; labels of no document, or with nulls, are ignored.
    """
    return mixing.mixture(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: SQL expresses neither the first stage's model nor the fingerprints; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, before = shared_folder(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
