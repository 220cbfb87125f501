"""A training-corpus pipeline over `documents`: classify, dedup exactly, dedup nearly, decontaminate, mix.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame with the
columns of documents (the last adds what the mix takes). run() writes each stage's result to the shared folder and
reads it again, so a lost executor costs a stage's tasks at most. Null, empty and very long texts, null and repeated
doc_ids, repeated rows and more columns are handled in every stage as its operator says; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, exact_dedup, mixing, quality, simhash
from barloom.llm.common import cut, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more). Without labels every score is 0.5 and all stay."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return quality.score(docs, model, name="_quality").where("_quality >= 0.3").drop("_quality")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id (null comes last), by way of a digest index."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest doc_id (null comes last)."""
    return simhash.dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; an empty benchmark leaves all."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their repetitions (times, 1 to 3) and words taken; columns with these names are replaced."""
    mixed = mixing.mix(docs).where("times > 0")
    new = ["size", "source_size", "target", "times", "taken"]
    return mixed.select(*(c for c in docs.columns if c not in new), *new)


STAGES = [("quality classifier", classify), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", clean), ("mixing sources", mixture)]

#: SQL cannot express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return docs
