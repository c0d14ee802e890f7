"""Training-corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage but the
last returns the columns of documents. run() writes each result as Parquet to the shared checkpoint folder, reads it
back as the next stage's docs and then deletes the one before. SQL cannot express the stages, so ORACLE_SQL is None; tests/llm holds the brute-force
counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relatrix.llm import mixing, neardup, packing, quality_rules, toxicity
from relatrix.session import discard, prepare, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with their failing lines taken out."""
    prepare(spark)
    d = quality_rules.kept_documents(docs)
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not predict toxic. It learns from the labelled rows among `docs`."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels, carry=True).filter("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    prepare(spark)
    return neardup.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in training order; a document taken twice is there twice."""
    prepare(spark)
    d = mixing.curriculum(mixing.mix(docs, carry=True), position=None)
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2,048."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return docs
