"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.llm.common import stored
from burstlens.llm.mixing import mix_sources
from burstlens.llm.near import first_of_classes
from burstlens.llm.pieces import sample_pieces
from burstlens.llm.pii import find_pii, sanitise
from burstlens.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; each row is judged by its own text."""
    return keep_good(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return first_of_classes(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, entities generalised and disclosing terms removed."""
    found = find_pii(docs)
    text = sanitise(F.col("text"), F.col("spans"))
    clean = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mix_sources(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each row, which decodes to the row's text."""
    return sample_pieces(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("piece sampling", pieces_stage),
]

# The stages hash, draw, sample and compress; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
