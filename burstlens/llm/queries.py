"""Registered queries of this folder; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.llm.alignment import cross_align
from burstlens.llm.chat import chat_digest, chat_windows
from burstlens.llm.common import table
from burstlens.llm.fm_index import dedup_substrings
from burstlens.llm.mixing import mixed_sizes
from burstlens.llm.pii import find_pii, span_digest
from burstlens.llm.near import near_classes
from burstlens.llm.p_stable import nearest
from burstlens.llm.pieces import sample_pieces
from burstlens.llm.quality import quality_rules
from burstlens.llm.suffix_merge import dedup_suffixes, suffix_digest
from burstlens.llm.token_table import token_digest, write_token_table
from burstlens.llm.toxicity import fit_toxicity, held_out, score_toxicity
from burstlens.llm.whitening import whiten
from burstlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


CONTROL_STRINGS = r"\### Assistant: </turn> ok"  # says what the template must escape


@query
def op9_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    planted = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_STRINGS).alias("text"),
    )
    return chat_digest(chat_windows(turns.unionByName(planted)))


@query
def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_digest(find_pii(docs))


@query
def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"))


@query
def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")


@query
def op6_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(dedup_suffixes(table(spark, sf_dir, "documents")))


@query
def op10_backward_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_multiprobe_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("is_first").alias("kept"), "n_words")


@query
def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    # Sums of squares that no long holds are null here; the operator has them as decimals.
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-table")
    write_token_table(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)


@query
def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align(table(spark, sf_dir, "documents"))
