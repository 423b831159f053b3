"""Documents to packed training sequences: quality rules, language ID, near-dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import language, lines, mixing, packing, simhash
from winnow.llm.queries import tokenizer_path
from winnow.llm.shared import store

LANGUAGE = ("lang_pred", "score")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules; of the others, remove the frequent lines of their host but for one copy."""
    kept = lines.clean(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its language (lang_pred, score) and drop those without one, that is without a letter.

    The network learns from the labelled documents. Where none has a label, those with a letter stay, as 'und' with 0.
    """
    net = language.fit(docs)
    kept = F.col("text").rlike(r"\p{L}") if net is None else F.col("lang_pred") != language.UNKNOWN
    return language.identify(docs, net).filter(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group, the one with the smallest id."""
    return simhash.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(mixing.mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, each with the language of its document."""
    return packing.pack(docs, tokenizer_path(), keep=[c for c in LANGUAGE if c in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# a trained network and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
