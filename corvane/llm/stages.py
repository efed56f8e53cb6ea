"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps of ``docs``.

All of them judge row by row, whatever the ids: null and repeated ids, null, empty and very long texts, ties, empty tables and further
columns are handled as the operator that a stage calls states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import drop_leaks
from .minhash import drop_near_duplicates
from .mixing import mixed_documents
from .queries import tokenizer_path
from .tokens import token_output
from .toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity machine does not reject; those without words, and all without labels of both classes, stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8).

    Rows of one id are one document and stay or go together; rows of a null id, and texts without words, stay.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; without items, or words, all stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row taken twice is two rows, one without words is not taken."""
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and describes each row from them; null ids come first, rows of one id in the order of their texts."""
    return token_output(docs, tokenizer_path())
