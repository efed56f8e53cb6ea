"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, sharding, urlfilter
from .decontaminate import leaks
from .minhash import near_duplicates
from .pii import find_personal_data
from .quality_cnn import quality
from .quality_rules import quality_rules
from .tokens import token_output
from .toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; the files are installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity 0.8."""
    return near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the byte-level network."""
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of disclosing terms in all documents."""
    return find_personal_data(_read(spark, sf_dir, "documents")).drop("terms")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the listed sites, for every page's url."""
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), urlfilter.listed_urls(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the n-gram likelihood ratio of all documents."""
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, with the items."""
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the string-kernel machine."""
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sampling of all documents to the sources' targets."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_output(_read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_personal_data": op3_personal_data,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_token_output": op10_token_output,
}

ORACLES: dict[str, str] = {"op4_url_filter": urlfilter.oracle(), "op8_mixing": mixing.oracle(), "op9_sharding": sharding.oracle()}
