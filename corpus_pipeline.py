"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import stages
from corvane.llm.common import delete, scratch, shared_dir, stored

STAGES = [
    ("toxicity", stages.toxicity),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("mixing", stages.mix_sources),
    ("token_output", stages.write_tokens),
]

#: SQL can express neither the trained stages nor the tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; the last one's rows come back.

    Rows of null and repeated ids, null, empty and very long texts, ties and an empty table are handled as each stage states. A
    stage's own tables, and what the stage before kept, are deleted when its result is written, but for the token files.
    """
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{path}/{number}-{name}")
        if number:
            delete(spark, f"{path}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
