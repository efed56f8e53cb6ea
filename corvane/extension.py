"""What users plug in: embedding functions and rerankers."""

from __future__ import annotations

import math
from collections import Counter
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as analysis


@runtime_checkable
class DenseEmbedding(Protocol):
    """A function from texts to dense vectors of one dimension."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class SparseEmbedding(Protocol):
    """A function from texts to sparse vectors {index: weight}."""

    def embed(self, texts: list[str]) -> list[dict[int, float]]: ...


def embed_column(text: Column, function: DenseEmbedding) -> Column:
    """Dense vectors of a text column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(function.embed(texts.fillna("").tolist()), index=texts.index)

    return run(text)


class Bm25Sparse:
    """Sparse vectors whose inner product is BM25: hashed terms, saturated counts for documents, idf for queries."""

    def __init__(self, documents: int, mean_length: float, frequencies: dict[int, int], buckets: int = 1 << 20, k1: float = 1.2, b: float = 0.75):
        self.n, self.mean, self.df, self.buckets, self.k1, self.b = documents, mean_length, frequencies, buckets, k1, b

    @staticmethod
    def fit(df: DataFrame, column: str, buckets: int = 1 << 20, **options) -> Bm25Sparse:
        """Count documents, their mean length and the document frequency of every bucket."""
        tokens = df.select(analysis.analyze(F.col(column)).alias("t")).where("t is not null")
        n, mean = tokens.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
        each = tokens.select(F.explode(F.array_distinct(F.transform("t", lambda w: _bucket(w, buckets)))).alias("i"))
        return Bm25Sparse(n, mean or 1.0, {r["i"]: r["count"] for r in each.groupBy("i").count().collect()}, buckets, **options)

    def encode_documents(self, text: Column) -> Column:
        """struct(indices, values) of a text column, in the JVM."""
        tokens = analysis.analyze(text)
        at = F.transform(tokens, lambda w: _bucket(w, self.buckets))
        seen = F.array_sort(F.array_distinct(at))
        length = self.k1 * (1 - self.b + self.b * F.size(tokens) / F.lit(self.mean))
        tf = lambda i: F.size(F.filter(at, lambda x: x == i))
        return F.struct(seen.alias("indices"), F.transform(seen, lambda i: (tf(i) * (self.k1 + 1) / (tf(i) + length)).cast("float")).alias("values"))

    def encode_query(self, spark, text: str) -> dict[int, float]:
        words = analysis.analyze_query(spark, [text])[0]
        if not words:
            return {}
        row = spark.range(1).select(*[_bucket(F.lit(w), self.buckets).alias(f"b{k}") for k, w in enumerate(words)]).first()
        counts = Counter(row)
        return {i: c * math.log((self.n - self.df.get(i, 0) + 0.5) / (self.df.get(i, 0) + 0.5) + 1) for i, c in counts.items()}


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("long")
