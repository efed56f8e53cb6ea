"""Codes of stored vectors: made when an index is built, one binary cell a vector, and scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantize
from ..types import Index, Metric, Quantize

#: Vectors that a coder is fitted on at most, and their bytes.
FIT_SAMPLE, FIT_BYTES = 50_000, 64 << 20
#: Levels of the uniform quantizers.
LEVELS = {Quantize.UNIFORM_UINT8: 255, Quantize.UNIFORM_UINT7: 127, Quantize.UNIFORM_UINT4: 15}


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.float64) if len(rows) else np.zeros((0, 0))


def sample(df: DataFrame, column: str, seed: int = 7) -> np.ndarray:
    """Vectors of a column, those of the smallest digests: FIT_SAMPLE of them or FIT_BYTES, whichever is less."""
    v = df.select(F.col(f"`{column}`").cast("array<float>").alias("v")).where("v is not null")
    first = v.select(F.size("v")).first()
    if first is None or not first[0]:
        return np.zeros((0, 1))
    most = max(1, min(FIT_SAMPLE, FIT_BYTES // (4 * first[0])))
    rows = v.orderBy(F.xxhash64("v", F.lit(seed))).limit(most).toArrow().column("v").combine_chunks()
    return np.asarray(rows.values if not hasattr(rows, "flatten") else rows.flatten(), np.float64).reshape(len(rows), -1)


def coder_of(kind: Quantize, rows: DataFrame, column: str, index: Index):
    """What a quantizer has learnt of a column: a range, a product quantizer, or nothing."""
    p = index.all_params()
    if kind in LEVELS:
        return (*quantize.uniform_range(rows, column), LEVELS[kind])
    if kind is Quantize.PQ:
        x = sample(rows, column)
        chunks = p.get("num_chunk") or next(c for c in (8, 4, 2, 1) if x.shape[1] % c == 0)
        return quantize.ProductQuantizer(x, chunks, 1 << min(p.get("num_bits", 8), 8), bool(p.get("enable_rotate")))
    return (p.get("bits", 7), 7) if kind is Quantize.RABITQ else None


def _record(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale and bias of each row by its own minimum and maximum, as ``quantize.record_codes`` has them."""
    span, base = {8: (254.0, 127.0), 4: (15.0, 8.0)}[bits]
    low, high = x.min(1), x.max(1)
    scale = np.where(high > low, span / np.where(high > low, high - low, 1.0), 1.0)
    bias = -low * scale - base
    return np.floor(x * scale[:, None] + bias[:, None] + 0.5), scale, bias


def encode(kind: Quantize, coder, x: np.ndarray) -> np.ndarray:
    """(rows, bytes) codes."""
    raw = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(len(x), -1)
    if kind is Quantize.FP16:
        return raw(x.astype("<f2"))
    if kind in (Quantize.INT8, Quantize.INT4):
        c, scale, bias = _record(x, 8 if kind is Quantize.INT8 else 4)
        head = raw(np.stack([scale, bias], 1).astype("<f8"))
        if kind is Quantize.INT8:
            return np.hstack([head, raw(c.astype(np.int8))])
        c = (c + 8).astype(np.uint8)
        c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
        return np.hstack([head, c[:, ::2] << 4 | c[:, 1::2]])
    if kind in LEVELS:
        low, high, whole, levels = coder
        scale = 1.0 if whole and high - low <= levels else levels / (high - low) if high > low else 1.0
        return np.clip(np.floor((x - low) * scale + 0.5), 0, levels).astype(np.uint8)
    if kind is Quantize.PQ:
        return coder.encode(x)
    c, norm, own = quantize.rabitq_codes(x, *coder)
    return np.hstack([raw(np.stack([norm, own], 1).astype("<f8")), raw(c.astype("<i2"))])


def decode(kind: Quantize, coder, codes: np.ndarray, dimension: int) -> np.ndarray:
    """Vectors that codes stand for (not for rabitq, whose codes give products alone)."""
    head = lambda: np.ascontiguousarray(codes[:, :16]).view("<f8").reshape(-1, 2)
    if kind is Quantize.FP16:
        return np.ascontiguousarray(codes).view("<f2").astype(np.float64)
    if kind is Quantize.INT8:
        c = np.ascontiguousarray(codes[:, 16:]).view(np.int8).astype(np.float64)
        return (c - head()[:, 1:]) / head()[:, :1]
    if kind is Quantize.INT4:
        c = np.stack([codes[:, 16:] >> 4, codes[:, 16:] & 15], 2).reshape(len(codes), -1)[:, :dimension].astype(np.float64) - 8
        return (c - head()[:, 1:]) / head()[:, :1]
    if kind in LEVELS:
        low, high, whole, levels = coder
        scale = 1.0 if whole and high - low <= levels else levels / (high - low) if high > low else 1.0
        return codes / scale + low
    x = np.hstack([book[codes[:, k]] for k, book in enumerate(coder.books)])
    return x @ coder.turn.T if coder.turn is not None else x


def scores(kind: Quantize, coder, codes: np.ndarray, query: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores of coded vectors, as the metric has them."""
    if kind is Quantize.RABITQ:
        norm, own = np.ascontiguousarray(codes[:, :16]).view("<f8").reshape(-1, 2).T
        dot = quantize.rabitq_products(np.ascontiguousarray(codes[:, 16:]).view("<i2"), norm, own, query, *coder)
    else:
        x = decode(kind, coder, codes, len(query))
        dot, norm = x @ query, np.linalg.norm(x, axis=1)
    if metric is Metric.L2:
        return norm**2 + query @ query - 2 * dot
    if metric is Metric.COSINE:
        return 1 - dot / np.maximum(norm * np.linalg.norm(query), 1e-12)
    return dot


def with_codes(df: DataFrame, column: str, kind: Quantize, coder) -> DataFrame:
    """``df`` with ``_code`` of its vectors, none of which is null; without a quantizer it is null."""
    if kind is Quantize.NONE:
        return df.withColumn("_code", F.lit(None).cast("binary"))
    held = df.sparkSession.sparkContext.broadcast(coder)

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in encode(kind, held.value, matrix(v))] if len(v) else [])

    return df.withColumn("_code", run(F.col(f"`{column}`").cast("array<float>")))


def code_score(kind: Quantize, coder, query, metric: Metric) -> Column:
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def run(code: pd.Series) -> pd.Series:
        return pd.Series(scores(kind, coder, np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), q, metric) if len(code) else [], dtype="float64")

    return run("_code")
