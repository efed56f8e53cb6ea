"""Vector quantizers: codes and their decoding as Spark expressions, trained ones in numpy over a bounded sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def record_codes(vector: Column, bits: int = 8) -> Column:
    """struct(codes, scale, bias) by a record's own minimum and maximum; 8 or 4 bits.

    8 bits: scale 254 / (max - min), bias -min * scale - 127. 4 bits: 15 / (max - min), -min * scale - 8.
    """
    span, base = {8: (254.0, 127.0), 4: (15.0, 8.0)}[bits]
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    scale = F.when(high > low, F.lit(span) / (high - low)).otherwise(F.lit(1.0))
    bias = -low * scale - base
    return F.struct(F.transform(vector, lambda x: _round(x.cast("double") * scale + bias).cast("int")).alias("codes"), scale.alias("scale"), bias.alias("bias"))


def record_decode(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: (c - code["bias"]) / code["scale"])


def uniform_range(df: DataFrame, column: str) -> tuple[float, float, bool]:
    """(minimum, maximum, all integers) over all numbers of a vector column: one pass, three numbers."""
    v = F.col(column)
    whole = F.forall(v, lambda x: x == F.floor(x))
    row = df.agg(F.min(F.array_min(v)), F.max(F.array_max(v)), F.min(whole.cast("int"))).first()
    if row[0] is None:
        raise InvalidArgument("no vector to take a range from")
    return float(row[0]), float(row[1]), bool(row[2])


def uniform_codes(vector: Column, low: float, high: float, whole: bool = False, levels: int = 255) -> Column:
    """Codes 0..levels by one range for all records; integers that span no more than that are kept exactly."""
    scale = 1.0 if whole and high - low <= levels else (levels / (high - low) if high > low else 1.0)
    return F.transform(vector, lambda x: F.least(F.greatest(_round((x.cast("double") - low) * scale), F.lit(0)), F.lit(levels)).cast("int"))


def uniform_decode(codes: Column, low: float, high: float, whole: bool = False, levels: int = 255) -> Column:
    scale = 1.0 if whole and high - low <= levels else (levels / (high - low) if high > low else 1.0)
    return F.transform(codes, lambda c: c / F.lit(scale) + low)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fp16(vectors: pd.Series) -> pd.Series:
    """Numbers rounded to half precision."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))


def hadamard(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows turned by random signs and a fast Hadamard transform; rows are padded to a power of two."""
    n = 1 << (x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    y *= np.random.default_rng(seed).choice([-1.0, 1.0], n)
    h = 1
    while h < n:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return y / np.sqrt(n)


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]


def lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of k-means over the rows of x."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres


class ProductQuantizer:
    """Chunks of a vector, each coded by its nearest of up to 256 centres; distances by lookup tables."""

    def __init__(self, sample: np.ndarray, chunks: int = 8, centres: int = 256, rotate: bool = False, seed: int = 7):
        d = sample.shape[1]
        if d % chunks:
            raise InvalidArgument(f"{chunks} chunks do not divide {d} dimensions")
        self.turn = rotation(d, seed) if rotate else None
        x = sample @ self.turn if rotate else sample
        self.chunks, self.width = chunks, d // chunks
        self.books = [lloyd(x[:, k * self.width : (k + 1) * self.width], centres, seed=seed + k) for k in range(chunks)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = x @ self.turn if self.turn is not None else x
        out = np.empty((len(x), self.chunks), np.uint8)
        for k, book in enumerate(self.books):
            part = x[:, k * self.width : (k + 1) * self.width]
            out[:, k] = ((book * book).sum(1) - 2 * part @ book.T).argmin(1)
        return out

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors from what their codes stand for."""
        x = x @ self.turn if self.turn is not None else x
        return np.linalg.norm(x - np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1), axis=1)

    def tables(self, query: np.ndarray, metric: str = "l2") -> np.ndarray:
        """(chunks, centres) parts of the score of a query."""
        q = query @ self.turn if self.turn is not None else query
        size = max(map(len, self.books))
        out = np.zeros((self.chunks, size))
        for k, book in enumerate(self.books):
            part = q[k * self.width : (k + 1) * self.width]
            out[k, : len(book)] = ((book - part) ** 2).sum(1) if metric == "l2" else book @ part
        return out

    def scores(self, codes: np.ndarray, query: np.ndarray, metric: str = "l2") -> np.ndarray:
        return self.tables(query, metric)[np.arange(self.chunks)[None], codes].sum(1)


def rabitq_codes(x: np.ndarray, bits: int = 7, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors on a grid of 2**bits levels: codes, norms, and the codes' product with the vector."""
    if not 1 <= bits <= 9:
        raise InvalidArgument("rabitq takes 1..9 bits")
    turned = hadamard(x, seed)
    norm = np.linalg.norm(turned, axis=1)
    unit = turned / np.maximum(norm, 1e-12)[:, None]
    levels = 1 << bits
    reach = np.abs(unit).max(1, keepdims=True)
    codes = np.clip(np.floor((unit / np.maximum(reach, 1e-12) + 1) / 2 * levels), 0, levels - 1).astype(np.int16)
    grid = (codes + 0.5) / levels * 2 - 1
    return codes, norm, (grid * unit).sum(1)


def rabitq_products(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, query: np.ndarray, bits: int = 7, seed: int = 7) -> np.ndarray:
    """Estimated inner products of coded vectors with a query: unbiased over random rotations."""
    grid = (codes + 0.5) / (1 << bits) * 2 - 1
    q = hadamard(query[None], seed)[0]
    return norm * (grid @ q) / np.maximum(own, 1e-12)


def rabitq_errors(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, bits: int = 7) -> np.ndarray:
    """Distances of vectors from what their codes stand for: an estimated product is off by no more than that times the query's norm."""
    grid = (codes + 0.5) / (1 << bits) * 2 - 1
    return norm * np.sqrt(np.maximum((grid * grid).sum(1) / np.maximum(own, 1e-12) ** 2 - 1, 0))
