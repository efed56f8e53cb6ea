"""Distances and similarities as Spark expressions; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import Metric


def vector_literal(values) -> Column:
    """A dense vector as a constant array of doubles."""
    return F.lit([float(x) for x in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; a vector of zeros is at distance 1 from all."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.lit(1.0) - F.when(norms > 0, inner_product(a, b) / norms).otherwise(F.lit(0.0))


def sparse_inner_product(sparse: Column, query: dict[int, float]) -> Column:
    """Sum over indices that a sparse column (indices, values) and a sparse query share."""
    if not query:
        return F.when(sparse.isNotNull(), F.lit(0.0))
    weights = F.create_map(*[x for k, v in sorted(query.items()) for x in (F.lit(int(k)).cast("long"), F.lit(float(v)))])
    each = F.zip_with(sparse["indices"], sparse["values"], lambda i, v: F.coalesce(F.try_element_at(weights, i), F.lit(0.0)) * v.cast("double"))
    return _sum(each)


def sparse_squared_l2(sparse: Column, query: dict[int, float]) -> Column:
    """|a|^2 + |b|^2 - 2 ab of a sparse column and a sparse query."""
    own = _sum(F.transform(sparse["values"], lambda v: v.cast("double") * v.cast("double")))
    return own + F.lit(sum(v * v for v in query.values())) - 2 * sparse_inner_product(sparse, query)


def score(metric: Metric, a: Column, b: Column) -> Column:
    """The score of a metric as users see it: squared L2 and cosine distance ascend, inner product descends."""
    if metric is Metric.L2:
        return squared_l2(a, b)
    if metric is Metric.COSINE:
        return cosine_distance(a, b)
    if metric in (Metric.IP, Metric.MIPSL2):
        return inner_product(a, b)
    raise InvalidArgument(f"no such metric {metric}")
