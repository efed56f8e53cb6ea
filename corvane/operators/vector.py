"""Vector search: exact top-k, radius, per group, and coarse-then-exact refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotSupported
from ..functions import metrics, quantize
from ..types import DataType, Metric, MAX_TOPK


def scored(df: DataFrame, score: Column, metric: Metric, radius: float | None = None) -> DataFrame:
    """``df`` with ``_score``; rows without a vector go. A radius above 0 keeps scores up to it (inner product: from it on)."""
    df = df.withColumn("_score", score).where("_score is not null")
    if radius is not None and radius > 0:
        df = df.where(F.col("_score") >= radius if metric.descending else F.col("_score") <= radius)
    return df


def ordered(metric: Metric, key: str = "_id") -> list[Column]:
    """Order by score in the metric's direction, ties by key."""
    return [F.desc("_score") if metric.descending else F.asc("_score"), F.asc(key)]


def check_topk(k: int) -> int:
    if not isinstance(k, int) or not 1 <= k <= MAX_TOPK:
        raise InvalidArgument(f"topk must be 1..{MAX_TOPK}")
    return k


def top_k(df: DataFrame, score: Column, metric: Metric, k: int, key: str = "_id", radius: float | None = None) -> DataFrame:
    """The k best rows. Each task keeps k of its own before anything moves (TakeOrderedAndProject)."""
    return scored(df, score, metric, radius).orderBy(*ordered(metric, key)).limit(check_topk(k))


def dense_top_k(df: DataFrame, column: str, query, metric: Metric, k: int, key: str = "_id", radius: float | None = None) -> DataFrame:
    return top_k(df, metrics.score(metric, F.col(f"`{column}`"), metrics.vector_literal(query)), metric, k, key, radius)


def sparse_top_k(df: DataFrame, column: str, query: dict[int, float], k: int, key: str = "_id", radius: float | None = None) -> DataFrame:
    return top_k(df, metrics.sparse_inner_product(F.col(f"`{column}`"), query), Metric.IP, k, key, radius)


def by_row(df: DataFrame, column: str, source: DataFrame, metric: Metric, k: int, key: str = "_id", radius: float | None = None) -> DataFrame:
    """The k rows best like the vector of ``source``'s one row; that row takes part itself."""
    one = source.select(F.col(f"`{column}`").alias("_query")).limit(1)
    joined = df.crossJoin(F.broadcast(one))
    return top_k(joined, metrics.score(metric, F.col(f"`{column}`"), F.col("_query")), metric, k, key, radius).drop("_query")


def group_key(column: str, kind: DataType) -> Column:
    """A scalar as the text that names its group: null is '', floats have six decimals."""
    if kind.is_array or kind.is_vector or kind is DataType.BINARY:
        raise InvalidArgument(f"{column} cannot name groups")
    c = F.col(f"`{column}`")
    if kind in (DataType.FLOAT, DataType.DOUBLE):
        c = F.format_string("%.6f", c.cast("double"))
    return F.when(F.col(f"`{column}`").isNotNull(), c.cast("string")).otherwise("")


def top_groups(df: DataFrame, score: Column, metric: Metric, group: Column, per_group: int = 3, groups: int = 2, key: str = "_id", radius: float | None = None) -> DataFrame:
    """The best rows of the best groups: ``per_group`` rows of each of the ``groups`` groups whose best row is best.

    The winning groups come first, from one partial aggregate, so that the window that ranks rows
    sees their rows alone, cut to ``per_group`` in each task before the shuffle. Ties between groups go by name.
    """
    if per_group < 1 or groups < 1:
        raise InvalidArgument("per_group and groups must be 1 or more")
    rows = scored(df, score, metric, radius).withColumn("_group", group)
    best = rows.groupBy("_group").agg((F.max if metric.descending else F.min)("_score").alias("_best"))
    best = best.orderBy(F.desc("_best") if metric.descending else F.asc("_best"), "_group").limit(groups)
    place = Window.partitionBy("_group").orderBy(*ordered(metric, key))
    out = rows.join(F.broadcast(best), "_group").withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= per_group)
    return out.orderBy(F.desc("_best") if metric.descending else F.asc("_best"), "_group", "_rank")


def refined(df: DataFrame, column: str, query, metric: Metric, k: int, scale: float = 2.0, coarse: Column | None = None, key: str = "_id") -> DataFrame:
    """Two stages: the k * scale best by quantized vectors (8 bits a number unless ``coarse`` is given), then the k best of these exactly."""
    if metric is Metric.MIPSL2:
        raise NotSupported("refinement takes L2, inner product or cosine")
    v, q = F.col(f"`{column}`"), metrics.vector_literal(query)
    rough = coarse if coarse is not None else quantize.record_decode(quantize.record_codes(v))
    first = top_k(df, metrics.score(metric, rough, q), metric, max(1, int(k * max(scale, 1.0))), key).drop("_score")
    return top_k(first, metrics.score(metric, v, q), metric, k, key)
