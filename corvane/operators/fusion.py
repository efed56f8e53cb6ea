"""Fusion of ranked lists: reciprocal ranks, weighted scores, or a caller's function."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import Metric


@dataclass
class Ranked:
    """One sub-query's rows with ``_id`` and ``_score``, and its metric (``fts`` for text)."""

    rows: DataFrame
    metric: Metric | str


def _descending(metric: Metric | str) -> bool:
    return metric == "fts" or metric.descending


@dataclass
class Rrf:
    """Sum over lists of 1 / (constant + rank + 1), ranks from 0."""

    constant: int = 60


@dataclass
class Weighted:
    """Sum over lists of weight times the score brought into one range."""

    weights: list[float] = field(default_factory=list)


@dataclass
class Callback:
    """A function of the lists [[(id, score)]] that gives [(id, score)]; it runs on the driver over the k best of each."""

    function: Callable


def normalised(score: Column, metric: Metric | str) -> Column:
    """A score in a range where more is better, by its metric."""
    if metric == "fts":
        return F.atan(score) * (2 / math.pi)
    if metric is Metric.L2:
        return F.lit(1.0) - F.atan(score) * (2 / math.pi)
    if metric is Metric.IP:
        return F.lit(0.5) + F.atan(score) / math.pi
    if metric is Metric.COSINE:
        return F.lit(1.0) - score / 2
    raise InvalidArgument(f"{metric} scores cannot be weighted")


def fuse(lists: list[Ranked], how: Rrf | Weighted | Callback, topn: int) -> DataFrame:
    """(_id, _score) of the topn best fused documents, ties by id. The lists are short: they are top-k results."""
    if not lists:
        raise InvalidArgument("nothing to fuse")
    spark = lists[0].rows.sparkSession
    if isinstance(how, Callback):
        got = how.function([[(r["_id"], r["_score"]) for r in x.rows.select("_id", "_score").orderBy(F.desc("_score") if _descending(x.metric) else "_score", "_id").collect()] for x in lists])
        return spark.createDataFrame([(str(i), float(s)) for i, s in got][: max(topn, 0)], "_id string, _score double")
    if isinstance(how, Rrf):
        if how.constant < 0:
            raise InvalidArgument("the constant must be 0 or more")
        parts = [x.rows.select("_id", (F.lit(1.0) / (F.row_number().over(Window.orderBy(F.desc("_score") if _descending(x.metric) else F.asc("_score"), "_id")) - 1 + how.constant + 1)).alias("_part")) for x in lists]
    else:
        if len(how.weights) != len(lists):
            raise InvalidArgument(f"{len(how.weights)} weights for {len(lists)} lists")
        parts = [x.rows.select("_id", (normalised(F.col("_score"), x.metric) * w).alias("_part")) for x, w in zip(lists, how.weights, strict=True)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("_id").agg(F.sum("_part").alias("_score"))
    return fused.orderBy(F.desc("_score"), "_id").limit(max(topn, 0))
