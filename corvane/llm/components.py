"""Connected components over an edge table, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


#: Edges up to which one task joins them in memory, 16 bytes each; beyond, the star operations run on all executors.
SMALL = 1 << 19


def _join_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        for side in (low[a], low[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["node", "component"])


def components(edges: DataFrame, path: str, small: int = SMALL, files: int | None = None) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    ``edges`` has longs ``u`` and ``v``. Each round takes a large-star and a
    small-star step; both only group by a node and take a minimum, which is
    combined before the shuffle, so that a node of very many edges needs no
    task that holds them. Every round's edges are written below ``path``:
    a lost executor costs one round at most; ``files`` is that of ``dealt``. Stops when a round changes nothing;
    loops and repeated edges do no harm. An empty table gives an empty table.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(dealt(edges, files), f"{path}/0")
    before, step = _signature(edges), 0
    if before[0] <= small:
        return stored(edges.coalesce(1).mapInArrow(_join_small, "node long, component long"), f"{path}/out")
    while before[0]:
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = stored(dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), files), f"{path}/{step}m")
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(dealt(large.where("u != v").distinct(), files), f"{path}/{step}l")
        lows = stored(dealt(large.groupBy("u").agg(F.min("v").alias("m")), files), f"{path}/{step}s")
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(dealt(small.union(lows.select("u", F.col("m").alias("v"))).distinct(), files), f"{path}/{step}")
        after = _signature(edges)
        if after == before:
            break
        before = after
    low = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stored(dealt(low.union(low.select(F.col("component").alias("node"), "component")).distinct(), files), f"{path}/out")
