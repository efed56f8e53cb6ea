"""Inverted-file search: vectors dealt to the cells of k-means centres, few of which a query probes.

Centres are fitted on a bounded sample; every vector is dealt to a cell. A collection stores its vectors by cell, with
their codes, in one folder a cell (``Stored``): a query opens the folders of its nearest cells alone. The graph indexes of a
schema (hnsw, vamana, diskann) are served by such cells too; no graph is built.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.quantize import lloyd
from ..types import Index, IndexType, Metric, Quantize
from . import codes, vector


class Ivf:
    """Centres of an inverted file over a dense column."""

    def __init__(self, centres: np.ndarray, metric: Metric):
        self.centres, self.metric = centres, metric

    @staticmethod
    def fit(df: DataFrame, column: str, metric: Metric, nlist: int = 1024, iters: int = 10, seed: int = 7) -> Ivf:
        """Fit on a bounded sample of the vectors."""
        x = codes.sample(df, column, seed)
        if metric is Metric.COSINE:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return Ivf(lloyd(x, min(nlist, max(1, len(x) // 4)), iters, seed), metric)

    def _near(self, x: np.ndarray) -> np.ndarray:
        """(rows, cells) closeness, smaller is nearer."""
        if self.metric is Metric.COSINE:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if self.metric.descending:
            return -(x @ self.centres.T)
        return (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``_cell``, in Arrow batches. Written by partitions of ``_cell``, a probe reads few files."""
        centres = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            c = centres.value
            out = np.full(len(v), -1, np.int32)
            some = v.notna().to_numpy()
            if some.any():
                x = np.array(v[some].tolist(), np.float64)
                out[some] = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
            return pd.Series(out)

        col = F.col(f"`{column}`")
        if self.metric is Metric.COSINE:
            norm = F.sqrt(metrics.inner_product(col, col))
            col = F.when(norm > 0, F.transform(col, lambda x: x / norm)).otherwise(col)
        return df.withColumn("_cell", cell(col.cast("array<double>")))

    def probes(self, query, nprobe: int) -> list[int]:
        return np.argsort(self._near(np.array([query], np.float64))[0], kind="stable")[:nprobe].tolist()

    def search(self, assigned: DataFrame, column: str, query, k: int, nprobe: int = 10, key: str = "_id") -> DataFrame:
        """The k best within the nprobe nearest cells."""
        some = assigned.where(F.col("_cell").isin(self.probes(query, nprobe)))
        return vector.dense_top_k(some, column, query, self.metric, k, key).drop("_cell")


class Stored:
    """An inverted file on disk: centres, and rows (_id, _doc_id, _seq, _v, _code) in one folder a cell."""

    def __init__(self, spark, path: str, metric: Metric):
        self.spark, self.path, self.metric = spark, path, metric
        held = spark.read.parquet(f"{path}/centres").first()
        self.quantize = Quantize(held["quantize"])
        self.coder = pickle.loads(held["coder"])
        self.default_probes = held["nprobe"]
        self.ivf = Ivf(np.frombuffer(held["centres"], np.float64).reshape(held["cells"], -1), metric)

    @staticmethod
    def build(rows: DataFrame, path: str, index: Index) -> bool:
        """Write the index of rows (_id, _doc_id, _seq, _v); False if there is none."""
        spark, p = rows.sparkSession, index.all_params()
        count = rows.count()
        if not count:
            return False
        most = p.get("nlist") or 1024
        cells = max(1, min(most, int(count**0.5)))
        ivf = Ivf.fit(rows, "_v", index.metric, cells, p.get("iters", 10))
        quantizer = index.quantize if index.kind not in (IndexType.IVF_RABITQ, IndexType.HNSW_RABITQ) else Quantize.RABITQ
        coder = codes.coder_of(quantizer, rows, "_v", index)
        cells = len(ivf.centres)
        nprobe = index.params.get("nprobe") or max(10, -(-cells // 4))
        made = codes.with_codes(ivf.assign(rows, "_v"), "_v", quantizer, coder)
        made.repartitionByRange("_cell", "_id").write.partitionBy("_cell").parquet(f"{path}/cells")
        held = [(bytearray(ivf.centres.astype(np.float64).tobytes()), cells, quantizer.value, bytearray(pickle.dumps(coder)), nprobe)]
        spark.createDataFrame(held, "centres binary, cells int, quantize string, coder binary, nprobe int").coalesce(1).write.parquet(f"{path}/centres")
        return True

    def probe(self, query, nprobe: int | None) -> DataFrame:
        """The rows of the cells nearest to a query; other folders are not opened."""
        cells = self.ivf.probes(query, nprobe or self.default_probes)
        return self.spark.read.parquet(f"{self.path}/cells").where(F.col("_cell").isin(cells)).drop("_cell")

    def best(self, rows: DataFrame, query, k: int, refine: float | None) -> DataFrame:
        """The k best rows: by codes first where there are any, ``refine`` (10) times as many, and these exactly."""
        if self.quantize is not Quantize.NONE:
            score = codes.code_score(self.quantize, self.coder, query, self.metric)
            rows = vector.top_k(rows, score, self.metric, max(k, int(k * (refine or 10.0)))).drop("_score")
        return vector.dense_top_k(rows, "_v", query, self.metric, k)


def recall(found: list, exact: list) -> float:
    """Share of the exact result that was found."""
    return len(set(found) & set(exact)) / max(len(set(exact)), 1)
