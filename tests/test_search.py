"""Vector search, groups, fusion, quantizers and inverted files against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.errors import InvalidArgument, NotSupported
from corvane.functions import metrics, quantize
from corvane.operators import ann, coded, fusion, vector
from corvane.types import DataType as D
from corvane.types import Metric

RNG = np.random.default_rng(3)
X = RNG.normal(size=(200, 8)).round(3)
X[5] = 0
Q = RNG.normal(size=8).round(3)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"k{i:03d}", x.tolist(), i % 4, None if i % 9 == 0 else float(i % 3)) for i, x in enumerate(X)]
    return spark.createDataFrame([*data, ("null", None, 1, None)], "_id string, v array<double>, g int, h double").cache()


def reference(metric):
    dot = X @ Q
    if metric is Metric.L2:
        return ((X - Q) ** 2).sum(1)
    if metric is Metric.COSINE:
        norm = np.linalg.norm(X, axis=1) * np.linalg.norm(Q)
        return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    return dot


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("radius", [None, 0.7])
def test_top_k(rows, metric, radius):
    s = reference(metric)
    order = sorted(range(len(X)), key=lambda i: (-s[i] if metric.descending else s[i], i))
    if radius:
        order = [i for i in order if (s[i] >= radius if metric.descending else s[i] <= radius)]
    got = vector.dense_top_k(rows, "v", Q, metric, 12, radius=radius).collect()
    assert [r["_id"] for r in got] == [f"k{i:03d}" for i in order[:12]]
    assert [r["_score"] for r in got] == pytest.approx([s[i] for i in order[:12]])


def test_ties_and_limits(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [2.0])], "_id string, v array<double>")
    assert [r[0] for r in vector.dense_top_k(df, "v", [1.0], Metric.L2, 2).collect()] == ["a", "b"]
    for k in (0, 100_001, 1.5):
        with pytest.raises(InvalidArgument):
            vector.dense_top_k(df, "v", [1.0], Metric.L2, k)


def test_top_k_needs_no_shuffle(rows):
    plan = vector.dense_top_k(rows, "v", Q, Metric.L2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("InMemory")[0]


def test_sparse(spark):
    data = [("a", {1: 1.0, 5: 2.0}), ("b", {5: 3.0}), ("c", {2: 9.0}), ("d", None)]
    df = spark.createDataFrame([(i, None if s is None else (list(s), list(s.values()))) for i, s in data], "_id string, s struct<indices:array<bigint>,values:array<float>>")
    got = vector.sparse_top_k(df, "s", {5: 2.0, 1: 0.5}, 10).collect()
    assert [(r["_id"], r["_score"]) for r in got] == [("b", 6.0), ("a", 4.5), ("c", 0.0)]
    l2 = df.where("s is not null").select("_id", metrics.sparse_squared_l2(F.col("s"), {5: 2.0}).alias("x")).collect()
    assert {r[0]: r[1] for r in l2} == {"a": 1.0, "b": 1.0, "c": 85.0}


def test_groups(rows):
    s = reference(Metric.L2)
    got = vector.top_groups(rows, metrics.squared_l2(F.col("v"), metrics.vector_literal(Q)), Metric.L2, vector.group_key("h", D.DOUBLE), 2, 3).collect()
    name = lambda i: "" if i % 9 == 0 else f"{float(i % 3):.6f}"
    by = {}
    for i in sorted(range(len(X)), key=lambda i: (s[i], i)):
        by.setdefault(name(i), []).append(i)
    groups = sorted(by, key=lambda g: (s[by[g][0]], g))[:3]
    assert [(r["_group"], r["_id"]) for r in got] == [(g, f"k{i:03d}") for g in groups for i in by[g][:2]]
    with pytest.raises(InvalidArgument):
        vector.group_key("v", D.VECTOR_FP32)


def test_refined_finds_the_exact_best(rows):
    exact = [r["_id"] for r in vector.dense_top_k(rows, "v", Q, Metric.L2, 10).collect()]
    assert [r["_id"] for r in vector.refined(rows, "v", Q, Metric.L2, 10, 5).collect()] == exact
    with pytest.raises(NotSupported):
        vector.refined(rows, "v", Q, Metric.MIPSL2, 10)


def ranked(spark, pairs, metric):
    return fusion.Ranked(spark.createDataFrame(pairs, "_id string, _score double"), metric)


def test_rrf(spark):
    lists = [ranked(spark, [("a", 0.1), ("b", 0.2)], Metric.L2), ranked(spark, [("b", 5.0), ("c", 4.0)], Metric.IP)]
    got = [(r[0], round(r[1], 9)) for r in fusion.fuse(lists, fusion.Rrf(), 10).collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    assert fusion.fuse(lists, fusion.Rrf(), 0).count() == 0 and fusion.fuse(lists, fusion.Rrf(), 1).count() == 1
    with pytest.raises(InvalidArgument):
        fusion.fuse(lists, fusion.Rrf(-1), 3)


def test_weighted(spark):
    lists = [ranked(spark, [("a", 0.5)], Metric.L2), ranked(spark, [("a", 2.0)], Metric.IP), ranked(spark, [("a", 0.4)], Metric.COSINE), ranked(spark, [("a", 3.0), ("b", 1.0)], "fts")]
    got = {r[0]: r[1] for r in fusion.fuse(lists, fusion.Weighted([1, 2, 3, 4]), 10).collect()}
    a = 1 - 2 * math.atan(0.5) / math.pi + 2 * (0.5 + math.atan(2.0) / math.pi) + 3 * (1 - 0.2) + 4 * (2 * math.atan(3.0) / math.pi)
    assert got == pytest.approx({"a": a, "b": 4 * 2 * math.atan(1.0) / math.pi})
    with pytest.raises(InvalidArgument):
        fusion.fuse(lists, fusion.Weighted([1]), 10)
    with pytest.raises(InvalidArgument):
        fusion.fuse([ranked(spark, [("a", 1.0)], Metric.MIPSL2)], fusion.Weighted([1]), 1)


def test_callback(spark):
    lists = [ranked(spark, [("a", 0.5), ("b", 0.1)], Metric.L2), ranked(spark, [("c", 2.0)], Metric.IP)]
    got = fusion.fuse(lists, fusion.Callback(lambda x: [(i, float(len(x[0]))) for i, _ in x[0]]), 10).collect()
    assert [(r[0], r[1]) for r in got] == [("b", 2.0), ("a", 2.0)]
    with pytest.raises(InvalidArgument):
        fusion.fuse([], fusion.Rrf(), 1)


def test_record_codes(rows):
    got = {r[0]: r for r in rows.where("v is not null").select("_id", quantize.record_codes(F.col("v")).alias("c"), quantize.record_decode(quantize.record_codes(F.col("v"))).alias("d"), quantize.record_codes(F.col("v"), 4).alias("f")).collect()}
    for i, x in enumerate(X):
        r = got[f"k{i:03d}"]
        scale = 254 / (x.max() - x.min()) if x.max() > x.min() else 1.0
        assert r["c"]["codes"] == np.floor(x * scale + (-x.min() * scale - 127) + 0.5).astype(int).tolist()
        assert np.abs(np.array(r["d"]) - x).max() <= 0.51 / scale
        assert all(-8 <= c <= 7 for c in r["f"]["codes"])


def test_uniform_codes(rows, spark):
    low, high, whole = quantize.uniform_range(rows, "v")
    assert (low, high, whole) == (X.min(), X.max(), False)
    codes = rows.where("v is not null").select(quantize.uniform_codes(F.col("v"), low, high).alias("c")).collect()
    assert np.array([r[0] for r in codes]).min() == 0 and np.array([r[0] for r in codes]).max() == 255
    ints = spark.createDataFrame([([1.0, 7.0],), ([3.0, -2.0],)], "v array<double>")
    assert quantize.uniform_range(ints, "v") == (-2.0, 7.0, True)
    assert [r[0] for r in ints.select(quantize.uniform_codes(F.col("v"), -2.0, 7.0, True)).collect()] == [[3, 9], [5, 0]]
    with pytest.raises(InvalidArgument):
        quantize.uniform_range(ints.where("false"), "v")


def test_product_and_rabitq():
    x = RNG.normal(size=(600, 16))
    q = RNG.normal(size=16)
    for turn in (False, True):
        pq = quantize.ProductQuantizer(x, 4, 64, rotate=turn)
        near = np.argsort(pq.scores(pq.encode(x), q))[:60]
        exact = np.argsort(((x - q) ** 2).sum(1))[:10]
        assert ann.recall(list(near), list(exact)) >= 0.9
    with pytest.raises(InvalidArgument):
        quantize.ProductQuantizer(x, 5)
    for bits, slack in ((7, 0.05), (4, 0.3)):
        parts = quantize.rabitq_codes(x, bits)
        guess = quantize.rabitq_products(*parts, q, bits)
        assert np.abs(guess - x @ q).mean() < slack * np.linalg.norm(q)
    with pytest.raises(InvalidArgument):
        quantize.rabitq_codes(x, 10)
    assert np.allclose(np.linalg.norm(quantize.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_fp16(rows):
    got = rows.where("v is not null").select("_id", quantize.fp16(F.col("v").cast("array<float>")).alias("h")).orderBy("_id").collect()
    assert np.array_equal(np.array([r[1] for r in got], np.float32), X.astype(np.float32).astype(np.float16).astype(np.float32))


@pytest.mark.parametrize("metric", [Metric.L2, Metric.IP, Metric.COSINE])
def test_inverted_file(rows, metric):
    index = ann.Ivf.fit(rows, "v", metric, 16)
    assigned = index.assign(rows, "v").cache()
    assert assigned.count() == rows.count()
    exact = [r["_id"] for r in vector.dense_top_k(rows, "v", Q, metric, 10).collect()]
    wide = [r["_id"] for r in index.search(assigned, "v", Q.tolist(), 10, 16).collect()]
    some = [r["_id"] for r in index.search(assigned, "v", Q.tolist(), 10, 10).collect()]
    assert wide == exact and ann.recall(some, exact) >= 0.7


@pytest.mark.parametrize("metric", [Metric.L2, Metric.IP, Metric.COSINE])
def test_coded_search(rows, metric):
    exact = [r["_id"] for r in vector.dense_top_k(rows, "v", Q, metric, 10).collect()]
    codes = coded.RaBitQ(metric)
    assert [r["_id"] for r in codes.search(codes.encode(rows, "v"), "v", Q.tolist(), 10, 4).collect()] == exact
    if metric is Metric.COSINE:
        with pytest.raises(NotSupported):
            coded.Pq.fit(rows, "v", metric)
    else:
        for rotate in (False, True):
            pq = coded.Pq.fit(rows, "v", metric, 4, 32, rotate)
            assert ann.recall([r["_id"] for r in pq.search(pq.encode(rows, "v"), "v", Q.tolist(), 10, 6).collect()], exact) >= 0.9
    with pytest.raises(NotSupported):
        coded.RaBitQ(Metric.MIPSL2)


@pytest.mark.parametrize("metric", [Metric.L2, Metric.IP, Metric.COSINE])
def test_coded_search_is_exact_with_poor_codes(spark, metric):
    """Codes of few centres or bits put some of the best rows far back; all the same none is missing."""
    x = np.random.default_rng(5).normal(size=(1200, 16)).astype(np.float32)
    rows = spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "_id string, v array<float>").cache()
    for q in (x[3], x[11] / 3):
        query = q.astype(float).tolist()
        exact = [r["_id"] for r in vector.dense_top_k(rows, "v", query, metric, 10).collect()]
        if metric is not Metric.COSINE:
            pq = coded.Pq.fit(rows, "v", metric, 4, 4)
            assert [r["_id"] for r in pq.search(pq.encode(rows, "v"), "v", query, 10, 1.0).collect()] == exact
        codes = coded.RaBitQ(metric, 1)
        assert [r["_id"] for r in codes.search(codes.encode(rows, "v"), "v", query, 10, 1.0).collect()] == exact
