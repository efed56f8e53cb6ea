"""Stored indexes of a collection: cells and codes with their recall, postings after changes, and the plans that read them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.collection import Collection, Doc, Query
from corvane.errors import InvalidArgument
from corvane.types import DataType as D
from corvane.types import Field, Index, IndexType, Metric, Quantize, Schema

DIM, N = 64, 3000


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, DIM))
    return (centres[rng.integers(0, 60, N)] + 0.6 * rng.normal(size=(N, DIM))).astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark, points):
    return spark.createDataFrame([(f"p{i:05d}", i % 7, x.tolist()) for i, x in enumerate(points)], "_id string, g int, v array<float>").cache()


def made(spark, path, rows, index):
    c = Collection.create(spark, f"file://{path}/c", Schema("t", [Field("g", D.INT32, True), Field("v", D.VECTOR_FP32, True, DIM, index)]))
    c.insert_df(rows)
    c.optimize()
    return Collection.open(spark, c.store.path)  # what was built is read again


CASES = [
    Index(IndexType.IVF, Metric.L2), Index(IndexType.IVF, Metric.COSINE, Quantize.INT8), Index(IndexType.IVF, Metric.IP, Quantize.INT4), Index(IndexType.IVF, Metric.L2, Quantize.FP16), Index(IndexType.IVF, Metric.L2, Quantize.PQ, {"num_chunk": 16}),
    Index(IndexType.IVF_RABITQ, Metric.L2), Index(IndexType.HNSW, Metric.COSINE), Index(IndexType.HNSW, Metric.L2, Quantize.UNIFORM_UINT8), Index(IndexType.HNSW, Metric.L2, Quantize.UNIFORM_UINT4), Index(IndexType.VAMANA, Metric.L2, Quantize.UNIFORM_UINT7), Index(IndexType.DISKANN, Metric.IP), Index(IndexType.HNSW_RABITQ, Metric.COSINE),
]


@pytest.mark.parametrize("index", CASES, ids=lambda x: f"{x.kind.value}-{x.metric.value}-{x.quantize.value}")
def test_recall(spark, tmp_path, points, rows, index):
    c = made(spark, tmp_path, rows, index)
    assert c.stats()["index_completeness"] == {"v": 1.0}
    found = []
    for q in range(0, 200, 40):
        x, y = points.astype(np.float64), points[q].astype(np.float64)
        score = {Metric.L2: ((x - y) ** 2).sum(1), Metric.IP: -(x @ y), Metric.COSINE: 1 - (x @ y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y)}[index.metric]
        best = {f"p{i:05d}" for i in np.argsort(score, kind="stable")[:10]}
        got = [d.id for d in c.query(Query("v", y.tolist()), topk=10)]
        assert len(got) == 10
        found.append(len(best & set(got)) / 10)
    assert np.mean(found) >= 0.9, found
    exact = [d.id for d in c.query(Query("v", y.tolist(), is_linear=True), topk=10)]
    assert set(exact) == best


def test_cells_after_changes(spark, tmp_path, points, rows):
    c = made(spark, tmp_path, rows, Index(IndexType.IVF, Metric.L2, Quantize.INT8, {"nprobe": 54}))
    q = points[0].astype(float).tolist()
    assert [d.id for d in c.query(Query("v", q), topk=1)] == ["p00000"]
    c.delete(["p00000"])
    far, near = (points[0] + 50).tolist(), (points[0] + 0.001).tolist()
    c.upsert([Doc("p00001", {"v": near}), Doc("p00002", {"v": far})])
    c.insert([Doc("new", {"v": points[0].tolist(), "g": 1})])
    got = c.query(Query("v", q), topk=3)
    assert [d.id for d in got[:2]] == ["new", "p00001"] and "p00000" not in {d.id for d in got} and got[0].score == 0.0
    assert [d.id for d in c.query(Query("v", q), topk=1, filter="g = 1")] == ["new"]
    assert c.stats()["index_completeness"]["v"] == pytest.approx(1 / 3)
    c.optimize()
    assert [d.id for d in c.query(Query("v", q), topk=2)] == ["new", "p00001"] and c.stats()["index_completeness"]["v"] == 1.0
    assert c.store.vacuum() > 0 and [d.id for d in c.query(Query("v", q), topk=1)] == ["new"]


def test_only_the_probed_cells_are_read(spark, tmp_path, points, rows):
    c = made(spark, tmp_path, rows, Index(IndexType.IVF, Metric.L2, params={"nlist": 16, "nprobe": 2}))
    plan = c.query_df(Query("v", points[5].astype(float).tolist()), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_cell" in plan or "PartitionFilters: [_cell" in plan


def texts(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/t", Schema("t", [Field("n", D.INT32, True), Field("text", D.STRING, True, 0, Index(IndexType.FTS))]))
    c.insert_df(spark.createDataFrame([(f"d{i}", i, f"common word{i % 3} {'rare' if i == 4 else ''} tail") for i in range(9)] + [("e", 1, None), ("f", 2, "")], "_id string, n int, text string"))
    return c


def test_postings_are_read_by_term(spark, tmp_path):
    c = texts(spark, tmp_path)
    plan = c._search_text(c.schema["text"], __import__("corvane.operators.fulltext", fromlist=["x"]).query_tree(spark, match_string="rare"), 3, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_folder" in plan or "PartitionFilters: [isnotnull(_folder" in plan
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,rare)" in plan
    assert [d.id for d in c.query(Query("text", match_string="rare"))] == ["d4"]


def test_postings_agree_with_the_texts(spark, tmp_path):
    """After inserts, replacements and deletes the stored postings give what a look at all live texts gives."""
    from corvane.operators import fulltext

    c = texts(spark, tmp_path)
    c.upsert([Doc("d1", {"text": "rare rare common"}), Doc("d2", {"text": None})])
    c.delete(["d3"])
    c.insert([Doc("g", {"n": 5, "text": "rare word1 beside common tail"})])
    for query in ("common rare", '"rare common"', "+common -rare", "word1 OR (tail AND rare)", '"word1 beside" tail', "common common"):
        tree = fulltext.query_tree(spark, query)
        want = [(r["_id"], round(r["_score"], 9)) for r in fulltext.search(c.df(), "text", tree, 20).collect()]
        assert [(d.id, round(d.score, 9)) for d in c.query(Query("text", query_string=query), topk=20)] == want, query
    assert [d.id for d in c.query(Query("text", match_string="rare"), filter="n > 4")] == ["g"]
    c.optimize()
    assert {d.id for d in c.query(Query("text", match_string="rare"))} == {"d1", "d4", "g"}
    c.create_index("text", Index(IndexType.FTS, params={"tokenizer": "whitespace"}))  # not built yet: the texts answer
    assert {d.id for d in c.query(Query("text", match_string="rare"))} == {"d1", "d4", "g"}
    c.optimize()
    assert "text" in c.manifest["segments"][0]["text"] and {d.id for d in c.query(Query("text", match_string="rare"))} == {"d1", "d4", "g"}


def test_filters_go_below_the_delete_mask(spark, tmp_path):
    c = texts(spark, tmp_path)
    c.upsert([Doc("d1", {"n": 100})])
    plan = c.filtered("n > 50")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "LeftAnti" in plan and "GreaterThan(n,50)" in plan
    assert [r["_id"] for r in c.filtered("n > 50").collect()] == ["d1"]


def test_bulk_rules(spark, tmp_path):
    schema = Schema("t", [Field("n", D.INT32), Field("u", D.UINT32, True), Field("v", D.VECTOR_FP32, True, 2)])
    c = Collection.create(spark, f"file://{tmp_path}/b", schema)
    kind = "_id string, n int, u long, v array<float>"
    for bad in (("", 1, 1, None), ("a\nb", 1, 1, None), ("x" * 1025, 1, 1, None), (None, 1, 1, None), ("a", None, 1, None), ("a", 1, -1, None), ("a", 1, 2**32, None), ("a", 1, 1, [1.0])):
        with pytest.raises(InvalidArgument):
            c.insert_df(spark.createDataFrame([("fine", 1, 1, [1.0, 2.0]), bad], kind))
    with pytest.raises(InvalidArgument):
        c.insert_df(spark.createDataFrame([("a", 1)], "_id string, other int"))
    assert c.df().count() == 0
    c.insert_df(spark.createDataFrame([("a", 1, 5, None), ("a", 2, 6, None), ("b", 3, None, [1.0, 2.0])], kind).coalesce(1))
    assert {r["_id"]: r["n"] for r in c.df().collect()} == {"a": 1, "b": 3}  # of repeats the first
    c.upsert_df(spark.createDataFrame([("a", 7), ("a", 8)], "_id string, n int").coalesce(1))
    assert c.fetch(["a"]).first()["n"] == 8 and c.fetch(["a"]).first()["u"] is None  # the last, and absent fields are null
    c.update_df(spark.createDataFrame([("b", 9), ("nobody", 1)], "_id string, u long"))
    r = c.fetch(["b"]).first()
    assert (r["n"], r["u"], list(r["v"])) == (3, 9, [1.0, 2.0]) and c.df().count() == 2
    c.delete_df(spark.createDataFrame([("a",), ("zzz",)], "_id string"))
    assert [r["_id"] for r in c.df().select("_id").collect()] == ["b"]
    assert [r["_id"] for r in c.scan(order_by="n", descending=True, offset=0, limit=5).collect()] == ["b"]
    with pytest.raises(InvalidArgument):
        c.scan(order_by="v")


def test_codes_are_those_of_the_expressions(spark, rows, points):
    from corvane.functions import quantize
    from corvane.operators import codes

    some = rows.limit(20).collect()
    x = np.array([r["v"] for r in some], np.float64)
    df = spark.createDataFrame(some, rows.schema)
    for bits, kind in ((8, Quantize.INT8), (4, Quantize.INT4)):
        want = df.select(quantize.record_codes(F.col("v"), bits)["codes"].alias("c")).collect()
        c, _, _ = codes._record(x, bits)
        assert [r["c"] for r in want] == c.astype(int).tolist()
        back = codes.decode(kind, None, codes.encode(kind, None, x), DIM)
        assert np.abs(back - x).max() <= (x.max(1) - x.min(1)).max() / (254 if bits == 8 else 15)
