"""Collections end to end: writes with their statuses, reads, schema changes, versions and streams."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corvane.collection import Collection, Doc, Query
from corvane.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, NotSupported, PermissionDenied
from corvane.extension import Bm25Sparse, DenseEmbedding, embed_column
from corvane.operators import fusion
from corvane.plans.expressions import compile_expression, wrap
from corvane.streaming.upserts import upsert_stream
from corvane.types import DataType as D
from corvane.types import Field, Index, IndexType, Metric, Schema


def schema():
    return Schema(
        "docs",
        [
            Field("n", D.INT64), Field("g", D.INT32, True), Field("title", D.STRING, True, 0, Index(IndexType.FTS)), Field("tags", D.ARRAY_STRING, True),
            Field("v", D.VECTOR_FP32, True, 2, Index(metric=Metric.L2)), Field("s", D.SPARSE_VECTOR_FP32, True),
        ],
    )


def docs(n=12):
    return [Doc(f"d{i:02d}", {"n": i, "g": i % 3, "title": f"apple {'pear' if i % 2 else 'plum'} word{i}", "tags": [f"t{i % 4}"], "v": [float(i), 0.0], "s": {i: 1.0, 50: 0.5}}) for i in range(n)]


@pytest.fixture
def made(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/c", schema())
    assert c.insert(docs()) == ["OK"] * 12
    return c


def test_create_and_open(spark, tmp_path, made):
    with pytest.raises(AlreadyExists):
        Collection.create(spark, made.store.path, schema())
    with pytest.raises(NotFound):
        Collection.open(spark, f"file://{tmp_path}/none")
    assert Collection.open(spark, made.store.path).df().count() == 12
    empty = Collection.create(spark, f"file://{tmp_path}/e", schema())
    assert empty.df().count() == 0 and empty.query(Query("v", [0.0, 0.0])) == [] and empty.stats()["doc_count"] == 0
    made.destroy()
    with pytest.raises(NotFound):
        Collection.open(spark, made.store.path)


def test_writes(made):
    assert made.insert([Doc("d00", {"n": 1}), Doc("new", {"n": 1}), Doc("new", {"n": 2})]) == ["ALREADY_EXISTS", "OK", "ALREADY_EXISTS"]
    assert made.update([Doc("d01", {"g": None}), Doc("nope", {"n": 1})]) == ["OK", "NOT_FOUND"]
    d = made.fetch(["d01"]).first()
    assert (d["n"], d["g"], d["title"], list(d["v"])) == (1, None, "apple pear word1", [1.0, 0.0])
    assert made.upsert([Doc("d02", {"n": 100}), Doc("d02", {"n": 200})]) == ["OK", "OK"]
    d = made.fetch(["d02"]).first()
    assert d["n"] == 200 and d["title"] is None
    assert made.delete(["d03", "d03", "zzz"]) == ["OK", "NOT_FOUND", "NOT_FOUND"]
    assert made.insert([Doc("d03", {"n": 9})]) == ["OK"]
    assert made.delete_by_filter("n >= 9 AND n < 12") == 4
    assert sorted(r[0] for r in made.df().select("_id").collect()) == ["d00", "d01", "d02", "d04", "d05", "d06", "d07", "d08", "new"]
    made.optimize()
    assert made.df().count() == 9 and not made.manifest["dirty"] and len(made.manifest["segments"]) == 1
    assert made.stats() == {"doc_count": 9, "index_completeness": {"v": 1.0, "s": 1.0}}


@pytest.mark.parametrize("bad", [[Doc("", {"n": 1})], [Doc("x", {"n": "1"})], [Doc("x", {})], [Doc("x", {"n": 1, "what": 2})], [Doc("x", {"n": 1, "v": [1.0]})], [Doc(f"x{i}", {"n": 1}) for i in range(1025)]])
def test_one_bad_document_fails_all(made, bad):
    with pytest.raises(InvalidArgument):
        made.insert([Doc("fine", {"n": 1}), *bad])
    assert made.fetch(["fine"]).count() == 0


def test_bulk(made, spark):
    rows = spark.createDataFrame([("d00", 7), ("x1", 1), ("x1", 1), ("x2", 2)], "_id string, n long")
    for f in made.schema.fields[1:]:
        rows = rows.withColumn(f.name, F.lit(None).cast(f.type.spark()))
    made.insert_df(rows)
    assert made.df().count() == 14 and made.fetch(["d00"]).first()["n"] == 0
    made.upsert_df(rows.where("_id = 'd00'"))
    assert made.df().count() == 14 and made.fetch(["d00"]).first()["n"] == 7
    ids = [r[0] for r in made.df().select("_doc_id").collect()]
    assert len(set(ids)) == 14


def test_queries(made):
    got = made.query(Query("v", [3.2, 0.0]), topk=3, filter="g != 0")
    assert [d.id for d in got] == ["d04", "d02", "d05"] and got[0].score == pytest.approx(0.64) and set(got[0].fields) == {"n", "g", "title", "tags"}
    assert [d.id for d in made.query(Query("v", id="d05"), topk=2)] == ["d05", "d04"]
    assert [d.id for d in made.query(Query("v", [0.0, 0.0], radius=4.5), topk=10)] == ["d00", "d01", "d02"]
    assert [d.id for d in made.query(Query("v", [3.2, 0.0], refine=3.0), topk=2)] == ["d03", "d04"]
    assert [d.id for d in made.query(Query("s", vector={4: 3.0, 50: 1.0}), topk=1)] == ["d04"]
    assert {d.id for d in made.query(Query("title", match_string="pear"), topk=20)} == {f"d{i:02d}" for i in range(1, 12, 2)}
    assert [d.id for d in made.query(Query("title", query_string='"pear word3"'), topk=20)] == ["d03"]
    assert [d.id for d in made.query(topk=2, filter="n > 4")] == ["d05", "d06"]
    assert made.query(Query("v", [0.0, 0.0]), topk=1, output_fields=[])[0].fields == {}
    assert set(made.query(Query("v", [0.0, 0.0]), topk=1, output_fields=["n", "*"], include_vector=True)[0].fields) == {"n", "g", "title", "tags", "v", "s"}
    ids, scores = made.query_ids(Query("v", [0.0, 0.0], radius=1.5), topk=4)
    assert ids[2:] == [-1, -1] and scores[:2] == [0.0, 1.0] and scores[2] != scores[2]
    assert made.resolve([ids[0], -1, 999]) == ["d00", None, None]


def test_query_errors(made):
    for q in (Query("n", [1.0]), Query("v", [1.0]), Query("v"), Query("v", match_string="a"), Query("nope", [1.0]), Query("title")):
        with pytest.raises(InvalidArgument):
            made.query(q)
    with pytest.raises(NotFound):
        made.query(Query("v", id="none"))
    with pytest.raises(InvalidArgument):
        made.query([Query("v", [0.0, 0.0])], reranker=fusion.Rrf())
    with pytest.raises(InvalidArgument):
        made.query([Query("v", [0.0, 0.0])] * 2)
    with pytest.raises(InvalidArgument):
        made.query(Query("v", [0.0, 0.0]), topk=0)
    with pytest.raises(NotSupported):
        made.query(Query("s", vector={1: 1.0}, refine=2.0))


def test_hybrid_and_groups(made):
    got = made.query([Query("title", match_string="word4"), Query("v", [4.0, 0.0])], topk=3, reranker=fusion.Rrf())
    assert got[0].id == "d04" and got[0].score == pytest.approx(2 / 61) and got[0].fields["n"] == 4
    got = made.group_by_query(Query("v", [4.0, 0.0]), "g", 2, 2).collect()
    assert [(r["_group"], r["_id"]) for r in got] == [("1", "d04"), ("1", "d01"), ("0", "d03"), ("0", "d06")]
    with pytest.raises(InvalidArgument):
        made.group_by_query(Query("title", match_string="a"), "g")


def test_rerankers_of_single_queries(made):
    longest = lambda docs: [Doc(d.id, d.fields, float(d.fields["n"])) for d in sorted(docs, key=lambda d: -d.fields["n"])]
    got = made.query([Query("v", [0.0, 0.0], rerank=longest), Query("title", match_string="word11")], topk=2, reranker=fusion.Rrf(), num_candidates=3)
    assert [d.id for d in got] == ["d02", "d11"] and got[0].score == pytest.approx(1 / 61)


def test_iterate_and_versions(made, spark):
    seen = made.iterate(["n"])
    first = next(seen)
    version = made.manifest["version"]
    made.delete([f"d{i:02d}" for i in range(6)])
    assert first.fields.keys() == {"n"} and len(list(seen)) == 11
    old = Collection.open(spark, made.store.path, version=version)
    assert old.df().count() == 12 and made.df().count() == 6
    for call in (lambda: old.insert([Doc("z", {"n": 1})]), lambda: old.delete(["d00"]), lambda: old.optimize()):
        with pytest.raises(PermissionDenied):
            call()
    for bad in (["n", "n"], ["v"], ["nope"]):
        with pytest.raises(InvalidArgument):
            made.iterate(bad)
    other = Collection.open(spark, made.store.path)
    other.insert([Doc("w", {"n": 1})])
    with pytest.raises(FailedPrecondition):
        made.insert([Doc("y", {"n": 1})])
    made.refresh()
    assert made.insert([Doc("y", {"n": 1})]) == ["OK"] and made.store.vacuum() > 0 and made.df().count() == 8


def test_columns(made):
    made.add_column(Field("twice", D.INT32), "n * 2 + 1")
    made.add_column(Field("empty", D.DOUBLE, True))
    made.alter_column("g", rename="grp")
    made.alter_column("n", new=Field("n", D.DOUBLE))
    r = made.fetch(["d04"]).first()
    assert (r["twice"], r["empty"], r["grp"], r["n"]) == (9, None, 1, 4.0)
    made.drop_column("twice")
    assert "twice" not in made.df().columns
    for call, error in (
        (lambda: made.add_column(Field("n", D.INT32), "1"), AlreadyExists), (lambda: made.add_column(Field("t", D.STRING), "1"), InvalidArgument), (lambda: made.add_column(Field("m", D.INT32)), InvalidArgument),
        (lambda: made.drop_column("title"), InvalidArgument), (lambda: made.alter_column("n"), InvalidArgument), (lambda: made.alter_column("grp", new=Field("grp", D.INT64)), InvalidArgument), (lambda: made.alter_column("n", rename="grp"), AlreadyExists),
    ):
        with pytest.raises(error):
            call()


def test_indexes(made):
    made.create_index("v", Index(IndexType.IVF, Metric.L2, params={"nlist": 4}))
    made.optimize()
    assert [d.id for d in made.query(Query("v", [3.2, 0.0], nprobe=4), topk=2)] == ["d03", "d04"]
    version = made.manifest["version"]
    made.create_index("v", Index(IndexType.IVF, Metric.L2, params={"nlist": 4}))
    assert made.manifest["version"] == version
    with pytest.raises(NotSupported):
        made.group_by_query(Query("v", [0.0, 0.0]), "g")
    with pytest.raises(FailedPrecondition):
        made.create_index("title", Index(IndexType.INVERT))
    made.drop_index("title")
    made.create_index("title", Index(IndexType.INVERT))
    assert made.scan("title LIKE 'apple plum%'").count() == 6
    made.view("live")
    assert made.spark.sql("select count(*) from live").first()[0] == 12


def test_expressions(spark):
    s = Schema("t", [Field("a", D.INT32, True), Field("b", D.DOUBLE), Field("u", D.UINT64), Field("s", D.STRING)])
    df = spark.createDataFrame([(7, 2.0, Decimal(5), "x"), (-7, 0.5, Decimal(2), "x"), (None, 0.0, Decimal(0), "x")], "a int, b double, u decimal(20,0), s string")
    value = lambda e, t: [r[0] for r in df.select(wrap(compile_expression(e, s), t)).collect()]
    assert value("a / 2", D.INT32) == [3, -3, None]
    assert value("a / 0", D.INT32) == [None, None, None]
    assert value("-(a + 1) * 2 - -b", D.DOUBLE) == [-14.0, 12.5, None]
    assert value("b * 1.9", D.INT32) == [3, 0, 0]
    assert value("a * 1e0 / 2", D.DOUBLE) == [3.5, -3.5, None]
    assert value("a * 1000000000", D.INT32) == [(7_000_000_000 + 2**31) % 2**32 - 2**31, (-7_000_000_000 + 2**31) % 2**32 - 2**31, None]
    assert value("a - 8", D.UINT32) == [2**32 - 1, 2**32 - 15, None]
    for bad in ("", "a +", "(a", "a b", "s + 1", "what", "a % 2", "a ^ 2"):
        with pytest.raises(InvalidArgument):
            compile_expression(bad, s)


def test_stream(made, spark, tmp_path):
    rows = spark.createDataFrame([("d00", 70, 1), ("d00", 71, 2), ("q", 5, 1)], "_id string, n long, turn int")
    for f in made.schema.fields[1:]:
        rows = rows.withColumn(f.name, F.lit(None).cast(f.type.spark()))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = upsert_stream(stream, made, f"{tmp_path}/check", order_by="turn", availableNow=True)
    query.awaitTermination(60)
    assert made.df().count() == 13 and made.fetch(["d00"]).first()["n"] == 71


def test_extensions(spark):
    class Length:
        dimension = 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "aa b"), (2, None), (3, "b b b")], "i int, t string")
    assert isinstance(Length(), DenseEmbedding)
    assert [list(r[0]) for r in df.select(embed_column(F.col("t"), Length())).collect()] == [[4.0, 1.0], [0.0, 1.0], [5.0, 1.0]]
    bm = Bm25Sparse.fit(df, "t")
    from corvane.operators import vector

    rows = df.select(F.col("i").cast("string").alias("_id"), bm.encode_documents(F.col("t")).alias("s"))
    got = vector.sparse_top_k(rows.where("s is not null"), "s", bm.encode_query(spark, "aa"), 1).collect()
    assert [r["_id"] for r in got] == ["1"] and got[0]["_score"] > 0


def test_changes_of_columns_write_no_rows(spark, tmp_path):
    """Columns are changed as segments are read, each from when it was written; optimize() writes the rows so."""
    c = Collection.create(spark, f"file://{tmp_path}/changes", Schema("t", [Field("a", D.INT32, True), Field("b", D.DOUBLE, True)]))
    c.insert([Doc("x", {"a": 3, "b": 1.5}), Doc("y", {"a": None, "b": 2.5})])
    segments = [s["name"] for s in c.manifest["segments"]]
    c.add_column(Field("twice", D.INT32, True), "a * 2")
    c.alter_column("a", rename="was")
    c.insert([Doc("z", {"was": 10, "b": 7.9, "twice": 1})])
    c.update([Doc("x", {"was": 100})])  # what was computed stays
    c.alter_column("b", new=Field("b", D.INT64, True))
    c.add_column(Field("a", D.DOUBLE, True), "was + b")
    c.drop_column("was")
    want = {"x": (1, 6, 101.0), "y": (2, None, None), "z": (7, 1, 17.0)}
    assert [s["name"] for s in c.manifest["segments"]][:1] == segments and c.schema.scalars() == ["b", "twice", "a"]
    for _ in range(2):
        c = Collection.open(spark, c.store.path)
        assert {r["_id"]: (r["b"], r["twice"], r["a"]) for r in c.scan().collect()} == want
        assert [r["_id"] for r in c.filtered("twice = 6").collect()] == ["x"]
        c.optimize()
    assert len(c.manifest["segments"]) == 1 and not c.manifest["changes"]
