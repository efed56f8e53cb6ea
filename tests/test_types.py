import pytest

from corvane.errors import InvalidArgument
from corvane.types import DataType as D
from corvane.types import Field, Index, IndexType, Metric, Quantize, Schema, check_key, check_value


def test_schema_round_trip():
    s = Schema("c", [Field("a", D.INT32), Field("v", D.VECTOR_FP32, True, 64, Index(IndexType.HNSW, Metric.L2, Quantize.UNIFORM_UINT8, {"m": 8}))]).check()
    assert Schema.from_json(s.to_json()).to_json() == s.to_json()
    assert s["v"].index.all_params() == {"m": 8, "ef_construction": 500, "ef": 300}
    assert s.scalars() == ["a"] and s.vectors() == ["v"]
    assert Field("w", D.VECTOR_FP32, False, 4).index.metric is Metric.IP


@pytest.mark.parametrize(
    "field",
    [
        Field("bad name", D.INT32), Field("_id", D.INT32), Field("x" * 65, D.INT32), Field("v", D.VECTOR_FP32, False, 0), Field("v", D.VECTOR_FP32, False, 20_001),
        Field("v", D.VECTOR_INT8, False, 4, Index(metric=Metric.COSINE)), Field("v", D.SPARSE_VECTOR_FP32, index=Index(metric=Metric.L2)), Field("v", D.SPARSE_VECTOR_FP32, index=Index(IndexType.IVF)),
        Field("v", D.SPARSE_VECTOR_FP32, index=Index(quantize=Quantize.INT8)), Field("v", D.VECTOR_FP32, False, 32, Index(IndexType.HNSW_RABITQ)), Field("v", D.VECTOR_FP32, False, 64, Index(IndexType.IVF_RABITQ, params={"bits": 12})),
        Field("v", D.VECTOR_FP32, False, 8, Index(quantize=Quantize.PQ)), Field("v", D.VECTOR_FP32, False, 8, Index(quantize=Quantize.UNIFORM_UINT8, metric=Metric.L2)), Field("v", D.VECTOR_INT8, False, 8, Index(IndexType.IVF)),
        Field("a", D.INT32, index=Index(IndexType.FTS)), Field("a", D.INT32, index=Index(IndexType.HNSW)), Field("a", D.BINARY, index=Index(IndexType.INVERT)), Field("v", D.VECTOR_FP32, False, 8, Index(params={"what": 1})),
    ],
)
def test_fields_that_fail(field):
    with pytest.raises(InvalidArgument):
        field.check()


def test_schemas_that_fail():
    a = Field("a", D.INT32)
    for bad in (Schema("", [a]), Schema("c", []), Schema("c", [a, a]), Schema("c", [a], 10), Schema("c", [Field(f"v{k}", D.VECTOR_FP32, False, 2) for k in range(6)]), Schema("c", [Field(f"f{k}", D.INT32) for k in range(1025)])):
        with pytest.raises(InvalidArgument):
            bad.check()


def test_keys():
    assert check_key("ä" * 512) == "ä" * 512
    for bad in ("", "x" * 1025, "a\nb", "a\tb", "a b", None, 5):
        with pytest.raises(InvalidArgument):
            check_key(bad)


def test_values():
    assert check_value(Field("v", D.VECTOR_FP16, False, 2), [0.1, 1]) == pytest.approx([0.09997558593, 1.0])
    assert check_value(Field("v", D.SPARSE_VECTOR_FP32), {5: 1.0, 2: 3}) == {"indices": [2, 5], "values": [3.0, 1.0]}
    assert int(check_value(Field("u", D.UINT64), 2**64 - 1)) == 2**64 - 1
    assert check_value(Field("n", D.INT32, True), None) is None
    bad = [(Field("n", D.INT32), None), (Field("n", D.INT32), 2**31), (Field("n", D.INT32), 1.0), (Field("n", D.INT32), True), (Field("u", D.UINT32), -1), (Field("b", D.BOOL), 1), (Field("s", D.STRING), 1), (Field("v", D.VECTOR_FP32, False, 3), [1.0]), (Field("v", D.VECTOR_INT8, False, 1), [200]), (Field("a", D.ARRAY_INT32), 5), (Field("v", D.SPARSE_VECTOR_FP32), {-1: 1.0})]
    for f, v in bad:
        with pytest.raises(InvalidArgument):
            check_value(f, v)
