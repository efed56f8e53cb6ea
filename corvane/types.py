"""Data types, fields and collection schemas, and their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidArgument

MAX_SCALARS, MAX_VECTORS, MAX_DIMENSION, MAX_SPARSE, MAX_BATCH, MAX_TOPK, MAX_KEY = 1024, 5, 20_000, 16_384, 1024, 100_000, 1024
RESERVED = ("_id", "_doc_id", "_score", "_group", "_seq", "_deleted")


class DataType(Enum):
    BINARY = "binary"
    STRING = "string"
    BOOL = "bool"
    INT32 = "int32"
    INT64 = "int64"
    UINT32 = "uint32"
    UINT64 = "uint64"
    FLOAT = "float"
    DOUBLE = "double"
    VECTOR_FP32 = "vector_fp32"
    VECTOR_FP16 = "vector_fp16"
    VECTOR_INT8 = "vector_int8"
    SPARSE_VECTOR_FP32 = "sparse_vector_fp32"
    SPARSE_VECTOR_FP16 = "sparse_vector_fp16"
    ARRAY_BINARY = "array_binary"
    ARRAY_STRING = "array_string"
    ARRAY_BOOL = "array_bool"
    ARRAY_INT32 = "array_int32"
    ARRAY_INT64 = "array_int64"
    ARRAY_UINT32 = "array_uint32"
    ARRAY_UINT64 = "array_uint64"
    ARRAY_FLOAT = "array_float"
    ARRAY_DOUBLE = "array_double"

    @property
    def is_dense(self) -> bool:
        return self.value.startswith("vector_")

    @property
    def is_sparse(self) -> bool:
        return self.value.startswith("sparse_")

    @property
    def is_vector(self) -> bool:
        return self.is_dense or self.is_sparse

    @property
    def is_array(self) -> bool:
        return self.value.startswith("array_")

    @property
    def element(self) -> DataType:
        return DataType(self.value.removeprefix("array_"))

    @property
    def is_numeric(self) -> bool:
        return self.value in NUMERIC_RANGES or self in (DataType.FLOAT, DataType.DOUBLE)

    @property
    def is_integer(self) -> bool:
        return self.value in NUMERIC_RANGES

    def spark(self) -> T.DataType:
        if self.is_array:
            return T.ArrayType(self.element.spark())
        if self.is_sparse:
            return T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
        return _SPARK[self.value]


NUMERIC_RANGES = {"int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}
_SPARK = {
    "binary": T.BinaryType(), "string": T.StringType(), "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(),
    "vector_fp32": T.ArrayType(T.FloatType()), "vector_fp16": T.ArrayType(T.FloatType()), "vector_int8": T.ArrayType(T.ByteType()),
}


class Metric(Enum):
    L2 = "l2"
    IP = "ip"
    COSINE = "cosine"
    MIPSL2 = "mipsl2"

    @property
    def descending(self) -> bool:
        return self in (Metric.IP, Metric.MIPSL2)


class IndexType(Enum):
    FLAT = "flat"
    HNSW = "hnsw"
    IVF = "ivf"
    HNSW_RABITQ = "hnsw_rabitq"
    IVF_RABITQ = "ivf_rabitq"
    DISKANN = "diskann"
    VAMANA = "vamana"
    INVERT = "invert"
    FTS = "fts"


class Quantize(Enum):
    NONE = "none"
    FP16 = "fp16"
    INT8 = "int8"
    INT4 = "int4"
    UNIFORM_UINT8 = "uniform_uint8"
    UNIFORM_UINT7 = "uniform_uint7"
    UNIFORM_UINT4 = "uniform_uint4"
    PQ = "pq"
    RABITQ = "rabitq"


#: Parameters of each index with their defaults.
INDEX_DEFAULTS: dict[IndexType, dict] = {
    IndexType.FLAT: {},
    IndexType.HNSW: {"m": 50, "ef_construction": 500, "ef": 300},
    IndexType.IVF: {"nlist": 1024, "iters": 10, "soar": False, "nprobe": 10},
    IndexType.HNSW_RABITQ: {"bits": 7, "clusters": 16, "m": 50, "ef_construction": 500, "ef": 300},
    IndexType.IVF_RABITQ: {"nlist": 1024, "bits": 7, "nprobe": 10},
    IndexType.DISKANN: {"degree": 100, "list_size": 300, "pq": 0, "build_list": 50},
    IndexType.VAMANA: {"degree": 64, "build_list": 100, "alpha": 1.2, "ef": 200},
    IndexType.INVERT: {"range_optimization": True, "extended_wildcard": False},
    IndexType.FTS: {"tokenizer": "standard", "filters": ["lowercase"], "k1": 1.2, "b": 0.75},
}


@dataclass
class Index:
    """An index of one field: its kind, metric, quantizer and parameters."""

    kind: IndexType = IndexType.FLAT
    metric: Metric = Metric.IP
    quantize: Quantize = Quantize.NONE
    params: dict = field(default_factory=dict)

    def all_params(self) -> dict:
        return INDEX_DEFAULTS[self.kind] | self.params

    def to_json(self) -> dict:
        return {"kind": self.kind.value, "metric": self.metric.value, "quantize": self.quantize.value, "params": self.params}

    @staticmethod
    def from_json(x: dict) -> Index:
        return Index(IndexType(x["kind"]), Metric(x["metric"]), Quantize(x["quantize"]), x["params"])


_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


@dataclass
class Field:
    """One column of a collection."""

    name: str
    type: DataType
    nullable: bool = False
    dimension: int = 0
    index: Index | None = None

    def __post_init__(self):
        if self.type.is_vector and self.index is None:
            self.index = Index()

    def check(self) -> None:
        if not _NAME.fullmatch(self.name) or self.name in RESERVED:
            raise InvalidArgument(f"bad field name {self.name!r}")
        if self.type.is_dense and not 1 <= self.dimension <= MAX_DIMENSION:
            raise InvalidArgument(f"{self.name}: dimension must be 1..{MAX_DIMENSION}")
        if self.index is not None:
            check_index(self, self.index)

    def to_json(self) -> dict:
        return {"name": self.name, "type": self.type.value, "nullable": self.nullable, "dimension": self.dimension, "index": self.index and self.index.to_json()}

    @staticmethod
    def from_json(x: dict) -> Field:
        return Field(x["name"], DataType(x["type"]), x["nullable"], x["dimension"], x["index"] and Index.from_json(x["index"]))


def check_index(f: Field, index: Index) -> None:
    """Which indexes, metrics and quantizers a field's type allows."""
    kind, metric, q, t = index.kind, index.metric, index.quantize, f.type
    unknown = set(index.params) - set(INDEX_DEFAULTS[kind]) - {"num_chunk", "num_bits", "enable_rotate", "fast_scan", "opq_iter", "stemmer_lang", "ngram", "token_chars", "use_refiner"}
    if unknown:
        raise InvalidArgument(f"{f.name}: unknown index parameters {sorted(unknown)}")
    if kind is IndexType.FTS:
        if t is not DataType.STRING:
            raise InvalidArgument(f"{f.name}: full text needs a string field")
        return
    if kind is IndexType.INVERT:
        if t.is_vector or t in (DataType.BINARY, DataType.ARRAY_BINARY):
            raise InvalidArgument(f"{f.name}: a scalar index cannot hold {t.value}")
        return
    if not t.is_vector:
        raise InvalidArgument(f"{f.name}: {kind.value} needs a vector field")
    if t.is_sparse:
        if metric is not Metric.IP or kind not in (IndexType.FLAT, IndexType.HNSW):
            raise InvalidArgument(f"{f.name}: sparse vectors take inner product with a flat or hnsw index")
        if q not in (Quantize.NONE, Quantize.FP16):
            raise InvalidArgument(f"{f.name}: sparse vectors quantize to fp16 alone")
        return
    if metric is Metric.COSINE and t not in (DataType.VECTOR_FP32, DataType.VECTOR_FP16):
        raise InvalidArgument(f"{f.name}: cosine needs floats")
    if kind is IndexType.IVF and metric is Metric.IP and t is DataType.VECTOR_INT8:
        raise InvalidArgument(f"{f.name}: ivf with inner product needs floats")
    if kind in (IndexType.HNSW_RABITQ, IndexType.IVF_RABITQ) or q is Quantize.RABITQ:
        if t is not DataType.VECTOR_FP32 or not 64 <= f.dimension <= 4095:
            raise InvalidArgument(f"{f.name}: rabitq needs fp32 of 64..4095 dimensions")
        if not 1 <= index.all_params().get("bits", 7) <= 9:
            raise InvalidArgument(f"{f.name}: rabitq takes 1..9 bits")
    if q is Quantize.PQ and (kind not in (IndexType.IVF, IndexType.HNSW) or t is not DataType.VECTOR_FP32):
        raise InvalidArgument(f"{f.name}: pq goes with ivf or hnsw on fp32")
    if q.value.startswith("uniform") and (metric is not Metric.L2 or kind in (IndexType.FLAT, IndexType.IVF, IndexType.DISKANN)):
        raise InvalidArgument(f"{f.name}: uniform quantizers take L2 on a graph index")


@dataclass
class Schema:
    """A collection's name and fields."""

    name: str
    fields: list[Field]
    max_docs_per_segment: int = 10_000_000

    def check(self) -> Schema:
        if not self.name or len(self.name.encode()) > 256:
            raise InvalidArgument("a collection's name has 1..256 bytes")
        names = [f.name for f in self.fields]
        if not names or len(set(names)) != len(names):
            raise InvalidArgument("fields must be named once, and there must be one")
        vectors = sum(f.type.is_vector for f in self.fields)
        if vectors > MAX_VECTORS or len(names) - vectors > MAX_SCALARS:
            raise InvalidArgument(f"at most {MAX_SCALARS} scalar and {MAX_VECTORS} vector fields")
        if self.max_docs_per_segment < 1000:
            raise InvalidArgument("max_docs_per_segment must be 1000 or more")
        for f in self.fields:
            f.check()
        return self

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise InvalidArgument(f"unknown field {name!r}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField("_id", T.StringType(), False), *[T.StructField(f.name, f.type.spark()) for f in self.fields]])

    def scalars(self) -> list[str]:
        return [f.name for f in self.fields if not f.type.is_vector]

    def vectors(self) -> list[str]:
        return [f.name for f in self.fields if f.type.is_vector]

    def to_json(self) -> dict:
        return {"name": self.name, "fields": [f.to_json() for f in self.fields], "max_docs_per_segment": self.max_docs_per_segment}

    @staticmethod
    def from_json(x: dict) -> Schema:
        return Schema(x["name"], [Field.from_json(f) for f in x["fields"]], x["max_docs_per_segment"])


def check_key(key: object) -> str:
    """A primary key: UTF-8 of 1..1024 bytes without control characters and line breaks."""
    if not isinstance(key, str) or not 1 <= len(key.encode()) <= MAX_KEY or any(ord(x) < 32 or ord(x) == 127 or x in "  \x85" for x in key):
        raise InvalidArgument(f"bad primary key {key!r}")
    return key


def check_value(f: Field, value: object, partial: bool = False) -> object:
    """A value as Spark stores it; raises if it does not fit the field."""
    if value is None:
        if not f.nullable and not partial:
            raise InvalidArgument(f"{f.name} must not be null")
        return None
    t = f.type
    if t.is_dense:
        out = [float(x) for x in value]
        if len(out) != f.dimension:
            raise InvalidArgument(f"{f.name}: {len(out)} numbers, the dimension is {f.dimension}")
        if t is DataType.VECTOR_INT8:
            if any(x != int(x) or not -128 <= x <= 127 for x in out):
                raise InvalidArgument(f"{f.name}: int8 numbers are needed")
            return [int(x) for x in out]
        if t is DataType.VECTOR_FP16:
            import numpy as np

            return np.array(out, np.float16).astype(float).tolist()
        return out
    if t.is_sparse:
        pairs = sorted((int(k), float(v)) for k, v in dict(value).items())
        if len(pairs) > MAX_SPARSE or any(k < 0 or k >= 2**32 for k, _ in pairs):
            raise InvalidArgument(f"{f.name}: bad sparse vector")
        return {"indices": [k for k, _ in pairs], "values": [v for _, v in pairs]}
    if t.is_array:
        if not isinstance(value, (list, tuple)):
            raise InvalidArgument(f"{f.name}: a list is needed")
        return [check_scalar(f.name, t.element, x) for x in value]
    return check_scalar(f.name, t, value)


def check_scalar(name: str, t: DataType, value: object) -> object:
    from decimal import Decimal

    if t is DataType.STRING and isinstance(value, str) or t is DataType.BOOL and isinstance(value, bool):
        return value
    if t is DataType.BINARY and isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if t.is_integer and isinstance(value, int) and not isinstance(value, bool):
        low, high = NUMERIC_RANGES[t.value]
        if not low <= value <= high:
            raise InvalidArgument(f"{name}: {value} is out of range for {t.value}")
        return Decimal(value) if t is DataType.UINT64 else value
    if t in (DataType.FLOAT, DataType.DOUBLE) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    raise InvalidArgument(f"{name}: {value!r} is not of type {t.value}")
