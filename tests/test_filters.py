"""Filter texts against a Python evaluation of three-valued logic, and every error that a schema calls for."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.errors import InvalidArgument
from corvane.plans.filters import MAX_CONTAIN, MAX_RELATIONS, compile_filter, parse
from corvane.types import DataType as D
from corvane.types import Field, Index, IndexType, Schema

SCHEMA = Schema(
    "t",
    [
        Field("id", D.INT64),
        Field("age", D.INT32, True),
        Field("name", D.STRING),
        Field("ok", D.BOOL),
        Field("score", D.DOUBLE),
        Field("big", D.UINT64),
        Field("tags", D.ARRAY_STRING, True),
        Field("nums", D.ARRAY_INT32, True),
        Field("raw", D.BINARY, True),
        Field("text", D.STRING, True, 0, Index(IndexType.FTS)),
        Field("v", D.VECTOR_FP32, True, 2),
        Field("a-b", D.INT32, True),
    ],
)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(60):
        name = "user-" + ("%" if i % 3 == 1 else "_" if i % 3 == 2 else "") + str(i % 10)
        nums = None if i % 10 == 0 else list(range(1, i % 10 + 1))
        data.append((i, None if i % 7 == 0 else i % 7, name, i % 2 == 0, i / 4, Decimal(i), None if nums is None else [f"n{x}" for x in nums], nums, b"x", "hello", i if i % 5 else None))
    df = spark.createDataFrame(data, "id long, age int, name string, ok boolean, score double, big decimal(20,0), tags array<string>, nums array<int>, raw binary, text string, `a-b` int")
    return df.cache(), data


def ids(rows, text):
    return sorted(r[0] for r in rows[0].where(compile_filter(text, SCHEMA)).select("id").collect())


@pytest.mark.parametrize(
    "text, keep",
    [
        ("age = 3", lambda r: r[1] == 3),
        ("age != 3", lambda r: r[1] is not None and r[1] != 3),
        ("age < = 3", lambda r: r[1] is not None and r[1] <= 3),
        ("age > 3 and ok = TRUE", lambda r: r[1] is not None and r[1] > 3 and r[3]),
        ("id < 5 OR id > 50 AND age = 1", lambda r: r[0] < 5 or (r[0] > 50 and r[1] == 1)),
        ("(id < 5 OR id > 50) AND age = 1", lambda r: (r[0] < 5 or r[0] > 50) and r[1] == 1),
        ("age IN (1, 2)", lambda r: r[1] in (1, 2)),
        ("age NOT IN (1, 2)", lambda r: r[1] is not None and r[1] not in (1, 2)),
        ("name IN ('user-0', \"user-%1\")", lambda r: r[2] in ("user-0", "user-%1")),
        ("name LIKE 'user-1%'", lambda r: r[2].startswith("user-1")),
        (r"name LIKE 'user-\%%'", lambda r: r[2].startswith("user-%")),
        (r"name LIKE 'user-\__'", lambda r: r[2].startswith("user-_") and len(r[2]) == 7),
        ("name LIKE '%7'", lambda r: r[2].endswith("7")),
        ("age IS NULL", lambda r: r[1] is None),
        ("age is not null -- comment", lambda r: r[1] is not None),
        ("age IS NULL OR /* c */ age = 2", lambda r: r[1] is None or r[1] == 2),
        ("nums CONTAIN_ALL (1, 4)", lambda r: r[7] is not None and {1, 4} <= set(r[7])),
        ("nums contain_any (7, 9)", lambda r: r[7] is not None and bool({7, 9} & set(r[7]))),
        ("nums NOT CONTAIN_ALL (1, 4)", lambda r: r[7] is not None and not {1, 4} <= set(r[7])),
        ("tags NOT CONTAIN_ANY ('n5')", lambda r: r[6] is not None and "n5" not in r[6]),
        ("nums CONTAIN_ANY ()", lambda r: False),
        ("nums NOT CONTAIN_ALL ()", lambda r: False),
        ("nums CONTAIN_ALL ()", lambda r: r[7] is not None),
        ("nums NOT CONTAIN_ANY ()", lambda r: r[7] is not None),
        ("array_length(nums) >= 4", lambda r: r[7] is not None and len(r[7]) >= 4),
        ("array_length(tags) != 2", lambda r: r[6] is not None and len(r[6]) != 2),
        ("score >= 3 AND score < 7.25e0", lambda r: 3 <= r[4] < 7.25),
        ("big > 58", lambda r: r[5] > 58),
        ("a-b = 4", lambda r: r[10] == 4),
        ("raw IS NOT NULL", lambda r: True),
    ],
)
def test_rows(rows, text, keep):
    assert ids(rows, text) == [r[0] for r in rows[1] if keep(r)]


@pytest.mark.parametrize(
    "text",
    [
        "missing = 1", "v = 1", "text = 'a'", "ok > TRUE", "age = 'x'", "age = 1.5", "name = 1", "nums = 1", "raw = 'x'", "age LIKE '1'", "name LIKE 1",
        "NOT age = 1", "name NOT LIKE 'x'", "age BETWEEN 1 AND 2", "age == 1", "age <> 1", "age = id", "age + 1 = 2", "age IN ()", "age =", "(age = 1", "age = 1 extra = 2",
        "array_length(nums) = 1.0", "array_length(age) = 1", "age CONTAIN_ANY (1)", "nums CONTAIN_ANY ('a')", "age = 99999999999", "big = -1", "id = 1 OR (id = 2 AND missing = 3)", "name = 'open",
    ],
)
def test_errors(text):
    with pytest.raises(InvalidArgument):
        compile_filter(text, SCHEMA)


def test_limits():
    assert parse(" OR ".join(["id = 1"] * MAX_RELATIONS)).kind == "or"
    with pytest.raises(InvalidArgument):
        parse(" OR ".join(["id = 1"] * (MAX_RELATIONS + 1)))
    with pytest.raises(InvalidArgument):
        compile_filter("nums CONTAIN_ANY (" + ",".join(["1"] * (MAX_CONTAIN + 1)) + ")", SCHEMA)
    assert compile_filter(None, SCHEMA) is None and compile_filter("  ", SCHEMA) is None


def _kleene(op, a, b):
    if op == "AND":
        return False if a is False or b is False else None if a is None or b is None else True
    return True if a is True or b is True else None if a is None or b is None else False


_LEAF = st.builds(lambda op, v: (f"age {op} {v}", op, v), st.sampled_from(["=", "!=", "<", ">="]), st.integers(0, 7))
_TREE = st.recursive(_LEAF, lambda x: st.tuples(st.sampled_from(["AND", "OR"]), x, x), max_leaves=6)


def _text(t):
    return t[0] if t[0] not in ("AND", "OR") else f"({_text(t[1])} {t[0]} {_text(t[2])})"


def _value(t, age):
    if t[0] in ("AND", "OR"):
        return _kleene(t[0], _value(t[1], age), _value(t[2], age))
    if age is None:
        return None
    return {"=": age == t[2], "!=": age != t[2], "<": age < t[2], ">=": age >= t[2]}[t[1]]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_TREE)
def test_any_tree(rows, tree):
    got = rows[0].select("id", "age", compile_filter(_text(tree), SCHEMA).alias("x")).collect()
    assert all(r["x"] == _value(tree, r["age"]) for r in got)


def test_filters_reach_the_scan(spark, sf_dir):
    schema = Schema("p", [Field("p_size", D.INT32), Field("p_brand", D.STRING)])
    df = spark.read.parquet(f"{sf_dir}/part.parquet").where(compile_filter("p_size > 10 AND p_brand = 'Brand#12'", schema)).select("p_size")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in plan and "EqualTo(p_brand,Brand#12)" in plan and "ReadSchema: struct<p_brand:string,p_size:int>" in plan


def test_long_chains(rows):
    assert ids(rows, " OR ".join(f"id = {i}" for i in range(600))) == list(range(60))
    assert rows[0].where(F.lit(True)).count() == 60
