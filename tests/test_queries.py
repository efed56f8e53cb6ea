"""Every registered query of the engine against its SQL, the way that the driver compares them."""

import duckdb
import pytest

from corvane.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert shown(rows, df.columns) == shown(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_nothing_outside_llm_imports_it():
    import re
    from pathlib import Path

    root = Path(__file__).parent.parent / "corvane"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
