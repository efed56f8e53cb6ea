"""Mixing: targets against a water-filling in fractions, copies against the prefix sums one by one."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import mixing

from .common import odd, words


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(x) for x in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(out.values())
        level = Fraction(left) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(most * sizes[s])
            open_.discard(s)
    return {s: float(out.get(s, 0)) for s in names}


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="abÄ\U0001f600￿", min_size=0, max_size=3)), st.integers(0, 5000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def check(rows, texts):
    """rows of mix() for documents (id, text, source)."""
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in rows) == sorted((str(d), len(words(t)), str(s)) for d, t, s in texts)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= -int(-rate // 1) or r["copies"] in (int(rate), int(rate) + 1)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return taken, want


def test_documents_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    taken, want = check(mixing.mix(df).collect(), texts)
    for s in want:
        largest = max(len(words(t)) for _, t, x in texts if x == s)
        assert abs(taken[s] - want[s]) <= largest * 1.01 + 1


def test_reruns_and_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = lambda d: sorted((r["doc_id"], r["copies"]) for r in mixing.mix(d).collect())
    assert shown(df) == shown(df.repartition(7, "lang"))


def test_hot_source_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 50)
    rows = [(i, "w " * (1 + i % 40), "hot" if i % 4 else f"s{i % 12}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, want = check(mixing.mix(df).collect(), rows)
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] + 45 for s in want)


def taken_rows(rows):
    """(id, source, size) of mix() as often as it is taken, sorted."""
    return sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in rows for _ in range(r["copies"]))


@pytest.mark.parametrize("span", [2, 20_000])
def test_mixed_documents(spark, monkeypatch, span):
    monkeypatch.setattr(mixing, "SPAN", span)
    # repeated and null ids, of one text and of several
    rows = [(i if i % 7 else None, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(60)] + [(500 + i % 3, "v " * (1 + i % 4), "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), str(r["source"]), len(words(r["text"]))) for r in out.collect())
    assert got == taken_rows(mixing.mix(df).collect())


def test_one_id_for_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 10)
    rows = [(1, "w w w", "a")] * 300 + [(2, "w", "b")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    taken, want = check(got, rows)
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert sorted(r["doc_id"] for r in mixing.mixed_documents(df).collect()) == sorted(r["doc_id"] for r in got for _ in range(r["copies"]))


@pytest.mark.parametrize("span", [7, 20_000])
def test_sql(spark, sf_dir, monkeypatch, span):
    import duckdb

    monkeypatch.setattr(mixing, "SPAN", span)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(mixing.oracle())
    names = [d[0] for d in want.description]
    want = sorted(str(tuple(r)) for r in want.fetchall())
    got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_odd_rows(spark):
    out = mixing.mix(odd(spark)).collect()
    check(out, [(r["doc_id"], r["text"], r["source"]) for r in odd(spark).collect()])
    assert mixing.mix(odd(spark).where("false")).count() == 0
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns
    blank = odd(spark).withColumn("text", F.lit(None).cast("string"))
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mixing.mix(blank).collect())


def test_native(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
