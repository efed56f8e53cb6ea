"""Near duplicates against a comparison of all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import common, minhash
from corvane.llm.common import shared_dir
from corvane.llm.components import components

from .common import lowered, odd


def brute(rows, k, percent):
    """component of each row, by all pairs; rows are (id, text)."""
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sets, [None if d is None else low[root(i)] for i, (d, _) in enumerate(rows)]


def texts(seed, n=160):
    """Prose, chains of ever further copies, exact copies, and a group whose members share much."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.randint(1, 90))
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(base)
    return [" ".join(x).replace("w1", "W1") for x in out[:n]]


@pytest.mark.parametrize("k, percent, seed", [(2, 80, 1), (2, 80, 2), (5, 80, 3), (3, 60, 4)])
def test_against_all_pairs(spark, k, percent, seed):
    ids = random.Random(seed).sample(range(1000), 160)
    rows = list(zip(ids, texts(seed), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k, percent).collect()}
    sets, comps = brute(rows, k, percent)
    assert {d: r["component_id"] for d, r in got.items()} == {d: c for (d, _), c in zip(rows, comps, strict=True)}
    assert all(got[d]["n_shingles"] == len(s) and got[d]["kept"] == (got[d]["component_id"] == d) for (d, _), s in zip(rows, sets, strict=True))


def test_documents_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    _, comps = brute(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert got == {d: c for (d, _), c in zip(rows, comps, strict=True)}


def test_odd_rows(spark):
    out = minhash.near_duplicates(odd(spark), 5, 80).collect()
    assert len(out) == 11
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[1]] == [1, 1]
    assert all(r["n_shingles"] == 0 and r["component_id"] == d and r["kept"] for d in (2, 3, 4) for r in by[d])
    assert by[5][0]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    kept = minhash.drop_near_duplicates(odd(spark), 5, 80)
    assert kept.columns == odd(spark).columns and kept.count() == 11
    empty = minhash.near_duplicates(odd(spark).where("false"), 5, 80)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def by_brute(rows, k, percent):
    """(id, component) of every row by all pairs, sorted."""
    _, comps = brute(rows, k, percent)
    return sorted(zip([d for d, _ in rows], comps, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_of_different_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(70), t) for t in texts(seed, 140)] + [(3, "one two three four"), (3, "one two three four")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == by_brute(rows, 2, 80)
    a, b = "some words that stand here in a row and more", "quite another text of as many words as it needs"
    rows = [(0, a), (1, a), (1, b), (7, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(0, 0, True), (1, 0, False), (1, 0, False), (7, 0, False)]


@pytest.mark.parametrize("few, hot", [(0, 1024), (1 << 30, 1024), (4, 4), (24, 2)])
def test_switches_change_no_result(spark, monkeypatch, few, hot):
    """All pairs of a bucket or the rare filter, hot keys split or not: the same components."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(common, "HOT", hot)
    base = [f"v{k}" for k in range(40)]
    rows = list(enumerate(texts(9, 120))) + [(500 + i, " ".join(base[:36] + [f"t{i}x{j}" for j in range(i % 7)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == by_brute(rows, 2, 80)


def test_split_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    left = spark.range(300).selectExpr("id", "if(id % 3 = 0, 5, id % 40) AS k")
    right = spark.range(35).selectExpr("id AS k", "id * 2 AS v")
    want = sorted(map(tuple, left.join(right, "k").select("id", "k", "v").collect()))
    for options in ({}, {"counted": left.select("k")}, {"sizes": left.groupBy("k").count().withColumnRenamed("count", "_n")}):
        assert sorted(map(tuple, common.split_join(left, right, ["k"], ["id"], **options).select("id", "k", "v").collect())) == want
    assert common.split_join(left.where("false"), right, ["k"], ["id"]).count() == 0


def test_groups_of_copies(spark):
    base = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(base[:59] + [f"tail{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, 5, 80).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1
    assert minhash.drop_near_duplicates(df, 5, 80).count() == 1


def strays(copies, seed=3):
    """Exact copies of one text, and near copies of it that stray ever further."""
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(base)) for i in range(copies)]
    for i in range(60):
        near = list(base)
        for _ in range(i % 9):
            near[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(near)))
    return rows


def test_copies_add_no_rows_to_the_rare_filter(spark, monkeypatch):
    """Ids that the id filter lets pass by chance (here nearly all) may be copies of a wanted one: sets and prefixes stay as many."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "FILTER_BITS", 6)
    whole, join, seen = minhash.stored, minhash.split_join, {}

    def stored(df, path):
        out = whole(df, path)
        seen["/".join(path.split("/")[-2:])] = out.count()
        return out

    def split_join(left, right, keys, *args, **options):
        if keys == ["s"]:
            seen["by shingle"] = seen.get("by shingle", 0) + left.count()
        return join(left, right, keys, *args, **options)

    monkeypatch.setattr(minhash, "stored", stored)
    monkeypatch.setattr(minhash, "split_join", split_join)
    counts = []
    for copies in (1, 40):
        seen.clear()
        rows = strays(copies)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == by_brute(rows, 2, 80)
        counts.append((seen["rare/sets"], seen["rare/firsts"]))
        # joins by shingle take prefixes of a fifth of a set alone, not whole sets of 59
        assert 0 < seen["by shingle"] <= seen["rare/sets"] * 13
    assert counts[0] == counts[1]


@pytest.mark.parametrize("places", [0, 4, 22])
def test_shared_places_change_no_result(spark, monkeypatch, places):
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "PLACE_BITS", places)
    rng = random.Random(places)
    rows = strays(5) + [(20_000 + rng.randrange(70), t) for t in texts(7, 100)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == by_brute(rows, 2, 80)


def test_registers():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 800, dtype=np.int64).view(np.uint64)
    a, b = np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.int64).view(np.uint64)]), np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.int64).view(np.uint64)])
    x, y = (minhash.compress(minhash.sketch(s))[None] for s in (a, b))
    got = minhash.estimate(x, y, np.array([900]), np.array([900]))[0]
    assert x.dtype == np.uint16 and abs(got - 0.8) < 6 * (0.16 / minhash.REGISTERS) ** 0.5
    far = rng.integers(0, 1 << 63, 900, dtype=np.int64).view(np.uint64)
    assert minhash.estimate(x, minhash.compress(minhash.sketch(far))[None], np.array([900]), np.array([900]))[0] < 0.05
    assert 0 < minhash.collision(5, 5) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 32) - 1), st.integers(0, (1 << 32) - 1))
def test_compression_keeps_order_of_minima(a, b):
    x, y = minhash.compress(np.array([min(a, b), max(a, b)], np.uint32))
    zeros = lambda v: int(v) >> minhash.MANTISSA
    assert zeros(x) >= zeros(y) and zeros(x) == 32 - min(a, b).bit_length()
    if zeros(x) == zeros(y):
        assert x <= y


@pytest.mark.parametrize("small", [0, 1 << 19])
def test_components(spark, small):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(60)] + [(400, 400 + k) for k in range(50)] + [(5, 5)]
    low = {v: v for e in edges for v in e}
    while True:
        new = dict(low)
        for a, b in edges:
            m = min(new[a], new[b])
            new[a] = new[b] = m
        if new == low:
            break
        low = new
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, shared_dir(spark), small).collect()}
    alone = {v for v in low if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: c for v, c in low.items() if v not in alone}
    assert components(df.where("false"), shared_dir(spark), small).count() == 0


def test_tables_between_have_few_files(spark, monkeypatch, tmp_path):
    """With many more shuffle partitions than documents to fill them, the tables in between are no heap of files of a few rows; the result is the same."""
    rng, rows = random.Random(8), []
    for i in range(400):
        if i % 4:
            near = rows[-1][1].split()
            near[rng.randrange(len(near))] = f"x{i}"
        else:
            near = [f"w{rng.randrange(500)}" for _ in range(40)]
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda: sorted(map(tuple, minhash.near_duplicates(docs, 2, 80).collect()))
    expected, held = result(), {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "shared_dir", lambda spark: f"file://{tmp_path}")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert result() == expected
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {}
    for p in tmp_path.rglob("part-*.parquet"):
        files[p.parent.name] = files.get(p.parent.name, 0) + 1
    assert len(files) > 10 and len({g for _, _, g, _ in expected}) < 300
    assert max(n for name, n in files.items() if name != "classes") <= 2 * spark.sparkContext.defaultParallelism
