"""The lookup table by a second filling, its balance and its stability, and placement against hashlib."""

import hashlib
from collections import Counter

import pytest

from corvane.llm import sharding

from .common import odd


def digest(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def test_table_by_turns():
    names, slots = ("a", "b", "c"), 13
    prefer = [[(digest(f"offset:{s}") % slots + j * (digest(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    table = [None] * slots
    while None in table:
        for k in range(3):
            free = next((x for x in prefer[k] if table[x] is None), None)
            if free is not None:
                table[free] = k
    assert sharding.lookup_table(names, slots) == table


def test_balance_and_stability():
    table = sharding.lookup_table()
    share = Counter(table)
    assert len(share) == 64 and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 63)
    assert moved < 0.1 * len(table)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 12)


def test_placement(spark, tmp_path):
    df = odd(spark)
    table = sharding.lookup_table()
    got = sharding.assign_shards(df)
    for r in got.collect():
        slot = digest("" if r["doc_id"] is None else str(r["doc_id"])) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert got.count() == 11 and sharding.assign_shards(df.where("false")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan
    sharding.write_shards(df, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 11 and back.drop("_shard").columns == df.columns
