"""Sharding by a permutation-filled lookup table (Maglev hashing), in DataFrame operations alone.

Shards take turns claiming the next free slot of their own preference order in a
table of prime size. A document's key is hashed to a slot, and the broadcast
table, whose size is a constant, gives its shard. When a shard is added or goes, few other
slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. ``slots`` is prime and at least a hundred times the shards for even shares."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("distinct shards, no more than slots, are needed")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    steps = [(_digest(f"offset:{s}") % slots, _digest(f"skip:{s}") % (slots - 1) + 1) for s in shards]
    table, at, filled = [-1] * slots, [offset for offset, _ in steps], 0
    while filled < slots:
        for k, (_, skip) in enumerate(steps):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + skip) % slots
            table[slot], at[k] = k, (slot + skip) % slots
            filled += 1
            if filled == slots:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key has the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(slots)


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the lookup table; as many rows as slots."""
    packed = b"".join(k.to_bytes(2, "big") for k in lookup_table(shards, slots))
    number = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    return spark.range(0, slots, 1, 1).select(F.col("id").alias("slot"), number.alias("shard"))


def assign_shards(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, slot, shard) for every row of ``docs``; ``shard`` is the shard's place in ``shards``.

    No row moves: the table of ``slots`` rows is broadcast, which is a fixed size. Rows that
    share a key share a shard, null keys are one key, an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), slot_of(F.col(id_col), slots).alias("slot"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet below ``path``, one folder a shard (``_shard=N``), straight from the tasks that read them."""
    table = F.broadcast(table_frame(docs.sparkSession, shards, slots).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard")))
    docs.withColumn("_slot", slot_of(docs[id_col], slots)).join(table, "_slot").drop("_slot").write.mode("overwrite").partitionBy("_shard").parquet(path)


def oracle(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL of assign_shards() over documents."""
    packed = "".join(f"{k:04x}" for k in lookup_table(shards, slots))
    return f"""SELECT doc_id, slot, CAST('0x' || substr(packed, CAST(slot * 4 + 1 AS BIGINT), 4) AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {slots} AS slot FROM documents),
     (SELECT '{packed}' AS packed)"""
