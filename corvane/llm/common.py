"""Helpers shared by the training-data operators.

Nothing here holds a corpus in one process: the numpy kernels work on one
Arrow batch, and intermediate tables go to the folder that all executors share.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, work_dir

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes that one call of the word kernel looks at; longer words are still whole.
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Which bytes separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; ``scratch`` deletes it at its end, or else the end of the driver does."""
    path = work_dir(spark)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``shared_dir`` makes inside are deleted at the end, when the results made from them have been written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def release() -> None:
    """Hand freed memory back to the machine: workers live on between tasks, and an executor's memory is bounded."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_HELD: dict[tuple, object] = {}


def claim(name: str, *key, make=lambda: None):
    """What an operator remembers in this worker process from task to task, made anew for another key; what other operators remember here is dropped."""
    own = (name, *key)
    if own not in _HELD:
        _HELD.clear()
        release()
        _HELD[own] = make()
    return _HELD[own]


#: Rows of the corpus for which ``files_for`` allows a file.
FILE_ROWS = 4096


def files_for(spark: SparkSession, rows: int) -> int | None:
    """How many files an intermediate table of a corpus of ``rows`` is to have; None, one a partition, unless the session has far more partitions than the corpus fills.

    Files of a few rows each cost their executor a process on a local disk (Hadoop's chmod), at whose start the JVM's memory counts twice.
    """
    files = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return files if 2 * files < int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, files: int | None) -> DataFrame:
    """``df`` to be written as so many files, its rows dealt by turns; the work before is split as it was. The rows must not depend on the order in which a task meets them."""
    return df.repartition(files) if files else df


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, table: pa.Table, schema) -> DataFrame:
    """A table of the driver as a DataFrame. From Python rows Spark would make it in a second set of Python workers, which then stay beside the others."""
    return spark.createDataFrame(table, schema)


#: A key with more than one in so many rows is dealt to several tasks by ``split_join``.
HOT = 1024


def split_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys)`` where ``right`` has each key about once, and ``left`` may have one for a third of its rows.

    Keys with more than one in HOT of the left rows (fewer than HOT keys, named on the driver) are salted by a digest of the
    columns ``by``: their left rows are dealt to so many parts that each is about as large, and
    their right rows are copied to each. Without such keys this is the plain join. The keys are counted in ``left``, in
    ``counted`` (a narrower table with the same keys, where left is costly), or given with their numbers ``_n`` as ``sizes``.
    """
    if sizes is None:
        sizes = (left if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    parts = F.ceil(F.col("_n") * HOT / F.lit(max(total, 1))).cast("int")
    hot = sizes.select(*keys, parts.alias("_parts")).where("_parts > 1")
    rows = hot.toArrow() if total > 16 * HOT else None
    if not rows:
        return left.join(right, keys)
    hot = F.broadcast(small_table(left.sparkSession, rows, hot.schema))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def words_column(text: Column | str) -> Column:
    """array<string> of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null text: no words."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " ", -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column | str) -> Column:
    """Number of words as a long."""
    return F.size(words_column(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; a row's border ends a word too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] |= inside[borders]
    last[borders - 1] |= inside[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of a batch, and the n + 1 places where the rows' words begin.

    Words are hashed by differences of prefix sums, CHUNK bytes at a time, so
    that no loop over words or characters runs in Python.
    """
    start, end = word_spans(data, offsets)
    out = np.empty(len(start), _U)
    at = 0
    while at < len(start):
        base = start[at]
        stop = max(int(np.searchsorted(end, base + CHUNK, "right")), at + 1)
        piece = data[base : end[stop - 1]]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, _U)
        np.cumsum((_LOWER[piece] if lower else piece).astype(_U) * up[: len(piece)] + up[: len(piece)], out=sums[1:])
        s, e = start[at:stop] - base, end[at:stop] - base
        out[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        at = stop
    return out, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a row's k-word shingles; fewer words count as one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, width * 0x2545F4914F6CDD1D & (1 << 64) - 1, _U)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _U((0x9FB21C651E98DF25 * (2 * j + 1)) & (1 << 64) - 1)
    total = np.sort(mix64(total))
    keep = np.ones(len(total), bool)
    keep[1:] = total[1:] != total[:-1]
    return total[keep]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text; a longer row is a part alone."""
    _, offsets = buffers(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, stop - at)
        at = stop
