"""Token-ID output: patched frame-of-reference files of a tokenizer's ids.

A file holds whole documents in ascending id order::

    magic "CVPFOR1\\n"
    blocks, each: minimum u32, width u8, exceptions u16, packed residuals,
                  exception positions u16[], exception residuals u32[]
    block starts u64[], document lengths u64[], document ids i64[] with a null mask u8[]
    footer: blocks u64, documents u64, tokens u64, end of blocks u64, magic

A block has BLOCK ids. Its minimum is subtracted and the residuals are packed
with as many bits as PERCENTILE of them need; those that need more stand in the
exception list, whose entries patch the unpacked block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, buffers, claim, release, shared_dir, slices, small_table, stored, word_spans

MAGIC = b"CVPFOR1\n"
BLOCK, PERCENTILE = 4096, 95
#: Ids after which a file ends with the document at hand: about 4 MB, and one row when Spark reads it.
FILE_IDS = 1 << 21
#: Parts of text whose ids a worker remembers and their letters, about 100 MB in all.
CACHE, CACHE_BYTES = 500_000, 16 << 20
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(x) for x in range(0xDF, 0x100) if x != 0xF7)
#: Kinds of bytes: separators, letters, digits, signs, and what only the library cuts.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER, _UPPER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[ord("'")], _KIND[SEPARATOR] = _SIGN, _DIGIT, _LETTER, _UPPER, _OTHER, _SPACE
#: Pieces that show whether a tokenizer cuts and normalises as ``segments`` does.
_PROBES = {"Stra\u00dfe": ["stra\u00dfe"], "\u00c9t\u00e9-A,b": ["\u00e9t\u00e9", "-", "a", ",", "b"], "x10!?": ["x", "1", "0", "!?"], "word_": ["word", "_"]}
_FOOTER = struct.Struct("<4Q8s")


def pack(ids: np.ndarray) -> bytes:
    """One block of unsigned 32-bit ids."""
    if not len(ids):
        return struct.pack("<IBH", 0, 0, 0)
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    bound = int(np.percentile(rest, PERCENTILE, method="inverted_cdf"))
    width = bound.bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    if width in (8, 16, 32):  # whole bytes: the same layout without going through bits
        packed = rest.astype(f"<u{width // 8}").tobytes()
    elif width:
        kept = rest & np.uint32((1 << width) - 1)
        bits = ((kept[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    else:
        packed = b""
    return struct.pack("<IBH", low, width, len(over)) + packed + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack(raw: memoryview, n: int) -> np.ndarray:
    """The n ids of a block."""
    low, width, extra = struct.unpack_from("<IBH", raw)
    at = 7 + (n * width + 7) // 8
    if width in (8, 16, 32):
        ids = np.frombuffer(raw, f"<u{width // 8}", n, 7).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, at - 7, 7), count=n * width, bitorder="little").reshape(n, width)
        wide = np.zeros((n, 4), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        wide[:, : packed.shape[1]] = packed
        ids = wide.view("<u4").reshape(n).astype(np.uint32)
    else:
        ids = np.zeros(n, np.uint32)
    if extra:
        ids[np.frombuffer(raw, "<u2", extra, at)] = np.frombuffer(raw, "<u4", extra, at + 2 * extra)
    return ids + np.uint32(low)


def encode_file(docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents and their ids."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32)
    blocks = [pack(flat[at : at + BLOCK]) for at in range(0, len(flat), BLOCK)]
    starts = len(MAGIC) + np.cumsum([0, *map(len, blocks)])
    tail = starts[:-1].astype("<u8").tobytes() + np.array([len(x) for x in ids], "<u8").tobytes()
    tail += np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
    return b"".join([MAGIC, *blocks, tail, _FOOTER.pack(len(blocks), len(docs), len(flat), int(starts[-1]), MAGIC)])


def decode_file(raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of each document of a file, in the file's order."""
    blocks, docs, tokens, end, magic = _FOOTER.unpack_from(raw, len(raw) - _FOOTER.size)
    if magic != MAGIC or raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    view = memoryview(raw)
    starts = np.frombuffer(raw, "<u8", blocks, end)
    lengths = np.frombuffer(raw, "<u8", docs, end + 8 * blocks)
    names = np.frombuffer(raw, "<i8", docs, end + 8 * (blocks + docs))
    nulls = np.frombuffer(raw, np.uint8, docs, end + 8 * (blocks + 2 * docs))
    flat = np.empty(tokens, np.uint32)
    for k in range(blocks):
        at = k * BLOCK
        flat[at : at + BLOCK] = unpack(view[int(starts[k]) :], min(BLOCK, tokens - at))
    ends = np.cumsum(lengths).astype(np.int64)
    for k in range(docs):
        yield None if nulls[k] else int(names[k]), flat[ends[k] - int(lengths[k]) : ends[k]]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the parts of a batch's texts start and end, which of them are not plain, and the bytes with plain capitals lowered.

    Text is cut at ASCII white space. A piece of Latin letters, ASCII digits and signs (no apostrophe, which may begin a
    contraction) is plain: the tokenizer cuts it into runs of letters, single digits and runs of signs, and so does this.
    Any other piece is one part.
    """
    kind = _KIND[data]
    data = np.where(kind == _UPPER, data + np.uint8(32), data)
    kind[kind == _UPPER] = _LETTER
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        lead = lead[lead + 1 < len(data)]
        tail = data[lead + 1]
        good = (tail != 0x97) & (tail != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = _LETTER
        lift = lead[good & (tail < 0x9F)] + 1
        data[lift] += np.uint8(32)
    start, end = word_spans(data, offsets)
    other = np.flatnonzero(kind == _OTHER)
    hard = np.unique(np.searchsorted(end, other, "right"))
    if len(hard):
        size = end[hard] - start[hard]
        kind[np.repeat(start[hard] - np.cumsum(size) + size, size) + np.arange(size.sum())] = _OTHER
    cut = np.zeros(len(data) + 1, bool)
    cut[start] = True
    inside = kind[1:] != 0
    cut[1:-1] |= inside & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    first = np.flatnonzero(cut)
    cut[first] = False
    stop = cut
    stop[end] = True
    stop[first] |= (first > 0) & (kind[first - 1] != 0)
    last = np.flatnonzero(stop)
    return first, last, kind[first] == _OTHER, data


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Texts are cut where this tokenizer never joins or looks across (see ``segments``). Arrow numbers the distinct
    parts of a batch; each new one is encoded once and its ids are appended to one array, from which numpy gathers all ids
    of the batch. A plain part goes to the library's model in the form that its normaliser gives; any other part takes the
    library's whole path. The parts remembered are CACHE at most, of CACHE_BYTES together; past that, a batch starts anew.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.letters = {ord(x): split.pre_tokenize_str(x)[0][0] for x in _LETTERS}
        self.end = end_id
        self._clear()
        self.plain = all(self._whole([x])[0] == [i for w in parts for i in self._word(w)] for x, parts in _PROBES.items())

    def _clear(self) -> None:
        """Forget all parts; number 0 is the end of a document."""
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.starts = np.array([self.end], np.uint32), np.array([0, 1], np.int32)

    def _whole(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def _numbers(self, distinct: list[str], hard: np.ndarray) -> np.ndarray:
        """The number of each part; new ones are encoded and remembered."""
        number, word = self.number, self._word
        out = np.fromiter((number.get(p, -1) for p in distinct), np.int32, len(distinct))
        new = np.flatnonzero(out < 0)
        if len(new):
            easy, whole = new[~hard[new]].tolist(), new[hard[new]].tolist()
            found = [word(distinct[k]) for k in easy]
            for at in range(0, len(whole), 4096):
                found += self._whole([distinct[k] for k in whole[at : at + 4096]])
            names = [distinct[k] for k in easy + whole]
            first = len(self.starts) - 1
            out[easy + whole] = np.arange(first, first + len(names))
            number.update(zip(names, range(first, first + len(names)), strict=True))
            self.bytes += sum(map(len, names))
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int32)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, each with the end id last, and the n + 1 places where texts begin."""
        data, offsets = buffers(column)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.number) > CACHE or self.bytes > CACHE_BYTES:
            self._clear()
        if self.plain:
            start, end, hard, data = segments(data, offsets)
        else:
            start, end = word_spans(data, offsets)
            hard = np.ones(len(start), bool)
        kept = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=kept[1:])
        solid = data[~SEPARATOR[data]]
        parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(kept), pa.py_buffer(solid)).dictionary_encode()
        index = parts.indices.to_numpy(zero_copy_only=False)
        whole = np.zeros(len(parts.dictionary), bool)
        whole[index[hard]] = True
        known = self._numbers(parts.dictionary.to_pylist(), whole)
        order = np.insert(known[index] if len(index) else known, np.searchsorted(start, offsets[1:]), 0)
        length = np.diff(self.starts)[order]
        place = np.zeros(len(order) + 1, np.int32)  # a batch is a few MB; a longer text has 2^31 letters at most, as any string
        np.cumsum(length, out=place[1:])
        shift = self.starts[order]
        shift -= place[:-1]
        at = np.repeat(shift, length)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], np.concatenate([[0], place[1:][order == 0]]).astype(np.int64)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = claim("tokens", tokenizer, end_id, make=lambda: Encoder(tokenizer, end_id))
        store, root = _filesystem(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        docs, ids, size, number = [], [], 0, 0

        def flush():
            name = f"part-{part:06d}-{number:06d}"
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                out.write(encode_file(docs, ids))
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}.pfor")
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.pfor"]), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64())], ["file", "part", "number", "tokens"])

        for batch in batches:
            for piece in slices(batch, limit=1 << 20):
                flat, at = encoder.encode(piece.column(1))
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    docs.append(doc)
                    ids.append(flat[at[k] : at[k + 1]])
                    size += len(ids[-1])
                    if size >= FILE_IDS:
                        yield flush()
                        docs, ids, size, number = [], [], 0, number + 1
        if docs:
            yield flush()
        docs, ids = [], []
        release()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(decode_file(raw.as_py()))
            lengths = [len(x) for _, x in rows]
            before = np.cumsum([0, *lengths])[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.rsplit("/", 1)[1]] * len(rows)), pa.array([d for d, _ in rows], pa.int64()), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in rows], pa.int64())],
                ["file", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write them below ``folder`` in ascending id order.

    Returns one row per file (file, part, number, tokens, start): ``start`` is the number of
    ids in all files before it. ``folder`` is a URI that every executor reaches.
    A file is written under a name of the attempt and moved, so that a task that runs twice
    leaves one whole file. Null texts are empty and have the end id alone; null ids come
    first; rows that share an id are ordered by text and all written. An empty table writes no file.
    """
    spark = docs.sparkSession
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = docs.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(*order)
    files = stored(ranged.mapInArrow(_writer(tokenizer, end_id, folder), "file string, part long, number long, tokens long"), f"{folder}/manifest-parts")
    totals = {r["part"]: r["tokens"] for r in files.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a task
    offset, offsets = 0, []
    for part in sorted(totals):
        offsets.append((part, offset))
        offset += totals[part]
    parts, bases = zip(*offsets, strict=True) if offsets else ((), ())
    base = small_table(spark, pa.table({"part": pa.array(parts, pa.int64()), "base": pa.array(bases, pa.int64())}), "part long, base long")
    from pyspark.sql import Window

    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(files.join(base, "part").select("file", "part", "number", "tokens", (F.col("base") + within).alias("start")), f"{folder}/manifest")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that write_tokens() wrote."""
    spark = files.sparkSession
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    rows = raw.mapInArrow(_reader, "file string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("file", F.col("start").alias("base")), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back and describe each document.

    Whole texts are encoded, however long; null and empty ones have the end id alone. Null ids come first, rows of one id are in the
    order of their texts (equal rows in any), and each has its own place. An empty table gives no rows; other columns are not read.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    files = write_tokens(docs, folder, tokenizer, end_id, id_col, text_col)
    if files.isEmpty():
        columns = ("doc_id", "start", "n_tokens", "ids_crc32")
        return small_table(docs.sparkSession, pa.table({c: pa.array([], pa.int64()) for c in columns}), ", ".join(f"{c} long" for c in columns))
    return read_tokens(files, folder)
