"""Benchmark decontamination by latent semantic retrieval and exact checks.

Passages are rows of a TF-IDF matrix over hashed words. A randomised SVD, whose products
run on the executors, gives a latent space. Its term vectors are brought to one length, so that what a language
has in common does not drown its rare words, and passages are centred and whitened in it; every 16-word, 32-word and
64-word passage of every document (half of the longer ones shared with the next) is folded in and held
against all benchmark items by cosine. Candidates are then checked on the words themselves: an item leaks if its longest common
subsequence with the text there covers most of it, or half of it with its answer
(the item's most telling words) present.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, claim, release, shared_dir, slices, stored, word_hashes

BUCKETS, BLOCK, LATENT, EXTRA = 1 << 15, 16, 64, 8
#: Passages without words or direction that stand beside the corpus's own, so that a tiny corpus has weights too.
PRIOR = 256
#: Least cosine of a candidate: with GRIDS, 0.99 of the leaks of a fixture stay, and 0.93 of those of items of 16 to 20 words.
COSINE = 0.35
#: Passages that are searched: blocks in one, and blocks from one to the next.
GRIDS = ((1, 1), (2, 1), (4, 2))
#: Shares of an item: its words found at all, its subsequence, the weaker subsequence, its answer words.
SHARED, WHOLE, PART, ANSWER = 0.5, 0.7, 0.5, 0.8
#: Answer words are this share of an item's distinct words, rarest first.
ANSWER_WORDS = 0.34
#: Words of 512 passages in one bucket from which its sums go by a matrix product.
MANY = 12
_SLICE = 1 << 16


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(49)).astype(np.int64)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Rows of BLOCK buckets with repeats within a row left out: a word counts once a block."""
    rows = np.sort(rows, axis=1)
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = rows[:, 1:] == rows[:, :-1]
    rows[again] = BUCKETS
    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Space:
    """Term vectors of the latent space, and what centres and whitens a passage in it."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray):
        self.weight = weight
        self.table = np.vstack([_unit(terms) * (weight[:, None] ** 2), np.zeros((1, terms.shape[1]))]).astype(np.float32)
        self.mean, self.turn = np.zeros(terms.shape[1], np.float32), np.eye(terms.shape[1], dtype=np.float32)

    def whiten(self, moments: np.ndarray) -> None:
        """From the summed products of [1, passage]; PRIOR passages without direction stand beside them, so that few passages turn little."""
        n = max(moments[0, 0], 1.0)
        share = n / (n + PRIOR)
        mean = moments[0, 1:] / n
        spread = moments[1:, 1:] / n - np.outer(mean, mean)
        mean = share * mean
        values, vectors = np.linalg.eigh(share * spread + (1 - share) * np.eye(len(mean)) / len(mean))
        self.mean = mean.astype(np.float32)
        self.turn = (vectors / np.sqrt(np.maximum(values, max(values.max(), 1e-12) * 1e-6))).astype(np.float32)

    def place(self, sums: np.ndarray) -> np.ndarray:
        """Unit vectors of passages from the sums of their term vectors."""
        return _unit((_unit(sums) - self.mean) @ self.turn)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passage frequency of each bucket, summed per task, and the buckets of all passages, two bytes a word."""
    claim("decontaminate")
    total, passages = np.zeros(BUCKETS, np.int64), 0
    for whole in batches:
        for batch in slices(whole, limit=4 << 20):
            words, at = word_hashes(*buffers(batch.column("text")))
            rows, _, _ = _padded(words, at, 2 * BLOCK)
            if not len(rows):
                continue
            order = np.sort(rows, axis=1)
            new = np.ones(order.shape, bool)
            new[:, 1:] = order[:, 1:] != order[:, :-1]
            total += np.bincount(order[new], minlength=BUCKETS + 1)[:BUCKETS]
            passages += len(rows)
            raw = _distinct(rows.reshape(-1, BLOCK)).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([raw], pa.binary())], ["bucket", "n", "passages"])
    used = np.flatnonzero(total)
    used, n = np.append(used, -1), np.append(total[used], passages)  # -1: all passages
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n), pa.nulls(len(used), pa.binary())], ["bucket", "n", "passages"])


def _padded(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in rows of ``width`` words, BUCKETS where a document has ended; each row's document and first word."""
    n = np.diff(at)
    rows = -(-n // width)
    first = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(int(first[-1]) * width, BUCKETS, np.int64)
    doc = np.repeat(np.arange(len(n)), rows)
    place = np.arange(len(words)) - np.repeat(at[:-1], n) + np.repeat(first[:-1] * width, n)
    out[place] = _buckets(words[at[0] : at[-1]] if len(at) else words)
    return out.reshape(-1, width), doc, (np.arange(int(first[-1])) - first[:-1][doc]) * width


def _add_rows(out: np.ndarray, flat: np.ndarray, z: np.ndarray) -> None:
    """Add row k // (2 * BLOCK) of z to row flat[k] of out, for every k.

    Buckets that many words fall in go by one matrix product, others by their first, second, ... word, each
    round of which has a bucket once.
    """
    order = np.argsort(flat, kind="stable")
    order = order[: np.searchsorted(flat, BUCKETS, sorter=order)]
    if not len(order):
        return
    mine = flat[order]
    heads = np.flatnonzero(np.diff(mine.astype(np.int32), prepend=-1))
    count = np.diff(np.append(heads, len(mine)))
    many = mine[heads[count >= MANY]]
    if len(many):
        slot = np.full(BUCKETS + 1, -1, np.int32)
        slot[many] = np.arange(len(many))
        own = slot[flat]
        some = np.flatnonzero(own >= 0)
        dense = np.bincount(some // (2 * BLOCK) * len(many) + own[some], minlength=len(z) * len(many)).reshape(len(z), -1)
        out[many] += dense.astype(np.float32).T @ z
    few = np.flatnonzero(count < MANY)
    head, count, turn = heads[few], count[few], 0
    while len(head):
        out[mine[head]] += z[order[head + turn] // (2 * BLOCK)]
        turn += 1
        left = count > turn
        head, count = head[left], count[left]


def _product(weights, basis, kind: str):
    """Partial sums over passages, in blocks of 1024 rows: A'(A basis); or products of A basis with itself ("gram"), or of [1, passage in the space] ("space")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = weights.value, basis.value
        table = q.table if kind == "space" else np.vstack([q * idf[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32)
        size = table.shape[1] + (kind == "space")
        out = np.zeros((BUCKETS + 1 if kind == "scatter" else size, size))
        young = np.zeros(out.shape if kind == "scatter" else 0, np.float32)  # half the bytes to move; added up in full precision cell by cell
        for batch in batches:
            for cell in batch.column(0):
                out += young if kind == "scatter" else 0
                young[:] = 0
                whole = np.frombuffer(cell.as_py(), "<u2").reshape(-1, 2 * BLOCK)
                for at in range(0, len(whole), 512):
                    rows = whole[at : at + 512]
                    z = np.concatenate([table[rows[k : k + 256]].sum(1) for k in range(0, len(rows), 256)])  # what is gathered stays in the processor's cache
                    if kind == "scatter":
                        _add_rows(young, rows.reshape(-1), z)
                    else:
                        z = np.hstack([np.ones((len(z), 1), np.float32), _unit(z)]) if kind == "space" else z
                        out += z.T @ z
        if kind == "scatter":
            out += young
            out = (out[:-1] * idf[:, None]).astype(np.float32)  # half the bytes of what is shuffled
        for k in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([out[k : k + 1024].tobytes()], pa.binary())], ["block", "part"])

    return run


def _summed(number):
    def run(table: pa.Table) -> pa.Table:
        total = 0.0
        for raw in table.column("part"):
            total = total + np.frombuffer(raw.as_py(), number).astype(np.float64)
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    return run


def _reduced(passages: DataFrame, idf, basis, kind: str) -> np.ndarray:
    """The product, a matrix of fixed size, on the driver."""
    columns = LATENT + (1 if kind == "space" else EXTRA)
    held = passages.sparkSession.sparkContext.broadcast(basis)
    parts = passages.mapInArrow(_product(idf, held, kind), "block long, part binary")
    got = parts.groupBy("block").applyInArrow(_summed(np.float32 if kind == "scatter" else np.float64), "block long, part binary").orderBy("block").toArrow()
    held.destroy()
    return np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, columns) for x in got["part"]]) if len(got) else np.zeros((0, columns))


def latent_space(docs: DataFrame, path: str) -> Space:
    """The latent space of the passages of ``docs`` (text), every one of which is in the frequencies, the SVD and the moments.

    Randomised SVD: Q spans A'A times a random start; the products of A Q with itself, of fixed size, have the
    singular values and turn Q to the right singular vectors. A core has one partial sum, whatever the corpus's size.
    """
    spark = docs.sparkSession
    seen = stored(docs.select("text").mapInArrow(_counts, "bucket long, n long, passages binary"), f"{path}/counts")
    df, total = np.zeros(BUCKETS), 1
    counts = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    for bucket, n in zip(*(counts.column(c).to_numpy() for c in ("bucket", "n")), strict=True):
        if bucket < 0:
            total = max(n, 1)
        else:
            df[bucket] = n
    weight = np.log((total + PRIOR) / (df + 1)) + 0.1
    idf = spark.sparkContext.broadcast(weight)
    passages = seen.where("passages is not null").select("passages").coalesce(max(2, 2 * spark.sparkContext.defaultParallelism))
    basis = np.random.default_rng(6).normal(size=(BUCKETS, LATENT + EXTRA)) / BUCKETS**0.5
    y = _reduced(passages, idf, basis, "scatter")
    basis = np.linalg.qr(y if len(y) else basis)[0]
    gram = _reduced(passages, idf, basis, "gram")
    values, turn = np.linalg.eigh(gram if len(gram) else np.eye(LATENT + EXTRA))
    values, basis = values[::-1][:LATENT], basis @ turn[:, ::-1][:, :LATENT]
    space = Space(basis / np.sqrt(np.maximum(values, max(values[0], 0) * 1e-9 + 1e-12)), weight)
    moments = _reduced(passages, idf, space, "space")
    if len(moments):
        space.whiten(moments)
    idf.destroy()
    release()
    return space


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    row, full = 0, (1 << len(item)) - 1
    for w in text.tolist():
        m = masks.get(w)
        if m:
            x = row | m
            row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


class Items:
    """Benchmark items ready for the search; grows with the benchmark alone. Words are numbers in the benchmark's own vocabulary."""

    def __init__(self, ids: list[int], texts: list[str | None], space: Space):
        words, at = word_hashes(*buffers(pa.array(texts, pa.string())))
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        numbers = numbers.astype(np.int32)
        rows = [(i, words[at[k] : at[k + 1]], numbers[at[k] : at[k + 1]]) for k, i in enumerate(ids) if at[k + 1] > at[k]]
        self.ids, self.words = [i for i, _, _ in rows], [n for _, _, n in rows]
        sums = np.array([space.table[np.unique(_buckets(w))].sum(0) for _, w, _ in rows]).reshape(-1, LATENT)
        self.vectors = np.ascontiguousarray(space.place(sums).T, np.float32)
        self.answers = []
        for _, w, _ in rows:
            s = np.unique(w)
            rare = s[np.lexsort((s, -space.weight[_buckets(s)]))][: max(1, int(np.ceil(ANSWER_WORDS * len(s))))]
            self.answers.append(set(np.searchsorted(self.vocabulary, rare).tolist()))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word; that of a word which no item has is the vocabulary's size."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1).astype(np.int32)
        at[self.vocabulary[at] != words] = len(self.vocabulary)
        return at

    def verdict(self, k: int, own: np.ndarray) -> tuple[float, float, bool]:
        """Share of the item in its longest common subsequence with a text, share of answer words present, leak or not.

        ``own`` are the text's words that the item has: no other can be in either. The share of answer words is 0 where the subsequence alone rules a leak out.
        """
        size = len(self.words[k])
        if len(own) < PART * size:
            return len(own) / size, 0.0, False
        lcs = common_subsequence(self.words[k], own) / size
        if lcs < PART:
            return lcs, 0.0, False
        answer = len(self.answers[k].intersection(own.tolist())) / len(self.answers[k])
        return lcs, answer, lcs >= WHOLE or answer >= ANSWER


def _found(items: Items, space: Space, batch: pa.RecordBatch) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) of every leak in a batch, with its best subsequence, answer and cosine."""
    words, at = word_hashes(*buffers(batch.column("text")))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    known: dict[tuple[int, int, int], tuple[float, float, bool]] = {}
    rows, doc, start = _padded(words, at, BLOCK)
    words, member = items.numbers(words), np.zeros(len(items.vocabulary) + 1, bool)
    padded = np.append(words, np.full(max(w for w, _ in GRIDS) * BLOCK, len(items.vocabulary), np.int32))
    step = _SLICE // BLOCK
    rows = _distinct(rows)
    blocks = np.concatenate([space.table[rows[k : k + step]].sum(1) for k in range(0, len(rows), step)] or [np.zeros((0, LATENT), np.float32)])
    last = np.cumsum(np.bincount(doc, minlength=len(at) - 1))[doc] - 1 if len(doc) else doc
    index = np.arange(len(rows))
    part = max(1 << 10, (1 << 23) // max(len(items.ids), 1))  # cosines of 32 MB together
    for width, hop in GRIDS:
        heads = index[((start // BLOCK) % hop == 0) & ((index + width - 1 <= last) | (start == 0) | (index + width - hop <= last))]
        place = np.arange(width * BLOCK)
        for k in range(0, len(heads), part):
            head = heads[k : k + part]
            total = blocks[head].copy()
            for j in range(1, width):
                inside = head + j <= last[head]
                total[inside] += blocks[head[inside] + j]
            cosine = space.place(total) @ items.vectors
            near, which = np.nonzero(cosine >= COSINE)
            if not len(near):
                continue
            order = np.argsort(which, kind="stable")
            near, which = near[order], which[order]
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(which) > 0, [True]]))
            d_all = doc[head[near]]
            lo_all = at[d_all] + start[head[near]]
            hi_all = np.minimum(lo_all + width * BLOCK, at[d_all + 1])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                item, some = int(which[a]), near[a:b]
                size, d, lo, hi = len(items.words[item]), d_all[a:b], lo_all[a:b], hi_all[a:b]
                member[items.words[item]] = True
                slot = lo[:, None] + place
                hit = member.take(padded.take(slot))
                short = np.flatnonzero(hi - lo < len(place))
                hit[short] &= slot[short] < hi[short, None]
                for r in np.flatnonzero(np.count_nonzero(hit, axis=1) >= SHARED * min(size, width * BLOCK // 2)).tolist():
                    first, stop = max(int(lo[r]) - size // 2, int(at[d[r]])), min(int(hi[r]) + size // 2, int(at[d[r] + 1]))
                    if (verdict := known.get((item, first, stop))) is None:
                        span = words[first:stop]
                        verdict = known[item, first, stop] = items.verdict(item, span[member[span]])
                    lcs, answer, leak = verdict
                    if leak:
                        key = int(d[r]), item
                        best = float(round(lcs, 6)), float(round(answer, 6)), float(cosine[some[r], item])
                        found[key] = max(found.get(key, best), best)
                member[items.words[item]] = False
    return found


def _search(held, folding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                found = _found(held.value, folding.value, batch)
                keys = sorted(found)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([k for k, _ in keys])), pa.array([held.value.ids[i] for _, i in keys], pa.int64()), *[pa.array([round(found[k][j], 4) for k in keys], pa.float64()) for j in range(3)]],
                        ["doc_id", "item_id", "lcs", "answer", "cosine"],
                    )

    return run


def _clean(held, folding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):  # what a search needs beside the texts is many times their size
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in _found(held.value, folding.value, batch)]] = False
                yield batch.filter(pa.array(keep))
        release()

    return run


def _fitted(docs: DataFrame, benchmark: DataFrame) -> tuple:
    """Broadcast items and space. The benchmark is a fixed, small table (its size does not follow the corpus) and is held by every task."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").collect()
    space = latent_space(docs, shared_dir(spark))
    return spark.sparkContext.broadcast(Items([r["item_id"] for r in items], [r["text"] for r in items], space)), spark.sparkContext.broadcast(space)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine) of every document and item that it leaks, each once a row of ``docs``.

    Whole texts are searched, however long, passage by passage. Null or empty texts and items match nothing; a null
    doc_id is reported as null; rows that repeat are reported one by one, items that repeat count each by
    its id. Shares at a limit count as reached. An empty table gives no rows; only doc_id, item_id and the texts are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_search(*_fitted(docs, benchmark)), "doc_id long, item_id long, lcs double, answer double, cosine double")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns stay as they are.

    Each row is judged by its own text, whatever its id: rows of a null or repeated id are like any other. Null and
    empty texts stay, an empty table gives no rows, and an empty benchmark drops none. No text is shuffled.
    """
    return docs.mapInArrow(_clean(*_fitted(docs.select(F.col("text").cast("string").alias("text")), benchmark)), docs.schema)
