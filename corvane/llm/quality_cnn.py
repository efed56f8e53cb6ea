"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded, and learned filters of WIDTH bytes look at every
STRIDE-th place of the whole document. Each filter is max-pooled within overlapping chunks
(two segments of SEGMENT places, half of them shared with the next chunk); the largest of the
chunks' values are combined into one probability. Memory is bounded by the
text at hand, cut into parts of PART bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers
from .toxicity import _judged, fit_labelled

WIDTH, STRIDE, SEGMENT, FILTERS, EMBED = 16, 2, 64, 32, 6
#: Places between documents, so that no filter sees another document.
SPARE = WIDTH // STRIDE + 1
#: Most labelled documents of each class that the network is fitted on, and passes over them.
FIT_ROWS, EPOCHS = 1500, 10
THRESHOLD = 0.3
#: Bytes that the filters look at together.
PART = 1 << 17
_COLS = WIDTH * EMBED


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents padded to whole segments: bytes (0 beyond an end), first segment of each, places in use of each.

    SPARE places at least stay empty behind each.
    """
    size = offsets[1:] - offsets[:-1]
    places = np.maximum(-(-size // STRIDE), 1)
    segments = -(-(places + SPARE) // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)])
    out = np.zeros(int(first[-1]) * SEGMENT * STRIDE + WIDTH, np.uint8)
    for k in range(len(size)):
        at = int(first[k]) * SEGMENT * STRIDE
        out[at : at + size[k]] = data[offsets[k] : offsets[k + 1]]
    return out, first, places


class Network:
    """Weights and the two passes."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": rng.normal(0, 1 / _COLS**0.5, (_COLS, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(FILTERS, np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, raw: np.ndarray, first: np.ndarray, places: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(segments, FILTERS) maxima of each segment; with ``keep`` also the places within it where they are."""
        total = int(first[-1])
        low, at = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.int64) if keep else None
        used = np.zeros(total, np.int64)
        for k in range(len(places)):
            used[first[k] : first[k + 1]] = np.clip(places[k] - SEGMENT * np.arange(first[k + 1] - first[k]), 0, SEGMENT)
        step = max(1, PART // (SEGMENT * STRIDE))
        for s in range(0, total, step):
            e = min(s + step, total)
            n = (e - s) * SEGMENT
            x = self.p["embed"][raw[s * SEGMENT * STRIDE : e * SEGMENT * STRIDE + WIDTH]]
            cols = np.lib.stride_tricks.as_strided(x, (n, _COLS), (STRIDE * EMBED * 4, 4))
            z = np.maximum(cols @ self.p["filter"] + self.p["bias"], 0).reshape(e - s, SEGMENT, FILTERS)
            for k in np.flatnonzero(used[s:e] < SEGMENT):
                z[k, used[s + k] :] = 0
            if keep:
                at[s:e] = z.argmax(1)
            low[s:e] = z.max(1)
        return low, at

    def combined(self, low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document vectors: the largest over chunks, each of two neighbouring segments of the document; and the chunks."""
        follow = np.minimum(np.arange(len(low)) + 1, np.repeat(first[1:] - 1, np.diff(first)))
        chunk = np.maximum(low, low[follow])
        return np.maximum.reduceat(chunk, first[:-1], axis=0), chunk

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        raw, first, places = layout(data, offsets)
        doc = self.combined(self.pooled(raw, first, places)[0], first)[0]
        return (doc @ self.p["out"] + self.p["last"]).astype(np.float64)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits - self.shift), -30, 30)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        raw, first, places = layout(data, offsets)
        low, at = self.pooled(raw, first, places, keep=True)
        doc, _ = self.combined(low, first)
        score = 1 / (1 + np.exp(-np.clip(doc @ self.p["out"] + self.p["last"], -30, 30)))
        slope = ((score - y) * weight / len(y)).astype(np.float32)
        g = {"out": doc.T @ slope, "last": np.array([slope.sum()], np.float32)}
        # a document's largest value comes from one place of one segment, whichever chunks that is in
        best = np.stack([first[k] + low[first[k] : first[k + 1]].argmax(0) for k in range(len(y))])
        col = np.tile(np.arange(FILTERS), len(y))
        flat = (best * SEGMENT + at[best, np.arange(FILTERS)]).reshape(-1)
        value = (slope[:, None] * self.p["out"] * (doc > 0)).reshape(-1)
        live = value != 0
        flat, col, value = flat[live], col[live], value[live]
        g["bias"] = np.bincount(col, value, FILTERS).astype(np.float32)
        cols = self.p["embed"][raw[flat[:, None] * STRIDE + np.arange(WIDTH)]].reshape(len(flat), _COLS)
        g["filter"] = np.zeros_like(self.p["filter"])
        for f in range(FILTERS):
            mine = col == f
            g["filter"][:, f] = value[mine] @ cols[mine]
        inputs = value[:, None] * self.p["filter"].T[col]
        g_embed = np.zeros((256, EMBED), np.float32)
        for w in range(WIDTH):
            here = raw[flat * STRIDE + w]
            for e in range(EMBED):
                g_embed[:, e] += np.bincount(here, inputs[:, w * EMBED + e], 256)
        g["embed"] = g_embed
        return g


def _packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(texts, pa.string()))


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """Fit a network by Adam on labelled documents; None if one of the classes is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    mean, square, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    rate = 0.02
    for epoch in range(epochs if len(y) > 400 else 3 * epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            some = order[at : at + 32]
            g = net.gradients(*_packed([texts[k] for k in some]), y[some], share[some])
            step += 1
            for k, v in g.items():
                v = v + 1e-4 * net.p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                net.p[k] = (net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        rate *= 0.85
    value = np.concatenate([net.logits(*_packed(texts[at : at + 64])) for at in range(0, len(texts), 64)])
    cuts = np.unique(value)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    # good documents lost count three times: a filter is to leave clean text alone
    wrong = np.array([3 * ((value < c) & (y == 1)).sum() / (y == 1).sum() + ((value >= c) & (y == 0)).sum() / (y == 0).sum() for c in cuts])
    ties = cuts[wrong <= wrong.min() + 1e-12]
    net.shift = float(ties[len(ties) // 2]) + np.log(7 / 3)  # so that 0.3 is the cut
    return net


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                stop = max(int(np.searchsorted(offsets, offsets[at] + 8 * PART, "right")) - 1, at + 1)
                own = offsets[at : stop + 1] - offsets[at]
                score = net.probability(net.logits(data[offsets[at] : offsets[stop]], own)) if net is not None else np.zeros(stop - at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, stop - at), pa.array(score)], ["doc_id", "score"])
                at = stop

    return run


def quality(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a higher score means better text.

    ``labels`` has doc_id and quality; documents of the fold (divisor, remainder of crc32 of the id as text)
    are never learnt from. Whole texts are read, however long; a score that equals the threshold reaches it. A null or empty text is one place of padding and gets the score
    that the network gives to that. Without labels of both classes every score is 0. Rows that repeat an id are scored one
    by one, a null id is not held out, an empty table gives no rows; only doc_id and text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels, "quality", fold, fit_rows, fit))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(rows.mapInArrow(_scores(held), "doc_id long, score double"), fold, threshold)
