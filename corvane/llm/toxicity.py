"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are compared by their gapped three-letter subsequences: letters at most SPAN
apart in all, each gap damped by DECAY, with marks at both ends of a word. An insult
with letters put in or left out shares most of these with the insult itself. A word of more than LENGTH letters
is read in overlapping windows of several widths, and in its parts between signs.
What is classified is a sentence, read in windows of WORDS words (half of them shared with the next) and in each of its words alone: its kernel value with
a landmark is the largest that one of the words has, so that an insult of several words, each harmless, is more than
its words, and one that is a word is not lost among harmless ones. These values, mapped by the inverse root of the landmarks' own kernel matrix, are the features of
a linear support vector machine. A document has the value of its strongest sentence; training takes the strongest
sentence of a toxic document as positive and the strongest ones of other documents as negative, round by round.
A word whose largest kernel value lies under SCREEN is unlike every landmark: it is orthogonal to all of them.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices, word_hashes, word_spans

#: Most labelled documents of each class that the machine is fitted on, taken by a digest of their id.
FIT_ROWS = 1500
TOXIC_LANDMARKS, PHRASE_LANDMARKS, CLEAN_LANDMARKS = 160, 32, 96
#: Least log-likelihood ratio (chi squared of one degree of freedom) of a landmark string: a chance of 8e-6.
BEYOND_CHANCE = 20.0
#: Words of a window of a sentence.
WORDS = 16
SPAN, DECAY, POWER, LENGTH = 5, 0.6, 2, 20
#: Windows of a word of more than LENGTH letters, and their steps: narrow ones, so that an insult is not lost among the letters beside it.
WINDOWS = ((8, 1), (12, 2), (LENGTH, 5))
#: Largest subsequence similarity under which a word counts as unlike every landmark: its kernel values are 0.
SCREEN = 0.5
#: Landmarks that share one bound in the second screen.
BUNDLE = 16
#: Words that a worker remembers; past that it begins anew.
CACHE = 1_000_000
THRESHOLD = 0.3

_LEET = str.maketrans({"1": "i", "!": "i", "0": "o", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"})
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\x0c\r]+|\n+")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_SIGNS = re.compile(r"[\W_]+")
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?"]] = True
_EDGES = ".,;:!?\"'()[]{}<>*#%&|"
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]
_WEIGHTS = [np.float32(DECAY ** (a + b - 2)) for a, b in _STEPS]


def spaced(text: str | None) -> str:
    """A text in lower case; letters standing alone in a row are written as one word."""
    return _SPACED.sub(lambda m: "".join(m[0].split()), (text or "").lower())


def windows(text: str) -> Iterator[list[str]]:
    """The words of each window of each sentence of a text that ``spaced`` gave."""
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence)
        for at in range(0, max(len(words) - WORDS // 2, 1), WORDS // 2):
            yield words[at : at + WORDS]


def letters(word: str) -> str:
    """A word's letters, with digits and signs that stand for letters read so."""
    word = word.strip(_EDGES)
    if not word.isalpha():
        word = "".join(x for x in word.translate(_LEET) if x.isalpha())
    return word


def pieces(word: str) -> Iterator[str]:
    """What the kernel sees of a word: its letters, or all windows and parts of LENGTH letters at most if there are more."""
    whole = letters(word)
    if len(whole) <= LENGTH:
        yield whole
        return
    for width, step in WINDOWS:
        for at in range(0, len(whole) - width, step):
            yield whole[at : at + width]
        yield whole[-width:]
    for part in _SIGNS.split(word):
        if 0 < len(x := letters(part)) <= LENGTH:
            yield x


def _codes(words: list[str]) -> np.ndarray:
    """(words, longest + 2) letter codes below 64, with a mark 1 at both ends and -1 beyond."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), max(size.max(initial=0) + 2, SPAN + 1)), -1, np.int32)
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    place = np.arange(out.shape[1])
    out[(place > 0) & (place <= size[:, None])] = np.where((point >= 97) & (point <= 122), point - 95, 28 + point % 36)
    out[:, 0] = out[np.arange(len(words)), size + 1] = 1
    return out


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (words, places) and weights; a place that a word lacks has weight 0."""
    codes = _codes(words)
    index, weight = [], []
    for (a, b), w in zip(_STEPS, _WEIGHTS, strict=True):
        x, y, z = codes[:, : -a - b], codes[:, a:-b], codes[:, a + b :]
        index.append((x << 12) + (y << 6) + z)
        weight.append(np.where(z >= 0, w, np.float32(0)))
    index, weight = np.concatenate(index, 1), np.concatenate(weight, 1)
    index[weight == 0] = 0
    norm = np.sqrt((weight * weight).sum(1, keepdims=True))
    return index, weight / np.maximum(norm, np.float32(1e-6))


class Machine:
    """A fitted machine; small enough to travel to every task (landmarks' features and a few vectors)."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        index, weight = _features(landmarks)
        used, place = np.unique(index, return_inverse=True)
        self.used = used.astype(np.int32)
        self.table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        np.add.at(self.table, (place.reshape(index.shape), np.arange(len(landmarks))[:, None]), weight)
        own = self._raw(index, weight) ** POWER
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        values, vectors = values[values > 1e-4], vectors[:, values > 1e-4]
        self.root = (vectors / np.sqrt(values)).astype(np.float32)
        self.alpha, self.bias, self.scale, self.shift = np.zeros(len(landmarks), np.float32), -1.0, 4.0, 0.0
        self._ready()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "most", "bundles")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self.place = np.full(1 << 18, len(self.used), np.int32)
        self.place[self.used] = np.arange(len(self.used), dtype=np.int32)
        self.most = self.table.max(1)
        # like landmarks stand together, so that a bundle's largest weights are hardly above those of one of them
        order = np.argsort(self.table.T @ self.table.sum(1), kind="stable") if len(self.landmarks) < 3 else np.lexsort(self._nearest())
        parts = [order[at : at + BUNDLE] for at in range(0, len(order), BUNDLE)]
        self.bundles = np.stack([self.table[:, p].max(1) for p in parts], 1)

    def _nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys that sort landmarks along the two main directions of their features."""
        values, vectors = np.linalg.eigh(self.table.T @ self.table)
        return vectors[:, -3], vectors[:, -2]

    def _raw(self, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = getattr(self, "place", None)
        rows = np.searchsorted(self.used, index) if at is None else at[index]
        return np.einsum("np,npm->nm", weight, self.table[rows], optimize=False)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words (as ``pieces`` gives them) the screen holds like a landmark, and their kernel values with all landmarks."""
        places, rows = [], []
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")  # words of one length waste no places
        order = order[size[order] > 0]
        for at in range(0, len(order), 1024):
            own = order[at : at + 1024]
            index, weight = _features([words[k] for k in own])
            seen = self.place[index]
            some = np.flatnonzero((weight * self.most[seen]).sum(1) >= SCREEN)
            some = some[np.einsum("np,npb->nb", weight[some], self.bundles[seen[some]]).max(1, initial=0) >= SCREEN]
            for part in np.array_split(some, max(1, len(some) // 128)):
                if len(part):
                    raw = self._raw(index[part], weight[part])
                    like = raw.max(1) >= SCREEN
                    places.append(own[part[like]])
                    rows.append(raw[like] ** POWER)
        if not rows:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        return np.concatenate(places), np.concatenate(rows)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are like a landmark, and their kernel values: the largest over a word's pieces."""
        places, rows = [], []
        parts = ((k, x) for k, w in enumerate(words) for x in pieces(w))
        while some := list(islice(parts, 16_384)):
            at, own = self.near([x for _, x in some])
            place = np.array([some[k][0] for k in at.tolist()], np.int64)
            order = np.argsort(place, kind="stable")  # the next pieces are of the same word or of later ones
            places.append(place[order])
            rows.append(own[order])
        place = np.concatenate([*places, np.zeros(0, np.int64)])
        if not len(place):
            return place, np.zeros((0, len(self.landmarks)), np.float32)
        rows = np.concatenate(rows)
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        if len(heads) == len(place):
            return place, rows
        out, many = rows[heads], np.flatnonzero(np.diff(heads, append=len(place)) > 1)  # few words have several pieces
        for k in many.tolist():
            out[k] = rows[heads[k] : heads[k + 1] if k + 1 < len(heads) else None].max(0)
        return place[heads], out

    def values(self, rows: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The value of each sentence: ``flat`` holds, ``size`` at a time, the rows of its words that are like a landmark."""
        out = np.full(len(size), self.bias, np.float32)
        heads = np.cumsum(size) - size
        for n in np.unique(size[size > 0]).tolist():
            mine = np.flatnonzero(size == n)
            for at in range(0, len(mine), 1024):
                part = mine[at : at + 1024]
                out[part] += pooled(rows, flat[heads[part][:, None] + np.arange(n)]) @ self.alpha
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (value - self.shift), -30, 30)))


def pooled(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The largest of the rows that each row of ``which`` names."""
    out = rows[which[:, 0]]
    for k in range(1, which.shape[1]):
        np.maximum(out, rows[which[:, k]], out=out)
    return out.astype(np.float32, copy=False)


def _train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active] * cost
        new = np.linalg.solve(reg + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _marks(bad: Counter, good: Counter, n_bad: int, n_good: int) -> dict:
    """Log-likelihood ratio (G squared) of what toxic sentences have more often than others; what they have less often is left out."""
    share, out = n_bad / (n_bad + n_good), {}
    for x, n in bad.items():
        g = good[x]
        if n > share * (n + g):
            out[x] = 2 * (n * np.log(n / (share * (n + g))) + (g * np.log(g / ((1 - share) * (n + g))) if g else 0.0))
    return out


def _best(marks: dict, most: int) -> list:
    return sorted((x for x, v in marks.items() if v >= BEYOND_CHANCE), key=lambda x: (-marks[x], x))[:most]


def _landmarks(sentences: dict[tuple[str, ...], set[int]], parts: dict[str, list[str]]) -> tuple[list[str], dict[str, float], Counter]:
    """Strings that mark toxic sentences beyond chance, all strings' marks, and how many other sentences have each string.

    Counted over distinct sentences, so that copies of a document are no evidence. Beside single strings come
    those of neighbouring words that mark toxic sentences as a pair though neither does alone.
    """
    bag = lambda s: {x for w in s for x in parts[w]}  # noqa: E731 -- made when counted: those of all sentences are several times the texts
    count = lambda y, have: Counter(x for s, labels in sentences.items() if y in labels for x in have(s))
    total = [sum(y in labels for labels in sentences.values()) for y in (0, 1)]
    n_good = count(0, bag)
    marks = {x: v for x, v in _marks(count(1, bag), n_good, total[1], total[0]).items() if len(x) > 2}
    toxic = _best(marks, TOXIC_LANDMARKS) or sorted(marks, key=lambda x: (-marks[x], x))[:1]
    told = set(toxic)
    calm = {w for w, own in parts.items() if own and not told.intersection(own)}
    pairs = lambda s: {(a, b) for a, b in zip(s, s[1:], strict=False) if a in calm and b in calm}
    bad = count(1, pairs)
    phrases = _best(_marks(bad, count(0, lambda s: pairs(s) & bad.keys()), total[1], total[0]), PHRASE_LANDMARKS)
    return list(dict.fromkeys(toxic + [x for p in phrases for w in p for x in parts[w]][:PHRASE_LANDMARKS])), marks, n_good


def fit(texts: list[str | None], labels: list[int], rounds: int = 5) -> Machine | None:
    """Fit a machine on the sentences of labelled documents; None if one of the classes is missing or no string marks the toxic one."""
    if len(set(labels)) < 2:
        return None
    one: dict = {}
    docs = [[tuple(one.setdefault(w, w) for w in x) for x in windows(spaced(t))] for t in texts]
    sentences: dict[tuple[str, ...], set[int]] = {}
    for d, label in zip(docs, labels, strict=True):
        for x in d:
            sentences.setdefault(x, set()).add(label)
    parts = {w: [one.setdefault(x, x) for x in pieces(w) if x] for w in sorted({w for x in sentences for w in x})}
    toxic, marks, n_good = _landmarks(sentences, parts)
    del sentences  # what is not needed any more goes: a worker's memory counts beside its executor's
    if not toxic:
        return None
    # clean landmarks: the words of clean documents that are most like a toxic one
    probe = Machine(toxic)
    pool = [w for w, n in sorted(n_good.items(), key=lambda x: (-x[1], x[0]))[:60_000] if len(w) > 2]
    like, near = np.zeros(len(pool)), probe.near(pool)
    like[near[0]] = near[1].max(1)
    clean = [pool[k] for k in np.lexsort((np.arange(len(pool)), -like))[:CLEAN_LANDMARKS]]
    del pool, n_good
    machine = Machine(list(dict.fromkeys(toxic + clean)))

    words = list(parts)
    seen, kernel = machine.words(words)
    row = dict(zip((words[k] for k in seen.tolist()), range(len(seen)), strict=True))
    number: dict[tuple[int, ...], int] = {(): 0}  # 0: a sentence without a word like a landmark
    like = [[sorted({row[w] for w in x if w in row}) for x in d] for d in docs]
    own = [np.array(sorted({number.setdefault(x, len(number)) for s in d for x in (tuple(s), *((k,) for k in s))} | {0})) for d in like]
    sets = list(number)
    del docs, like, number
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter(chain.from_iterable(sets), np.int64, int(size.sum()))
    told = np.array([max((marks.get(x, 0.0) for x in parts[words[k]]), default=0.0) for k in seen.tolist()] or [0.0])
    value = np.array([told[list(x)].sum() if x else 0.0 for x in sets])  # at first the sentences with most such strings
    y, pool_neg = np.array(labels), {0}
    for _ in range(rounds):
        strongest = np.array([s[np.argmax(value[s])] for s in own])
        for s, label in zip(own, y, strict=True):
            if not label:
                pool_neg.update(s[np.argsort(-value[s], kind="stable")[:3]].tolist())
        neg = np.array(sorted(pool_neg - {0}), np.int64)
        pos, count = np.unique(strongest[y == 1], return_counts=True)
        pos, count = pos[pos > 0], count[pos > 0]
        some = np.concatenate([pos, neg])
        x = np.zeros((len(some) + 1, machine.root.shape[1] + 1))  # the last row: no word like a landmark
        x[:, -1] = 1
        for row_of, k in enumerate(some.tolist()):
            x[row_of, :-1] = kernel[list(sets[k])].max(0) @ machine.root
        target = np.concatenate([np.ones(len(pos)), -np.ones(len(neg) + 1)])
        weight = np.concatenate([np.minimum(count, 50) * 1.0, np.ones(len(neg) + 1)])
        w, bias = _train_svm(x, target, weight)
        machine.alpha, machine.bias = (machine.root @ w).astype(np.float32), bias
        value = machine.values(kernel, flat, size)
    best = np.array([value[s].max() for s in own])
    # a logistic curve whose point of 0.3 lies where the training classes part best
    cuts = np.unique(np.round(best, 3))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]) if len(cuts) > 1 else cuts
    wrong = [((best < c) & (y == 1)).sum() / max((y == 1).sum(), 1) + ((best >= c) & (y == 0)).sum() / max((y == 0).sum(), 1) for c in cuts]
    ties = cuts[np.array(wrong) <= min(wrong) + 1e-12]
    below, above = best[best < ties[0]], best[best >= ties[0]]
    low, high = (below.max() if len(below) else ties[0] - 0.5), (above.min() if len(above) else ties[0] + 0.5)
    cut = float(low + 0.4 * (high - low))  # nearer to the clean side: unseen insults are weaker than those learnt
    machine.scale, machine.shift = 4.0, cut + np.log(7 / 3) / 4.0
    return machine


def fit_labelled(docs: DataFrame, labels: DataFrame, column: str, fold: tuple[int, int], rows: int, fit):
    """``fit(texts, labels)`` on at most ``rows`` labelled documents of each class outside the fold (divisor, remainder).

    A document whose label is null, or that is labelled both ways, is not taken; of texts that share an id the first in order is. The bounded rows meet in one task, which fits the model
    in a Python worker; the model alone, a few MB, reaches the driver.
    """
    from pyspark.sql import Window

    divisor, remainder = fold
    known = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % divisor != remainder)
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    order = F.xxhash64("id", F.lit(11))
    best = [known.where(F.col("label") == y).orderBy(order, "id").limit(rows) for y in (0, 1)]
    picked = best[0].union(best[1])
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id")
    texts = texts.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("text"))).where("turn = 1").select(order.alias("place"), "id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["place"], r["id"]))
        model = fit([r["text"] for r in got], [r["label"] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = texts.coalesce(1).mapInArrow(run, "model binary").head(1)
    return pickle.loads(found[0][0]) if found else fit([], [])


class Reader:
    """Scores texts by a machine. Words are known by 64-bit hashes; CACHE of them are remembered, 12 bytes each, with the kernel values of those like a landmark."""

    def __init__(self, machine: Machine | None):
        self.machine = machine
        self._forget()

    def _forget(self) -> None:
        # half precision: kernel values lie in 0..1, and a worker has many
        self.rows = np.zeros((0, len(self.machine.landmarks) if self.machine else 0), np.float16)
        self.held, self.most, self.alone = 0, np.zeros(0, np.float32), np.zeros(0, np.float32)
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _keep(self, rows: np.ndarray) -> np.ndarray:
        first, self.held = self.held, self.held + len(rows)
        rows = rows.astype(np.float16)
        exact = rows.astype(np.float32)
        self.most = np.concatenate([self.most, exact @ np.maximum(self.machine.alpha, 0)])
        self.alone = np.concatenate([self.alone, exact @ self.machine.alpha + self.machine.bias])
        if self.held > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((len(rows) + self.held // 8 + 1024, self.rows.shape[1]), np.float16)])
        self.rows[first : self.held] = rows
        return np.arange(first, self.held, dtype=np.int32)

    def _rows_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's row; -1 if it is like no landmark. New words are read once."""
        if len(self.keys) > CACHE:
            self._forget()
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == own
        numbers = np.full(len(own), -1, np.int32)
        numbers[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = memoryview(data)
            words = [bytes(raw[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            places, rows = self.machine.words(words)
            numbers[new[places]] = self._keep(rows)
            self.keys, self.numbers = np.insert(self.keys, at[new], own[new]), np.insert(self.numbers, at[new], numbers[new])
        return numbers[back]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text, by the value of its strongest sentence."""
        if self.machine is None or not texts:
            return np.zeros(len(texts))
        raw = [spaced(t).encode("utf-8", "surrogatepass") for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        start, end = word_spans(data, offsets)
        best = np.full(len(texts), self.machine.bias, np.float32)  # that of a sentence without words like a landmark, or of none
        if not len(start):
            return self.machine.probability(best)
        hashes, at = word_hashes(data, offsets, lower=False)
        row = self._rows_of(data, start, end, hashes)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        # a sentence begins with a document, after a stop and on a new line
        lines = np.cumsum(data == 10)
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1] - 1])
        sentence, heads, half = np.cumsum(new) - 1, np.flatnonzero(new), WORDS // 2
        last = np.maximum(-(-np.diff(np.append(heads, len(start))) // half) - 2, 0)  # last window of each sentence
        base = np.cumsum(last + 1) - last - 1
        near = np.flatnonzero(row >= 0)
        np.maximum.at(best, doc[near], self.alone[row[near]])
        own = sentence[near]
        block = (near - heads[own]) // half
        here, before = block <= last[own], block > 0  # the windows that begin with a word's block, and with the one before
        window = np.concatenate([(base[own] + block)[here], (base[own] + block - 1)[before]])
        pair = np.unique(window * self.held + np.concatenate([row[near][here], row[near][before]]))
        if not len(pair):
            return self.machine.probability(best)
        window, flat = pair // self.held, pair % self.held
        first = np.flatnonzero(np.diff(window, prepend=-1))
        size = np.diff(np.append(first, len(flat)))
        owner = doc[heads][np.searchsorted(base, window[first], "right") - 1]
        # no sentence is worth more than its words' positive parts together: after the most promising one of each document, only those that may exceed it are looked at
        bound = self.machine.bias + np.add.reduceat(self.most[flat], first)
        order = np.lexsort((-bound, owner))
        for some in (order[np.flatnonzero(np.diff(owner[order], prepend=-1))], None):
            some = np.flatnonzero(bound + 1e-2 > best[owner]) if some is None else some
            which = np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
            np.maximum.at(best, owner[some], self.machine.values(self.rows, flat[which], size[some]))
        return self.machine.probability(best)


def _parts(batches: Iterator[pa.RecordBatch], machine, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of some MB of text, and the scores of their rows."""
    reader = claim("toxicity", name, make=lambda: Reader(machine.value))
    for batch in batches:
        for part in slices(batch, limit=1 << 20):
            yield part, reader.scores(part.column("text").to_pylist())


def _scores(machine):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _parts(batches, machine, name):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def _clean(machine, threshold: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _parts(batches, machine, name):
            yield part.filter(pa.array(score < threshold))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``labels`` has doc_id and toxic; documents of the fold (crc32 of the id as text, divisor, remainder) are never
    learnt from. Whole texts are read, however long, a few of them at a time. A null or empty text has no word and the score of a
    sentence without any word like a landmark. Without labels of both
    classes every score is 0. Rows that repeat an id are scored one by one; a null id is held out of nothing
    (false). predicted is 1 from ``threshold`` on. An empty table gives no rows; only doc_id and text are read.
    """
    machine = fit_labelled(docs, labels, "toxic", fold, fit_rows, fit)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(held), "doc_id long, score double")
    return _judged(scored, fold, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns as they are; each row is judged by its own text.

    Null and empty texts, and all rows if the labels lack a class, stay; rows of a null or repeated id are judged like any other.
    An empty table gives no rows. ``options`` are those of toxicity(). Nothing is shuffled.
    """
    fold, rows = options.get("fold", (4, 2)), options.get("fit_rows", FIT_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels, "toxic", fold, rows, fit))
    return docs.mapInArrow(_clean(held, threshold), docs.schema)


def _judged(scored: DataFrame, fold: tuple[int, int], threshold: float) -> DataFrame:
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1]
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
