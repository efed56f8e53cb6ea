"""Quality rules: hashed n-gram log-likelihood ratio, and the base rules, in DataFrame operations alone.

Every document's words are hashed once; these hashes, and those of neighbouring ones, fall into BUCKETS. Two multinomials,
of the trusted target (documents labelled good) and of the raw corpus, give each bucket a log-likelihood
ratio; a document's score is the mean ratio of its n-grams, and a
document is kept while the score reaches a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_column

#: A power of two.
BUCKETS = 4096
#: Trusted documents up to which their ids are broadcast (8 bytes each).
TRUSTED = 1_000_000
#: Pseudo-count of each bucket in both multinomials.
SMOOTH = 1.0
#: Mean log ratio under which a document goes.
THRESHOLD = -0.1
#: n-grams fewer than which the score is shrunk towards 0 as if so many neutral ones stood beside them.
PRIOR = 20
WINDOW = 5


def _hashes(words: Column) -> Column:
    """64-bit hash of each word; all n-grams are hashes of these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(hash_: Column, buckets: int) -> Column:
    return hash_.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _grams(hashes: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket of each word, and of each word with the one before it (the first word: with none), as arrays of ints."""
    return F.transform(hashes, lambda h: _bucket(h, buckets)), F.transform(hashes, lambda h, i: _bucket(F.xxhash64(h, F.get(hashes, i - 1)), buckets))


def _windows(hashes: Column) -> Column:
    """Hash of each WINDOW-word window, in order."""
    n = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, n), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, WINDOW)]))


def _covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes.

    Hashes are sorted with their places: equal neighbours are repeated. The places
    of these windows, sorted, cover the sum of least(WINDOW, gap to the one before).
    """
    same = lambda s, i, d: F.get(s, i + d).getField("h").eqNullSafe(F.get(s, i).getField("h"))
    hits = lambda s: F.transform(s, lambda p, i: F.when(same(s, i, 1) | ((i > 0) & same(s, i, -1)), p.getField("i")))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hit = F.array_sort(F.array_compact(let(pairs, hits)))
    return F.aggregate(hit, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def base_columns(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols and n_dup_lines of a text (longs)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log-likelihood ratio target / raw of each bucket, over all n-grams of all documents.

    Counts are summed in each task before anything moves, so at most ``buckets`` rows a task are shuffled
    and ``buckets`` rows reach the driver. Without trusted documents every ratio is 0.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    if trusted.count() <= TRUSTED:  # else both sides are shuffled
        trusted = F.broadcast(trusted)
    rows = docs.join(trusted, F.col("doc_id") == F.col("_trusted"), "left").select(F.col("_trusted").isNotNull().alias("good"), _hashes(words_column("text")).alias("hashes"))
    grams = rows.select("good", F.explode(F.concat(*_grams(F.col("hashes"), buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good")).collect()
    raw, good = [SMOOTH] * buckets, [SMOOTH] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    from math import log

    if sum(good) == SMOOTH * buckets:
        return [0.0] * buckets
    a, b = log(sum(good)), log(sum(raw))
    return [round(log(g) - a - log(r) + b, 9) for g, r in zip(good, raw, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row.

    A null text has no words; whole texts are read, however long. base_failed: fewer than 10 words, or over a fifth of them in
    repeated windows. kept: not base_failed and score >= threshold. A text without n-grams scores 0.
    Rows that repeat an id are judged one by one; labels that repeat a document count once.
    Ties of score and threshold are kept. Empty tables give no rows; other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratios = bucket_ratios(docs, labels, buckets)
    rows = docs.select("doc_id", _hashes(words_column("text")).alias("words"), *[c.alias(k) for k, c in base_columns(F.col("text")).items()])
    table = F.lit(ratios)
    rows = rows.withColumn("hashes", _windows(F.col("words")))
    ratio = lambda h: F.get(table, _bucket(h, buckets))
    each = F.transform("words", lambda h, i: ratio(h) + ratio(F.xxhash64(h, F.get(F.col("words"), i - 1))))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(0).cast("long")
    n = F.size("words").cast("long")
    grams = 2 * n
    rows = rows.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), (total / (grams + PRIOR)).alias("score"))
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.round("score", 9) >= threshold)).alias("kept"), "score")
