"""Stored full-text postings: one table a segment and field, from which queries read the rows of their own terms alone.

A row is (term, document, length, count, positions). Rows lie in folders by a digest of the term and are sorted by term, so a
query opens the folders of its terms and skips the row groups and pages of others. A task groups the words of its own texts
in Arrow batches and writes them, so that no posting moves: each folder has a file of each task, in which terms
stand in runs of their order. The folder ``LENGTHS`` has a row without a term for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import textquery as Q
from .fulltext import Facts, bm25, matches, tree_score

#: Documents for which there is one folder of terms.
FOLDER_DOCS = 20_000
#: Folders at most: a task writes a file into each.
MOST_FOLDERS = 16
LENGTHS = -1
#: Documents for which there is one task, whose postings are sorted in its memory.
TASK_DOCS = 10_000
STORED = "term string, _doc_id long, _id string, _seq long, n int, tf int, at array<int>, _folder int"
#: Words that are grouped at once, a batch more at most, and rows of a batch that goes back.
RUN_WORDS, RUN_ROWS = 2_000_000, 50_000
_NAMES = ["term", "_doc_id", "_id", "_seq", "n", "tf", "at"]
_ROW = "term string, _doc_id long, _id string, _seq long, n int, tf int, at array<int>"


def folders(documents: int) -> int:
    return max(1, min(MOST_FOLDERS, -(-documents // FOLDER_DOCS)))


def _folder(term: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(count)).cast("int")


def build(rows: DataFrame, text: str, analyze, documents: int, least: int = 1) -> DataFrame:
    """Postings and lengths of rows (_id, _doc_id, _seq, text), ready to be written by ``_folder``; ``analyze`` makes tokens of a text column.

    Texts are dealt to as many tasks as there is work for, ``least`` at least, and cut into words once.
    """
    tasks = max(least, -(-documents // TASK_DOCS))
    dealt = rows.where(F.col(f"`{text}`").isNotNull()).repartition(tasks, "_doc_id")
    tokens = dealt.select("_id", "_doc_id", "_seq", analyze(F.col(f"`{text}`")).alias("_tokens"))
    made = tokens.mapInArrow(_grouped, _ROW)
    count = folders(documents)
    folder = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise(_folder(F.col("term"), count))
    return made.select(folder.alias("_folder"), "*").sortWithinPartitions("_folder")  # by one number, which keeps the order of the words


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ROW``, in the order of words: one of every word of a document, and one of the document."""
    held, words = [], 0
    for batch in batches:
        batch = batch.filter(batch.column("_tokens").is_valid())
        if len(batch):
            held.append(batch)
            words += len(batch.column("_tokens").flatten())
        if words >= RUN_WORDS:
            yield from _run(held)
            held, words = [], 0
    if held:
        yield from _run(held)


def _run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    own = [table.column(c).combine_chunks() for c in ("_doc_id", "_id", "_seq")]
    own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
    tokens, documents = table.column("_tokens"), len(table)
    n = np.asarray(tokens.combine_chunks().value_lengths(), np.int64)
    size = pa.array(n.astype(np.int32))
    none = pa.ListArray.from_arrays(pa.array(np.zeros(documents + 1, np.int32)), pa.array([], pa.int32()))
    made = [pa.RecordBatch.from_arrays([pa.nulls(documents, pa.string()), *own, size, size, none], names=_NAMES)]
    words = pa.concat_arrays([c.flatten() for c in tokens.chunks]).dictionary_encode()
    if len(words):
        names = pc.array_sort_indices(words.dictionary)
        turn = np.empty(len(names), np.int64)
        turn[np.asarray(names)] = np.arange(len(names))
        at = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        place = turn[np.asarray(words.indices)] * documents + np.repeat(np.arange(documents), n)
        order = np.argsort(place, kind="stable")  # by word and document; positions stay in their order
        place = place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[first, len(place)]
        document = pa.array(place[first] % documents)
        positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32)))
        terms = words.dictionary.take(names).take(pa.array(place[first] // documents))
        made.append(pa.RecordBatch.from_arrays([terms, *[c.take(document) for c in own], size.take(document), pa.array(np.diff(ends).astype(np.int32)), positions], names=_NAMES))
    for batch in made:
        for k in range(0, len(batch), RUN_ROWS):
            yield batch.slice(k, RUN_ROWS)


def lengths(postings: DataFrame) -> DataFrame:
    """(_id, _doc_id, _seq, n) of the documents that have a text."""
    return postings.where(F.col("_folder") == LENGTHS).select("_id", "_doc_id", "_seq", "n")


def of_terms(postings: DataFrame, words: list[str], count: int) -> DataFrame:
    """The postings of these terms; filters name folders and terms, so that nothing else is read."""
    spark = postings.sparkSession
    own = sorted({r[0] for r in spark.range(1).select(F.explode(F.array(*[_folder(F.lit(w), count) for w in words]))).collect()})
    return postings.where(F.col("_folder").isin(own) & F.col("term").isin(words))


def search(hits: DataFrame, tree, documents: int, mean: float, k1: float, b: float) -> DataFrame:
    """(_id, _doc_id, _score) of the documents that match a tree, from the postings ``hits`` of its words.

    ``documents`` and ``mean`` are the number of live documents and their mean length.
    """
    facts = Facts(tree)
    words = sorted({*facts.words, *(w for p in facts.phrases for w in p)})
    counts = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word of the query
    own = lambda w, c: F.max(F.when(F.col("term") == w, F.col(c)))
    phrase_words = sorted({w for p in facts.phrases for w in p})
    columns = [F.coalesce(own(w, "tf"), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(words)]
    docs = hits.groupBy("_doc_id", "_id", "n").agg(*columns, *[own(w, "at").alias(f"at{i}") for i, w in enumerate(phrase_words)])
    place = {w: i for i, w in enumerate(phrase_words)}

    def there(p: tuple[str, ...]) -> Column:
        """Positions at which the words stand side by side: those of each word, moved back by its place."""
        back = lambda j: lambda x: x - j
        moved = [F.transform(f"at{place[w]}", back(j)) for j, w in enumerate(p)]
        both = reduce(lambda a, c: F.when(a.isNotNull() & c.isNotNull(), F.array_intersect(a, c)), moved)
        return F.coalesce(F.size(both), F.lit(0)) > 0

    numbers = {w: i for i, w in enumerate(words)}
    made = F.struct(F.col("n").alias("n"), F.array(*[F.col(f"tf{numbers[w]}") for w in facts.words]).cast("array<int>").alias("tf"), F.array(*[there(p) for p in facts.phrases]).cast("array<boolean>").alias("phrase"))
    docs = docs.select("_id", "_doc_id", made.alias("_facts")).where(matches(tree, facts))
    weight = bm25(facts, lambda w: F.lit(counts.get(w, 0)), F.lit(documents), F.lit(float(mean)), k1, b)
    return docs.withColumn("_score", tree_score(tree, facts, weight)).where("_score > 0").select("_id", "_doc_id", "_score")


def all_words(tree) -> list[str]:
    """Every word that a tree asks about."""
    facts = Facts(tree)
    return sorted({*facts.words, *(w for p in facts.phrases for w in p)}) if Q.leaves(tree) else []
