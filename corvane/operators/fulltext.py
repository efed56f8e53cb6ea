"""Full-text search: BM25 over analysed documents.

This module searches rows that have no postings (see ``postings`` for those of a collection): each document's own token array gives its
length, its counts of the query's terms and its phrases, one aggregate over all gives the statistics, and the score
is an expression. Documents move only as the k best of each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import text
from ..plans import textquery as Q
from ..types import MAX_TOPK


class Facts:
    """What a tree asks of a document: its length, counts of words, and whether phrases occur.

    All of it is one struct, made in one look at the token array: a phrase test inside a
    filter would otherwise tokenize the text anew for every place that it compares.
    """

    def __init__(self, tree):
        leaves = _all_leaves(tree)
        self.words = sorted({w for x in Q.leaves(tree) for w in x.words} | {x.words[0] for x in leaves if len(x.words) == 1})
        self.phrases = sorted({x.words for x in leaves if len(x.words) > 1})
        self._word = {w: i for i, w in enumerate(self.words)}
        self._phrase = {p: i for i, p in enumerate(self.phrases)}

    def of(self, tokens: Column) -> Column:
        """struct(n, tf, phrase) of an array of tokens; null for null."""
        count = lambda t, w: F.size(F.filter(t, lambda x: x == F.lit(w)))

        def there(t: Column, words: tuple[str, ...]) -> Column:
            starts = F.filter(t, lambda x, i: reduce(lambda a, b: a & b, [(x == words[0]), *[F.get(t, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(words) if k]]))
            return F.size(starts) > 0

        def facts(t: Column) -> Column:
            tf = F.array(*[count(t, w) for w in self.words]).cast("array<int>")
            phrase = F.array(*[there(t, p) for p in self.phrases]).cast("array<boolean>")
            return F.struct(F.size(t).alias("n"), tf.alias("tf"), phrase.alias("phrase"))

        return F.get(F.transform(F.array(tokens), facts), F.lit(0))

    def tf(self, word: str) -> Column:
        return F.get(F.col("_facts.tf"), F.lit(self._word[word]))

    def held(self, words: tuple[str, ...]) -> Column:
        """Whether a document holds the words side by side."""
        return self.tf(words[0]) > 0 if len(words) == 1 else F.get(F.col("_facts.phrase"), F.lit(self._phrase[words]))


def _all_leaves(node) -> list[Q.Terms]:
    """Every term of a tree, those that must not match too."""
    if node is Q.EMPTY:
        return []
    if isinstance(node, Q.Terms):
        return [node]
    return [x for part in node.must + node.should + node.must_not for x in _all_leaves(part)]


def matches(node, facts: Facts) -> Column:
    """Whether a document matches a tree."""
    if node is Q.EMPTY:
        return F.lit(False)
    if isinstance(node, Q.Terms):
        return facts.held(node.words)
    parts = [matches(x, facts) for x in node.must]
    if not parts:
        parts = [reduce(lambda a, b: a | b, [matches(x, facts) for x in node.should])]
    return reduce(lambda a, b: a & b, parts + [~matches(x, facts) for x in node.must_not])


def tree_score(node, facts: Facts, weight) -> Column:
    """Sum of the weights of matching terms."""
    if isinstance(node, Q.Terms):
        each = [weight(w) * node.boost for w in node.words]
        total = reduce(lambda a, b: a + b, each)
        return total if len(node.words) == 1 else F.when(facts.held(node.words), total).otherwise(F.lit(0.0))
    out = F.lit(0.0)
    for part in node.must + node.should:
        s = tree_score(part, facts, weight)
        simple = isinstance(part, Q.Terms)
        out = out + (s if simple else F.when(matches(part, facts), s).otherwise(F.lit(0.0)))
    return out


def bm25(facts: Facts, containing, documents: Column, mean: Column, k1: float, b: float):
    """The weight of a word in a document: ``containing(word)`` documents have it, of so many with such a mean length."""

    def weight(w: str) -> Column:
        have, tf = containing(w), facts.tf(w)
        idf = F.log((documents - have + 0.5) / (have + 0.5) + 1.0)
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_facts.n") / mean))

    return weight


def query_tree(spark, query_string: str | None = None, match_string: str | None = None, operator: str = "or", tokenizer: str = "standard", filters=("lowercase",), **options):
    """The tree of a query; exactly one of the two strings is given."""
    if (query_string is None) == (match_string is None):
        raise InvalidArgument("give a query string or a match string")
    if match_string is not None:
        return Q.match_tree(text.analyze_query(spark, [match_string], tokenizer, filters, **options)[0], operator)
    raw = Q.parse(query_string, operator)
    pieces = Q.texts(raw)
    known = dict(zip(pieces, text.analyze_query(spark, pieces, tokenizer, filters, **options), strict=True))
    return Q.simplify(Q.build(raw, known.__getitem__))


def search(df: DataFrame, column: str, tree, k: int | None, key: str = "_id", where: Column | None = None, k1: float = 1.2, b: float = 0.75, tokenizer: str = "standard", filters=("lowercase",), tokens: str | None = None, **options) -> DataFrame:
    """Matching rows of ``df`` with ``_score``, best first; all columns stay.

    Statistics (documents with a value, mean length, document frequencies) cover the whole of ``df``; ``where``
    then narrows what may be found. ``tokens`` names a column of tokens if it was stored before. k None: all matches.
    """
    if k is not None and not 1 <= k <= MAX_TOPK:
        raise InvalidArgument(f"topk must be 1..{MAX_TOPK}")
    if not Q.leaves(tree):
        return df.withColumn("_score", F.lit(0.0)).where(F.lit(False))
    facts = Facts(tree)
    made = F.col(tokens) if tokens else text.analyze(F.col(f"`{column}`"), tokenizer, filters, **options)

    def known(rows: DataFrame) -> DataFrame:
        # explode() of a one-element array: filters above it see a column, not the expression that made it
        return rows.where(F.col(f"`{tokens or column}`").isNotNull()).withColumn("_facts", F.explode(F.array(facts.of(made))))

    stats = known(df.select(F.col(f"`{tokens or column}`"))).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_facts.n").alias("_mean"), *[F.count_if(facts.tf(w) > 0).alias(f"_df{i}") for i, w in enumerate(facts.words)]
    )
    hit = known(df if where is None else df.where(where)).where(matches(tree, facts)).crossJoin(F.broadcast(stats))
    place = {w: i for i, w in enumerate(facts.words)}
    weight = bm25(facts, lambda w: F.col(f"_df{place[w]}"), F.col("_n"), F.col("_mean"), k1, b)
    out = hit.withColumn("_score", tree_score(tree, facts, weight)).where("_score > 0").select(*[df[c] for c in df.columns], "_score")
    out = out.orderBy(F.desc("_score"), F.asc(key))
    return out if k is None else out.limit(k)
