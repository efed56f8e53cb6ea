"""The driver's queries over its tables, one or more for each operator, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection, Doc, Query
from .functions import metrics, quantize, text
from .operators import fusion, vector
from .operators.coded import Pq, RaBitQ
from .plans.filters import compile_filter
from .session import work_dir
from .types import DataType as D
from .types import Field, Index, IndexType, Metric, Quantize, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _schema(**fields) -> Schema:
    return Schema("t", [Field(n, t, True, 64 if t.is_dense else 0) for n, t in fields.items()])


_MADE: dict[tuple[str, str, str], Collection] = {}


def _made(name: str):
    """A collection that is made once for an application and folder of tables, below the folder that executors share."""

    def keep(make):
        def get(spark: SparkSession, sf_dir: str) -> Collection:
            key = spark.sparkContext.applicationId, sf_dir, name
            if key not in _MADE:
                _MADE[key] = make(spark, sf_dir, f"{work_dir(spark)}/{name}")
            return _MADE[key]

        return get

    return keep


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its key: numbers of equal length, whose order as text is that of the numbers."""
    return df.withColumn("_id", F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in columns]))


def _filled(spark, path: str, fields: list[Field], rows: DataFrame) -> Collection:
    c = Collection.create(spark, path, Schema("t", fields))
    c.insert_df(rows.select("_id", *[f.name for f in fields]))
    return c


def _key(number: int) -> str:
    return f"{number:012d}"


# -- filters: a filter text over a table, and the same condition in SQL -----------------

_PART = _schema(p_partkey=D.INT64, p_name=D.STRING, p_brand=D.STRING, p_type=D.STRING, p_size=D.INT32, p_retailprice=D.DOUBLE, maybe=D.INT32)
_CUSTOMER = _schema(c_custkey=D.INT64, c_name=D.STRING, c_nationkey=D.INT32, c_acctbal=D.DOUBLE, c_mktsegment=D.STRING)
_ORDERS = _schema(o_custkey=D.INT64, statuses=D.ARRAY_STRING, priorities=D.ARRAY_STRING, years=D.ARRAY_INT32)


def _part(spark, d) -> DataFrame:
    return _table(spark, d, "part").withColumn("maybe", F.nullif(F.col("p_size") % 10, F.lit(3)))


_PART_SQL = "(SELECT *, nullif(p_size % 10, 3) AS maybe FROM part)"


def _filter(name: str, table, schema: Schema, source: str, condition: str, sql: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir).where(compile_filter(condition, schema)).select(*columns)

    run.__doc__ = f"Rows where {condition}"
    _register(name, f"SELECT {', '.join(columns)} FROM {source} WHERE {sql}")(run)


for _name, _condition, _sql in [
    ("filter_eq", "p_brand = 'Brand#12'", "p_brand = 'Brand#12'"),
    ("filter_ne", "maybe != 4", "maybe <> 4"),
    ("filter_range", "p_retailprice >= 1000 AND p_retailprice < 1500.5 AND p_size > -1", "p_retailprice >= 1000 AND p_retailprice < 1500.5 AND p_size > -1"),
    ("filter_in", "p_size IN (1, 5, 9)", "p_size IN (1, 5, 9)"),
    ("filter_not_in_null", "maybe NOT IN (1, 2)", "maybe NOT IN (1, 2)"),
    ("filter_and_or", "p_size < 5 OR p_size > 45 AND (p_type = 'x' OR p_retailprice > 1200)", "p_size < 5 OR (p_size > 45 AND (p_type = 'x' OR p_retailprice > 1200))"),
    ("filter_is_null", "maybe IS NULL", "maybe IS NULL"),
    ("filter_is_not_null", "maybe IS NOT NULL -- a comment", "maybe IS NOT NULL"),
    ("filter_kleene", "maybe = 4 OR p_size > 30", "maybe = 4 OR p_size > 30"),
]:
    _filter(_name, _part, _PART, _PART_SQL, _condition, _sql, ("p_partkey", "p_size", "p_retailprice"))

for _name, _condition, _sql in [
    ("filter_like_prefix", "c_name LIKE 'Customer#0000001%'", "c_name LIKE 'Customer#0000001%'"),
    ("filter_like_suffix", "c_name LIKE '%7'", "c_name LIKE '%7'"),
    ("filter_like_infix", "c_mktsegment LIKE '%IL%'", "c_mktsegment LIKE '%IL%'"),
    ("filter_like_underscore", "c_name LIKE 'Customer#00000_00_'", "c_name LIKE 'Customer#00000_00_'"),
    ("filter_like_escape", r"c_name LIKE 'Customer\_%'", r"c_name LIKE 'Customer\_%' ESCAPE '\'"),
]:
    _filter(_name, lambda s, d: _table(s, d, "customer"), _CUSTOMER, "customer", _condition, _sql, ("c_custkey", "c_name", "c_mktsegment"))


def _order_arrays(spark, d) -> DataFrame:
    """Orders of a customer as arrays; a customer without an urgent order has null priorities."""
    urgent = F.when(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")) == 1, F.array_sort(F.collect_set("o_orderpriority")))
    return _table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), urgent.alias("priorities"), F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))


_ORDERS_SQL = """(SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses,
  CASE WHEN max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) = 1 THEN list_sort(list(DISTINCT o_orderpriority)) END AS priorities,
  list_sort(list(DISTINCT CAST(year(o_orderdate) AS INTEGER))) AS years FROM orders GROUP BY o_custkey)"""

for _name, _condition, _sql in [
    ("filter_contain_all", "statuses CONTAIN_ALL ('O', 'F')", "list_has_all(statuses, ['O', 'F'])"),
    ("filter_contain_any", "years CONTAIN_ANY (1993, 1997)", "list_has_any(years, [1993, 1997])"),
    ("filter_not_contain_all", "priorities NOT CONTAIN_ALL ('1-URGENT', '2-HIGH')", "priorities IS NOT NULL AND NOT list_has_all(priorities, ['1-URGENT', '2-HIGH'])"),
    ("filter_not_contain_any", "priorities NOT CONTAIN_ANY ('2-HIGH')", "priorities IS NOT NULL AND NOT list_has_any(priorities, ['2-HIGH'])"),
    ("filter_contain_empty_any", "priorities CONTAIN_ANY ()", "false"),
    ("filter_contain_empty_all", "priorities CONTAIN_ALL ()", "priorities IS NOT NULL"),
    ("filter_not_contain_empty_any", "priorities NOT CONTAIN_ANY ()", "priorities IS NOT NULL"),
    ("filter_array_length", "array_length(priorities) >= 4", "len(priorities) >= 4"),
    ("filter_array_length_eq", "array_length(years) = 3 AND o_custkey > 10", "len(years) = 3 AND o_custkey > 10"),
]:
    _filter(_name, _order_arrays, _ORDERS, _ORDERS_SQL, _condition, _sql, ("o_custkey",))


# -- vectors ------------------------------------------------------------------------------


def _embeddings(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings")


def _query_row(spark, d, vec_id: int) -> DataFrame:
    return _embeddings(spark, d).where(F.col("vec_id") == vec_id).select(F.col("embedding"))


def _dist(kind: str, a: str = "e.embedding", b: str = "q.embedding") -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    if kind == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
    if kind == "ip":
        return dot(a, b)
    return f"(1.0 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def _vector_sql(kind: str, k: int, vec_id: int, where: str = "true", radius: str = "true") -> str:
    way = "DESC" if kind == "ip" else "ASC"
    return f"""WITH s AS (SELECT e.vec_id, {_dist(kind)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q WHERE {where})
SELECT vec_id, round(score, 6) + CAST(0 AS DOUBLE) AS score FROM s WHERE {radius} ORDER BY score {way}, vec_id LIMIT {k}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", (F.round("_score", 6) + F.lit(0.0)).alias("score"))  # no -0


for _kind, _metric in (("l2", Metric.L2), ("ip", Metric.IP), ("cosine", Metric.COSINE)):

    @_register(f"vec_{_kind}_topk", _vector_sql(_kind, 10, 7))
    def _(spark, d, m=_metric):
        return _shown(vector.by_row(_embeddings(spark, d), "embedding", _query_row(spark, d, 7), m, 10, "vec_id"))


@_register("vec_l2_radius", _vector_sql("l2", 50, 11, radius="score <= 1.4"))
def _(spark, d):
    return _shown(vector.by_row(_embeddings(spark, d), "embedding", _query_row(spark, d, 11), Metric.L2, 50, "vec_id", radius=1.4))


@_register("vec_ip_radius", _vector_sql("ip", 50, 11, radius="score >= 0.2"))
def _(spark, d):
    return _shown(vector.by_row(_embeddings(spark, d), "embedding", _query_row(spark, d, 11), Metric.IP, 50, "vec_id", radius=0.2))


@_register("vec_filtered_topk", _vector_sql("l2", 5, 7, where="label <> 3"))
def vec_filtered_topk(spark, d):
    """The flagship: five nearest vectors among those that a filter lets through."""
    condition = compile_filter("label != 3", _schema(label=D.INT32))
    return _shown(vector.by_row(_embeddings(spark, d).where(condition), "embedding", _query_row(spark, d, 7), Metric.L2, 5, "vec_id"))


@_register("vec_query_by_id", _vector_sql("cosine", 8, 42))
def _(spark, d):
    return _shown(vector.by_row(_embeddings(spark, d), "embedding", _query_row(spark, d, 42), Metric.COSINE, 8, "vec_id"))


@_register("vec_euclidean", f"SELECT e.vec_id, round(sqrt({_dist('l2')}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY {_dist('l2')}, e.vec_id LIMIT 10")
def _(spark, d):
    rows = _embeddings(spark, d).crossJoin(F.broadcast(_query_row(spark, d, 3).limit(1).withColumnRenamed("embedding", "_query")))
    return _shown(vector.top_k(rows, metrics.euclidean(F.col("embedding"), F.col("_query")), Metric.L2, 10, "vec_id"))


_WORDS_SQL = """(SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"""


def _sparse_docs(spark, d) -> DataFrame:
    """Documents as sparse vectors: lengths of their words as indices, counts as values."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    counts = _table(spark, d, "documents").select("doc_id", F.explode_outer(words).alias("w")).groupBy("doc_id", F.length("w").cast("long").alias("i")).agg(F.count("w").cast("float").alias("n"))
    pairs = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("p"))
    return pairs.select("doc_id", F.struct(F.col("p.i").alias("indices"), F.col("p.n").alias("values")).alias("v"))


@_register(
    "sparse_ip_topk",
    f"""WITH t AS (SELECT doc_id, length(x) AS n FROM (SELECT doc_id, unnest(w) AS x FROM {_WORDS_SQL}))
SELECT doc_id, round(CAST(sum(CASE n WHEN 2 THEN 0.5 WHEN 9 THEN 1.25 WHEN 14 THEN 3.0 ELSE 0 END) AS DOUBLE), 6) AS score FROM t GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
)
def _(spark, d):
    return vector.sparse_top_k(_sparse_docs(spark, d), "v", {2: 0.5, 9: 1.25, 14: 3.0}, 10, "doc_id").select("doc_id", F.round("_score", 6).alias("score"))


@_register(
    "group_by_label_topk",
    f"""WITH s AS (SELECT e.vec_id, e.label, {_dist("l2")} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS place, min(score) OVER (PARTITION BY label) AS best FROM s),
g AS (SELECT *, dense_rank() OVER (ORDER BY best, CAST(label AS VARCHAR)) AS turn FROM r)
SELECT vec_id, CAST(label AS VARCHAR) AS grp, round(score, 6) AS score FROM g WHERE place <= 3 AND turn <= 4""",
)
def _(spark, d):
    rows = _embeddings(spark, d).crossJoin(F.broadcast(_query_row(spark, d, 7).limit(1).withColumnRenamed("embedding", "_query")))
    out = vector.top_groups(rows, metrics.squared_l2(F.col("embedding"), F.col("_query")), Metric.L2, vector.group_key("label", D.INT32), 3, 4, "vec_id")
    return out.select("vec_id", F.col("_group").alias("grp"), F.round("_score", 6).alias("score"))


# -- fusion ---------------------------------------------------------------------------------


def _ranked(spark, d, vec_id: int, metric: Metric, k: int = 20) -> fusion.Ranked:
    rows = vector.by_row(_embeddings(spark, d), "embedding", _query_row(spark, d, vec_id), metric, k, "vec_id")
    return fusion.Ranked(rows.select(F.col("vec_id").cast("string").alias("_id"), "_score"), metric)


def _list_sql(kind: str, vec_id: int, k: int = 20) -> str:
    way = "DESC" if kind == "ip" else "ASC"
    return f"(SELECT CAST(e.vec_id AS VARCHAR) AS id, {_dist(kind)} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY s {way}, e.vec_id LIMIT {k})"


@_register(
    "rrf_two_vectors",
    f"""SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (
SELECT id, row_number() OVER (ORDER BY s ASC, id) AS r FROM {_list_sql("l2", 7)} UNION ALL
SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM {_list_sql("ip", 19)}) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10""",
)
def _(spark, d):
    out = fusion.fuse([_ranked(spark, d, 7, Metric.L2), _ranked(spark, d, 19, Metric.IP)], fusion.Rrf(), 10)
    return out.select(F.col("_id").alias("id"), F.round("_score", 9).alias("score"))


@_register(
    "weighted_l2_cosine",
    f"""SELECT id, round(sum(x), 6) AS score FROM (
SELECT id, 0.7 * (1 - 2 * atan(s) / pi()) AS x FROM {_list_sql("l2", 7)} UNION ALL
SELECT id, 0.3 * (1 - s / 2) AS x FROM {_list_sql("cosine", 19)}) GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""",
)
def _(spark, d):
    out = fusion.fuse([_ranked(spark, d, 7, Metric.L2), _ranked(spark, d, 19, Metric.COSINE)], fusion.Weighted([0.7, 0.3]), 10)
    return out.select(F.col("_id").alias("id"), F.round("_score", 6).alias("score"))


@_register(
    "callback_fusion",
    f"""SELECT id, round(s, 6) + CAST(0 AS DOUBLE) AS score FROM (SELECT id, arg_max(s, t) AS s FROM (SELECT id, s, 1 AS t FROM {_list_sql("l2", 7)} UNION ALL SELECT id, s, 2 AS t FROM {_list_sql("cosine", 19)}) GROUP BY id) ORDER BY id LIMIT 10""",
)
def _(spark, d):
    """A function of its own: of a document in both lists the second score counts, and the ten first names win."""
    best = lambda lists: sorted({i: s for rows in lists for i, s in rows}.items())[:10]
    out = fusion.fuse([_ranked(spark, d, 7, Metric.L2), _ranked(spark, d, 19, Metric.COSINE)], fusion.Callback(best), 10)
    return out.select(F.col("_id").alias("id"), (F.round("_score", 6) + F.lit(0.0)).alias("score"))


# -- full text --------------------------------------------------------------------------------

_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{text.STANDARD.replace(chr(39), chr(39) * 2)}'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))"
_SPACE_TOKENS = "regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+')"


def _bm25_sql(words: list[str], match: str, k: int = 10, tokens: str = _TOKENS, table: str = "documents", key: str = "doc_id", where: str = "true", scores: dict[str, str] | None = None) -> str:
    """BM25 over a table; ``match`` is a condition on columns tf0.. and the token list w."""
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{x}')) AS tf{i}" for i, x in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(words)))
    part = [f"(ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean)))" for i in range(len(words))]
    total = (scores or {}).get("sum") or " + ".join(part)
    for i, p in enumerate(part):
        total = total.replace(f"@{i}", p)
    return f"""WITH a AS (SELECT *, {tokens} AS w FROM {table} WHERE text IS NOT NULL), b AS (SELECT *, len(w) AS dl, {tf} FROM a),
s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM b),
r AS (SELECT b.*, {total} AS score FROM b, s WHERE ({match}) AND ({where}))
SELECT {key}, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY score DESC, {key} LIMIT {k}"""


_TEXTS = [Field("doc_id", D.INT64), Field("lang", D.STRING, True), Field("n_chars", D.INT64, True), Field("text", D.STRING, True, 0, Index(IndexType.FTS))]


@_made("documents")
def _documents(spark, d, path) -> Collection:
    """All documents with postings of their texts, and their vectors where they have one."""
    fields = [*_TEXTS, Field("v", D.VECTOR_FP32, True, 64, Index(metric=Metric.L2))]
    vectors = _embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    rows = _table(spark, d, "documents").join(vectors.hint("shuffle_hash"), "doc_id", "left")  # texts are not sorted for it
    return _filled(spark, path, fields, _keyed(rows, "doc_id"))


@_made("documents_plain")
def _documents_plain(spark, d, path) -> Collection:
    return _filled(spark, path, [*_TEXTS[:3], Field("text", D.STRING, True, 0, Index(IndexType.FTS, params={"tokenizer": "whitespace"}))], _keyed(_table(spark, d, "documents"), "doc_id"))


@_made("documents_changed")
def _documents_changed(spark, d, path) -> Collection:
    """Documents in two segments, some of which were replaced and some deleted."""
    rows = _keyed(_table(spark, d, "documents"), "doc_id")
    c = _filled(spark, path, _TEXTS, rows.where("doc_id % 2 = 0"))
    c.insert_df(rows.where("doc_id % 2 = 1").select("_id", *[f.name for f in _TEXTS]))
    c.upsert_df(rows.where("doc_id % 5 = 0").select("_id", "doc_id", "lang", "n_chars", F.concat("text", F.lit(" thering thering")).alias("text")))
    c.delete_by_filter("lang = 'fr'")
    return c


def _fts(spark, d, made=_documents, k: int = 10, filter: str | None = None, **query) -> DataFrame:
    return made(spark, d).query_df(Query("text", **query), k, filter, ["doc_id"]).select("doc_id", F.round("_score", 6).alias("score"))


@_register("fts_match_or", _bm25_sql(["stupid", "handed", "estaque", "thering"], "tf0 + tf1 + tf2 + tf3 > 0"))
def _(spark, d):
    return _fts(spark, d, match_string="stupid handed estaque thering")


@_register("fts_match_and", _bm25_sql(["the", "of", "and"], "tf0 > 0 AND tf1 > 0 AND tf2 > 0"))
def _(spark, d):
    return _fts(spark, d, match_string="the of and", operator="and")


@_register("fts_repeated_term", _bm25_sql(["the", "und"], "tf0 > 0 OR tf1 > 0", scores={"sum": "2 * @0 + @1"}))
def _(spark, d):
    return _fts(spark, d, query_string="the the und")


_PHRASE = "len(w) >= 2 AND len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0"


@_register("fts_phrase", _bm25_sql(["of", "the"], _PHRASE))
def _(spark, d):
    return _fts(spark, d, query_string='"of the"')


@_register("fts_not", _bm25_sql(["the", "of"], "tf0 > 0 AND tf1 = 0", scores={"sum": "@0"}))
def _(spark, d):
    return _fts(spark, d, query_string="the NOT of")


@_register("fts_must_should", _bm25_sql(["and", "thering", "was"], "tf0 > 0 AND tf2 = 0", scores={"sum": "@0 + @1"}))
def _(spark, d):
    return _fts(spark, d, query_string="+and thering -was")


@_register("fts_brackets", _bm25_sql(["the", "und", "is"], "(tf0 > 0 OR tf1 > 0) AND tf2 > 0"))
def _(spark, d):
    return _fts(spark, d, query_string="(the OR und) AND is")


@_register("fts_filtered", _bm25_sql(["the", "und"], "tf0 > 0 OR tf1 > 0", where="lang = 'de' AND n_chars > 500"))
def _(spark, d):
    return _fts(spark, d, filter="lang = 'de' AND n_chars > 500", match_string="the und")


@_register(
    "fts_after_changes",
    _bm25_sql(["thering", "the"], "tf0 > 0 OR tf1 > 0", table="(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' thering thering' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'fr')"),
)
def _(spark, d):
    return _fts(spark, d, _documents_changed, match_string="thering the")


@_register("fts_whitespace", _bm25_sql(["the", "of."], "tf0 > 0 AND tf1 > 0", tokens=_SPACE_TOKENS))
def _(spark, d):
    return _fts(spark, d, _documents_plain, match_string="the of.", operator="and")


@_register(
    "fts_ngram",
    """WITH g AS (SELECT conv_id, turn, list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), CAST([] AS VARCHAR[])) AS w
FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS r FROM conversations) WHERE length(r) >= 2)
SELECT conv_id, turn, x AS gram, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS x FROM g) WHERE x IN ('th', 'qu') GROUP BY ALL""",
)
def _(spark, d):
    grams = _table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.analyze(F.col("text"), "ngram")).alias("gram"))
    return grams.where(F.col("gram").isin("th", "qu")).groupBy("conv_id", "turn", "gram").agg(F.count(F.lit(1)).alias("n"))


@_register("tokens_standard", f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS terms FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def _(spark, d):
    t = _table(spark, d, "documents").select("doc_id", text.analyze(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@_register("tokens_folded_stemmed")
def _(spark, d):
    t = text.analyze(F.col("text"), filters=["lowercase", "ascii_folding", "stemmer"])
    return _table(spark, d, "conversations").select("conv_id", "turn", t.alias("tokens"))


@_register(
    "hybrid_rrf_fts_vector",
    f"""WITH f AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql(["thering", "stupid", "handed"], "tf0 + tf1 + tf2 > 0", 20).replace("round(score, 6) AS score", "score")})),
s AS (SELECT e.vec_id, {_dist("l2")} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id IN (SELECT doc_id FROM documents) ORDER BY s, e.vec_id LIMIT 20),
v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, row_number() OVER (ORDER BY s, vec_id) AS r FROM s)
SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10""",
)
def _(spark, d):
    out = _documents(spark, d).query_df([Query("text", match_string="thering stupid handed"), Query("v", id=_key(7))], 10, output_fields=[], reranker=fusion.Rrf(), num_candidates=20)
    return out.select(F.col("_id").alias("id"), F.round("_score", 9).alias("score"))


# -- rows, changes and columns ------------------------------------------------------------------


_CUSTOMER_FIELDS = _CUSTOMER.fields
_EVENT_FIELDS = [Field("user_id", D.INT64), Field("event_id", D.INT64), Field("event_type", D.STRING, True), Field("kind", D.STRING, True), Field("value", D.DOUBLE, True)]


def _event_rows(spark, d, *key: str) -> DataFrame:
    rows = _table(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("click"))).orderBy("event_id")
    return _keyed(rows, *key).select("_id", *[f.name for f in _EVENT_FIELDS])


@_made("customers")
def _customers(spark, d, path) -> Collection:
    return _filled(spark, path, _CUSTOMER_FIELDS, _keyed(_table(spark, d, "customer").orderBy("c_custkey"), "c_custkey"))


@_made("vectors")
def _vectors(spark, d, path) -> Collection:
    """Embeddings with stored cells and 8-bit codes; a tenth was inserted after these were built."""
    fields = [Field("vec_id", D.INT64), Field("label", D.INT32, True), Field("v", D.VECTOR_FP32, True, 64, Index(IndexType.IVF, Metric.L2, Quantize.INT8, {"nlist": 16}))]
    rows = _keyed(_embeddings(spark, d).withColumnRenamed("embedding", "v"), "vec_id")
    c = _filled(spark, path, fields, rows.where("vec_id % 10 != 3"))
    c.optimize()
    c.insert_df(rows.where("vec_id % 10 = 3").select("_id", "vec_id", "label", "v"))
    return c


@_register("fetch_by_pk", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 77, 999999999)")
def _(spark, d):
    return _customers(spark, d).fetch([_key(k) for k in (1, 5, 77, 999999999)], ["c_custkey", "c_name"]).drop("_id")


@_register("fetch_vectors", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id IN (3, 7, 13)")
def _(spark, d):
    rows = _vectors(spark, d).fetch([_key(k) for k in (3, 7, 13, 77777777)], include_vector=True)
    return rows.select("vec_id", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_register("resolve_ids", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS distinct_ids FROM customer")
def _(spark, d):
    """Every row has an internal id of its own, and its key is found by it."""
    c = _customers(spark, d)
    some = [r["_doc_id"] for r in c.scan(limit=5, include_doc_id=True).collect()]
    if c.resolve([*some, -1]) != [*[r["_id"] for r in c.scan(limit=5).collect()], None]:
        raise AssertionError("keys are not those of the ids")
    return c.df().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_doc_id").alias("distinct_ids"))


@_register("output_fields_none", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    return _vectors(spark, d).scan().drop("_id")


@_register("output_fields_empty", "SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id FROM embeddings")
def _(spark, d):
    return _vectors(spark, d).scan(output_fields=[]).withColumnRenamed("_id", "id")


@_register("scan_limit", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 20")
def _(spark, d):
    return _customers(spark, d).scan("c_acctbal > 0", 20, ["c_custkey", "c_acctbal"]).drop("_id")


@_made("latest")
def _latest(spark, d, path) -> Collection:
    rows = _event_rows(spark, d, "user_id")
    c = _filled(spark, path, _EVENT_FIELDS, rows.where("event_id % 3 = 0").limit(0))
    middle = rows.agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    c.upsert_df(rows.where(F.col("event_id") <= middle))
    c.upsert_df(rows.where(F.col("event_id") > middle))
    return c


@_register("upsert_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return _latest(spark, d).scan(output_fields=["user_id", "event_type", "value"]).drop("_id")


@_made("first")
def _first(spark, d, path) -> Collection:
    rows = _event_rows(spark, d, "user_id")
    middle = rows.agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    c = _filled(spark, path, _EVENT_FIELDS, rows.where(F.col("event_id") <= middle))
    c.insert_df(rows.where(F.col("event_id") > middle))
    return c


@_register("insert_conflict", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return _first(spark, d).scan(output_fields=["user_id", "event_id"]).drop("_id")


@_made("left_events")
def _left_events(spark, d, path) -> Collection:
    c = _filled(spark, path, _EVENT_FIELDS, _event_rows(spark, d, "event_id"))
    c.delete_by_filter("kind = 'view' AND value > 10")
    return c


@_register("delete_by_filter", "SELECT event_id, value FROM events WHERE NOT coalesce(nullif(event_type, 'click') = 'view' AND value > 10, false)")
def _(spark, d):
    return _left_events(spark, d).scan(output_fields=["event_id", "value"]).drop("_id")


@_made("changed_customers")
def _changed_customers(spark, d, path) -> Collection:
    """Rows inserted, upserted, updated and deleted one by one, and by keys in a DataFrame."""
    c = _filled(spark, path, _CUSTOMER_FIELDS, _keyed(_table(spark, d, "customer"), "c_custkey"))
    new = lambda k, name: Doc(_key(k), {"c_custkey": k, "c_name": name, "c_nationkey": 1, "c_acctbal": 0.5, "c_mktsegment": "X"})
    c.insert([new(1, "not taken"), new(900_000_001, "new"), new(900_000_001, "again")])
    c.upsert([new(2, "first"), new(2, "last")])
    c.update([Doc(_key(3), {"c_name": None, "c_nationkey": 99}), Doc(_key(900_000_009), {"c_name": "nobody"})])
    c.delete([_key(4), _key(4), "nobody"])
    c.delete_df(_keyed(_table(spark, d, "customer").where("c_custkey between 10 and 12"), "c_custkey"))
    return c


@_register(
    "rows_changed",
    """SELECT c_custkey, CASE c_custkey WHEN 2 THEN 'last' WHEN 3 THEN NULL ELSE c_name END AS c_name, CAST(CASE c_custkey WHEN 2 THEN 1 WHEN 3 THEN 99 ELSE c_nationkey END AS INTEGER) AS c_nationkey
FROM customer WHERE c_custkey <> 4 AND c_custkey NOT BETWEEN 10 AND 12 UNION ALL SELECT CAST(900000001 AS BIGINT), 'new', CAST(1 AS INTEGER)""",
)
def _(spark, d):
    return _changed_customers(spark, d).scan(output_fields=["c_custkey", "c_name", "c_nationkey"]).drop("_id")


@_register("rows_changed_filtered", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (2, 3, 4) AND c_custkey NOT BETWEEN 10 AND 12 AND c_nationkey = 1 UNION ALL SELECT unnest([CAST(2 AS BIGINT), 900000001])")
def _(spark, d):
    return _changed_customers(spark, d).scan("c_nationkey = 1", output_fields=["c_custkey"]).drop("_id")


@_made("merged_parts")
def _merged_parts(spark, d, path) -> Collection:
    fields = [Field("p_partkey", D.INT64), Field("p_name", D.STRING, True), Field("p_size", D.INT32)]
    rows = _keyed(_table(spark, d, "part"), "p_partkey")
    c = _filled(spark, path, fields, rows)
    c.update_df(rows.where("p_partkey % 3 = 0").select("_id", F.lit(None).cast("string").alias("p_name")))
    c.update_df(rows.where("p_partkey % 2 = 0").select("_id", (F.col("p_size") + 100).alias("p_size")))
    return c


@_register(
    "update_merge",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part""",
)
def _(spark, d):
    return _merged_parts(spark, d).scan().drop("_id")


_LINE_FIELDS = [Field(n, t) for n, t in (("l_orderkey", D.INT64), ("l_linenumber", D.INT32), ("l_quantity", D.DOUBLE), ("l_extendedprice", D.DOUBLE), ("l_discount", D.DOUBLE))]


@_made("lines")
def _lines(spark, d, path) -> Collection:
    """Order lines, with columns added, renamed and retyped."""
    rows = _table(spark, d, "lineitem").withColumn("row", F.monotonically_increasing_id())  # an order may have a line number twice
    c = _filled(spark, path, _LINE_FIELDS, _keyed(rows, "row"))
    c.add_column(Field("net", D.DOUBLE), "l_extendedprice * (1 - l_discount) + 2.5")
    c.add_column(Field("half", D.INT32), "-(l_orderkey / 7) + l_linenumber * 2")
    c.add_column(Field("small", D.INT32), "l_orderkey * 1000003")
    c.add_column(Field("later", D.DOUBLE, True))
    c.alter_column("l_quantity", rename="amount")
    c.alter_column("l_extendedprice", new=Field("l_extendedprice", D.INT64))
    return c


def _line(spark, d, name: str) -> DataFrame:
    return _lines(spark, d).scan(output_fields=["l_orderkey", "l_linenumber", name]).drop("_id")


@_register("add_column_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + 2.5, 6) AS net FROM lineitem")
def _(spark, d):
    return _line(spark, d, "net").withColumn("net", F.round("net", 6))


@_register("add_column_integers", "SELECT l_orderkey, l_linenumber, CAST(-(l_orderkey // 7) + l_linenumber * 2 AS INTEGER) AS half FROM lineitem")
def _(spark, d):
    return _line(spark, d, "half")


@_register("add_column_wrap", "SELECT l_orderkey, l_linenumber, CAST(((CAST(l_orderkey AS HUGEINT) * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS small FROM lineitem")
def _(spark, d):
    return _line(spark, d, "small")


@_register("add_column_null", "SELECT l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS later FROM lineitem")
def _(spark, d):
    return _line(spark, d, "later")


@_register("rename_column", "SELECT l_orderkey, l_linenumber, l_quantity AS amount FROM lineitem")
def _(spark, d):
    return _line(spark, d, "amount")


@_register("retype_column", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS price FROM lineitem")
def _(spark, d):
    return _line(spark, d, "l_extendedprice").withColumnRenamed("l_extendedprice", "price")


@_made("parts")
def _parts(spark, d, path) -> Collection:
    fields = [f for f in _PART.fields if f.name != "maybe"]
    c = _filled(spark, path, fields, _keyed(_table(spark, d, "part"), "p_partkey"))
    c.drop_column("p_retailprice")
    return c


@_register("drop_column", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def _(spark, d):
    return _parts(spark, d).scan().drop("_id")


# -- quantizers, indexes, upkeep ----------------------------------------------------------------

_LO, _HI = "CAST(list_min(embedding) AS DOUBLE)", "CAST(list_max(embedding) AS DOUBLE)"


@_register("quant_int8_codes", f"SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * (254.0 / ({_HI} - {_LO})) + (-{_LO} * (254.0 / ({_HI} - {_LO})) - 127.0) + 0.5) AS INTEGER)), ',') AS codes FROM embeddings")
def _(spark, d):
    code = quantize.record_codes(F.col("embedding"))
    return _embeddings(spark, d).select("vec_id", F.array_join(code["codes"].cast("array<string>"), ",").alias("codes"))


@_register("quant_int4_codes", f"SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * (15.0 / ({_HI} - {_LO})) + (-{_LO} * (15.0 / ({_HI} - {_LO})) - 8.0) + 0.5) AS INTEGER)), ',') AS codes FROM embeddings")
def _(spark, d):
    code = quantize.record_codes(F.col("embedding"), 4)
    return _embeddings(spark, d).select("vec_id", F.array_join(code["codes"].cast("array<string>"), ",").alias("codes"))


_RANGE = "(SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings)"

for _levels in (255, 127, 15):

    @_register(f"quant_uniform_{_levels}", f"SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(least(greatest(floor((CAST(x AS DOUBLE) - lo) * ({_levels} / (hi - lo)) + 0.5), 0), {_levels}) AS INTEGER)), ',') AS codes FROM embeddings, {_RANGE}")
    def _(spark, d, levels=_levels):
        df = _embeddings(spark, d)
        low, high, whole = quantize.uniform_range(df, "embedding")
        codes = quantize.uniform_codes(F.col("embedding"), low, high, whole, levels)
        return df.select("vec_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


@_register("quant_fp16")
def _(spark, d):
    return _embeddings(spark, d).select("vec_id", quantize.fp16("embedding").alias("half"))


@_register("refine_two_stage", _vector_sql("l2", 10, 7))
def _(spark, d):
    query = _query_row(spark, d, 7).first()[0]
    return _shown(vector.refined(_embeddings(spark, d), "embedding", query, Metric.L2, 10, 10.0, key="vec_id"))


@_register("ivf_search", _vector_sql("l2", 10, 7))
def _(spark, d):
    """Stored cells and codes, and rows that came later; all cells are probed, so that the result is the exact one."""
    return _shown(_vectors(spark, d).query_df(Query("v", id=_key(7), nprobe=16, refine=20.0), 10, output_fields=["vec_id"]))


@_register("ivf_filtered", _vector_sql("l2", 5, 7, where="label <> 3"))
def _(spark, d):
    return _shown(_vectors(spark, d).query_df(Query("v", id=_key(7), nprobe=16, refine=20.0), 5, "label != 3", ["vec_id"]))


@_made("graph_vectors")
def _graph_vectors(spark, d, path) -> Collection:
    fields = [Field("vec_id", D.INT64), Field("v", D.VECTOR_FP32, True, 64, Index(IndexType.HNSW, Metric.COSINE, Quantize.FP16))]
    c = _filled(spark, path, fields, _keyed(_embeddings(spark, d).withColumnRenamed("embedding", "v"), "vec_id"))
    c.optimize()
    return Collection.open(spark, c.store.path)


@_register("hnsw_reopened_search", _vector_sql("cosine", 10, 7))
def _(spark, d):
    """A collection that was opened again reads the index that optimize() stored."""
    return _shown(_graph_vectors(spark, d).query_df(Query("v", id=_key(7), nprobe=1024, refine=20.0), 10, output_fields=["vec_id"]))


@_register("pq_search", _vector_sql("l2", 10, 7))
def _(spark, d):
    df = _embeddings(spark, d)
    pq = Pq.fit(df, "embedding", Metric.L2, 8, 64)
    return _shown(pq.search(pq.encode(df, "embedding"), "embedding", _query_row(spark, d, 7).first()[0], 10, 30.0, "vec_id"))


@_register("rabitq_search", _vector_sql("ip", 10, 7))
def _(spark, d):
    codes = RaBitQ(Metric.IP)
    return _shown(codes.search(codes.encode(_embeddings(spark, d), "embedding"), "embedding", _query_row(spark, d, 7).first()[0], 10, 10.0, "vec_id"))


@_register("stats_completeness", "SELECT count(*) AS doc_count, CAST(0.5 AS DOUBLE) AS completeness FROM embeddings")
def _(spark, d):
    """One of two segments is in the index."""
    stats = _vectors(spark, d).stats()
    return spark.createDataFrame([(stats["doc_count"], stats["index_completeness"]["v"])], "doc_count long, completeness double")


@_made("snapshot")
def _snapshot(spark, d, path) -> Collection:
    """A version that was read before rows were deleted and the log rewritten."""
    c = _filled(spark, path, _CUSTOMER_FIELDS, _keyed(_table(spark, d, "customer"), "c_custkey"))
    version = c.manifest["version"]
    c.delete_by_filter("c_nationkey > 10")
    c.optimize()
    return Collection.open(spark, path, version=version)


@_register("iterate_snapshot", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    return _snapshot(spark, d).scan(output_fields=["c_custkey", "c_name", "c_acctbal"]).drop("_id")


@_register("order_by_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
def _(spark, d):
    return _customers(spark, d).scan(limit=10, output_fields=["c_custkey", "c_acctbal"], order_by="c_acctbal", descending=True, offset=5).drop("_id")
