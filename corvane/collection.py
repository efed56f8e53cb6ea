"""Collections: typed tables with a primary key, changed row by row or by DataFrame, and searched."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, NotSupported, PermissionDenied
from .operators import ann, fulltext, fusion, postings, vector
from .plans.expressions import compile_expression, wrap
from .plans.filters import compile_filter
from .functions import metrics
from .sources.storage import Store
from .functions.text import analyze
from .types import MAX_BATCH, MAX_KEY, MAX_SPARSE, NUMERIC_RANGES, DataType, Field, Index, IndexType, Metric, Schema, check_index, check_key, check_value


@dataclass
class Doc:
    """A row: key, fields, and the score that a search gave it."""

    id: str
    fields: dict = field(default_factory=dict)
    score: float | None = None


@dataclass
class Query:
    """What to search for: a vector, a sparse vector {index: value}, the vector of a document, or text."""

    field: str
    vector: object = None
    id: str | None = None
    query_string: str | None = None
    match_string: str | None = None
    operator: str = "or"
    radius: float | None = None
    nprobe: int | None = None
    refine: float | None = None
    is_linear: bool = False
    #: A function of this query's documents, best first, that gives them back in its own order with its own scores (higher is better).
    rerank: Callable[[list[Doc]], list[Doc]] | None = None


_BAD_ROW = "CORVANE_BAD_ROW"
_META = [T.StructField("_doc_id", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType())]


class Collection:
    """A collection at a path. Readers see the version that was latest when they opened or refreshed."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, version: int | None = None):
        self.spark, self.store, self.read_only = spark, Store(spark, path), read_only
        self.manifest = self.store.read(version)
        self.schema = Schema.from_json(self.manifest["schema"])

    @staticmethod
    def create(spark: SparkSession, path: str, schema: Schema) -> Collection:
        """Make a new collection; the path must not exist."""
        schema.check()
        Store(spark, path).create({"version": 0, "schema": schema.to_json(), "segments": [], "next_doc_id": 0, "dirty": False, "side": {}})
        return Collection(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, read_only: bool = False, version: int | None = None) -> Collection:
        return Collection(spark, path, read_only or version is not None, version)

    def refresh(self) -> None:
        self.manifest = self.store.read()
        self.schema = Schema.from_json(self.manifest["schema"])

    # -- reading -----------------------------------------------------------------

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.spark().fields, *_META])

    def _log(self, segments: list[dict] | None = None) -> DataFrame:
        """Rows of segments, by default of all that hold rows."""
        segments = [s for s in self.manifest["segments"] if not s.get("deletes")] if segments is None else segments
        parts = [self._changed_since(s) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._stored())

    def _changed_since(self, segment: dict) -> DataFrame:
        """Rows of a segment with the schema's columns: changes of columns that came after it are made as it is read."""
        changes = self.manifest.get("changes", [])[segment.get("since", 0) :]
        if not changes:
            return self.store.segment(segment["name"], self._stored())
        schemas = [*(Schema.from_json(c["before"]) for c in changes), self.schema]
        df = self.store.segment(segment["name"], T.StructType([*schemas[0].spark().fields, *_META]))
        for change, before, after in zip(changes, schemas, schemas[1:], strict=False):
            df = self._with_change(df, change, before, [f.name for f in after.fields])
        return df

    @staticmethod
    def _with_change(df: DataFrame, change: dict, before: Schema, names: list[str]) -> DataFrame:
        """``df`` after one change: a column ``name`` that is new (``of`` an expression, or null), is ``old`` renamed or has another type."""
        made = {}
        if change["name"] is not None:
            kind = DataType(change["type"])
            if change["old"] is None:
                value = wrap(compile_expression(change["of"], before), kind) if change["of"] else F.lit(None).cast(kind.spark())
            else:
                col = F.col(f"`{change['old']}`")
                value = F.when(col.isNotNull(), wrap(col, kind)) if change["old"] == change["name"] else col
            made[change["name"]] = value
        return df.select("_id", *[made.get(n, F.col(f"`{n}`")).alias(n) for n in names], *[f.name for f in _META])

    def _superseded(self) -> DataFrame | None:
        """(_key, _last): the keys that upserts, updates and deletes have touched, and when last; no other column is read."""
        touched = [s for s in self.manifest["segments"] if s.get("dirty")]
        if not touched:
            return None
        schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_seq", T.LongType())])
        keys = reduce(DataFrame.union, [self.store.segment(s["name"], schema) for s in touched])
        return keys.groupBy(F.col("_id").alias("_key")).agg(F.max("_seq").alias("_last"))

    def _live_rows(self, rows: DataFrame) -> DataFrame:
        """Of rows with _id and _seq, those that no later write of their key has superseded. Filters on rows go below the join."""
        touched = self._superseded()
        return rows if touched is None else rows.join(touched, (F.col("_id") == F.col("_key")) & (F.col("_last") > F.col("_seq")), "left_anti")

    def df(self) -> DataFrame:
        """All live rows, lazily: the log without the rows that a later write of their key superseded; the last writer of each key wins."""
        return self._live_rows(self._log()).drop("_seq", "_deleted")

    def filtered(self, filter: str | None) -> DataFrame:
        condition = compile_filter(filter, self.schema)
        return self.df() if condition is None else self.df().where(condition)

    def projection(self, output_fields: list[str] | None, include_vector: bool = False) -> list[str]:
        """Names of the fields that a result shows: None all scalars, [] none, '*' all scalars."""
        if output_fields is None:
            names = self.schema.scalars()
        else:
            names = []
            for n in output_fields:
                names += self.schema.scalars() if n == "*" else [self.schema[n].name]
        return list(dict.fromkeys(names + (self.schema.vectors() if include_vector else [])))

    def _shown(self, df: DataFrame, names: list[str], include_doc_id: bool, *extra: str) -> DataFrame:
        return df.select("_id", *(["_doc_id"] if include_doc_id else []), *[F.col(f"`{n}`") for n in names], *extra)

    def scan(self, filter: str | None = None, limit: int | None = None, output_fields: list[str] | None = None, include_vector: bool = False, include_doc_id: bool = False, order_by: str | None = None, descending: bool = False, offset: int = 0) -> DataFrame:
        """Rows that pass a filter; with a limit or offset in the order of a scalar field (ties by key), or else of their insertion."""
        df = self.filtered(filter)
        if offset < 0:
            raise InvalidArgument("offset must be 0 or more")
        if order_by is not None:
            f = self.schema[order_by]
            if f.type.is_vector or f.type.is_array:
                raise InvalidArgument(f"{order_by} has no order")
            col = F.col(f"`{order_by}`")
            df = df.orderBy(col.desc_nulls_last() if descending else col.asc_nulls_first(), "_id")
        elif limit is not None or offset:
            df = df.orderBy("_doc_id")
        df = df.offset(offset) if offset else df
        df = df if limit is None else df.limit(vector.check_topk(limit))
        return self._shown(df, self.projection(output_fields, include_vector), include_doc_id)

    def fetch(self, ids: list[str], output_fields: list[str] | None = None, include_vector: bool = True) -> DataFrame:
        """The live rows of these keys; unknown keys are left out."""
        names = self.projection(output_fields, include_vector)
        return self._shown(self.df().where(F.col("_id").isin(*ids) if ids else F.lit(False)), names, False)

    def iterate(self, output_fields: list[str] | None = None, include_vector: bool = False) -> Iterator[Doc]:
        """All rows of this version, one partition at a time on the driver; later writes do not show."""
        if output_fields is not None and (len(set(output_fields)) != len(output_fields) or any(n not in self.schema or self.schema[n].type.is_vector for n in output_fields)):
            raise InvalidArgument("iterate takes known scalar fields, each once")
        return self._docs(self._shown(self.df(), self.projection(output_fields, include_vector), False).toLocalIterator())

    @staticmethod
    def _docs(rows) -> Iterator[Doc]:
        for r in rows:
            x = r.asDict()
            yield Doc(x.pop("_id"), {k: v for k, v in x.items() if not k.startswith("_")}, x.get("_score"))

    def resolve(self, doc_ids: list[int]) -> list[str | None]:
        """Keys of internal ids; -1, unknown and deleted ones give None."""
        have = {r["_doc_id"]: r["_id"] for r in self.df().where(F.col("_doc_id").isin(*doc_ids)).select("_doc_id", "_id").collect()} if doc_ids else {}
        return [have.get(i) for i in doc_ids]

    def stats(self) -> dict:
        """Live documents, and for each vector field the share of segments that its index covers.

        A flat index is the rows themselves and covers all; any other covers what optimize() built it for.
        """
        names = {s["name"] for s in self.manifest["segments"] if not s.get("deletes")}
        done = {}
        for n in self.schema.vectors():
            built = set(self.manifest["side"].get(n, {}).get("segments", [])) if self.schema[n].index.kind is not IndexType.FLAT else names
            done[n] = len(names & built) / len(names) if names else 1.0
        return {"doc_count": self.df().count(), "index_completeness": done}

    # -- searching ---------------------------------------------------------------

    def _query_vector(self, q: Query, f: Field):
        if q.id is not None:
            row = self.df().where(F.col("_id") == q.id).select(F.col(f"`{f.name}`")).first()
            if row is None or row[0] is None:
                raise NotFound(f"no vector of {q.id!r}")
            return dict(zip(row[0]["indices"], row[0]["values"], strict=True)) if f.type.is_sparse else list(row[0])
        if q.vector is None:
            raise InvalidArgument("a vector query needs a vector or an id")
        if f.type.is_sparse:
            return {int(k): float(v) for k, v in dict(q.vector).items()}
        if len(q.vector) != f.dimension:
            raise InvalidArgument(f"{len(q.vector)} numbers, the dimension of {f.name} is {f.dimension}")
        return [float(x) for x in q.vector]

    def _search(self, q: Query, topk: int, filter: str | None) -> tuple[DataFrame, Metric | str]:
        f = self.schema[q.field]
        if f.type.is_vector:
            if q.query_string is not None or q.match_string is not None:
                raise InvalidArgument(f"{f.name} is a vector field")
            v, metric = self._query_vector(q, f), f.index.metric
            df = self.filtered(filter)
            if f.type.is_sparse:
                if q.refine:
                    raise NotSupported("sparse vectors are not refined")
                return vector.sparse_top_k(df, f.name, v, topk, radius=q.radius), Metric.IP
            side = self.manifest["side"].get(f.name)
            if side and not q.is_linear and q.radius is None:
                return self._search_cells(f, side, v, q, topk, filter), metric
            if q.refine:
                return vector.refined(df, f.name, v, metric, topk, q.refine), metric
            return vector.dense_top_k(df, f.name, v, metric, topk, radius=q.radius), metric
        if f.index is None or f.index.kind is not IndexType.FTS:
            raise InvalidArgument(f"{f.name} has no full-text index")
        p, options = self._analysis(f)
        tree = fulltext.query_tree(self.spark, q.query_string, q.match_string, q.operator, p["tokenizer"], p["filters"], **options)
        return self._search_text(f, tree, topk, filter), "fts"

    def _search_cells(self, f: Field, side: dict, v: list[float], q: Query, topk: int, filter: str | None) -> DataFrame:
        """Through the stored cells of a field: the nearest cells' rows (by their codes first, if there are any), and segments that came later, whole."""
        index = ann.Stored(self.spark, f"{self.store.path}/{side['path']}", f.index.metric)
        rows = self._live_rows(index.probe(v, q.nprobe))
        condition = compile_filter(filter, self.schema)
        if condition is not None:
            rows = rows.join(self.df().where(condition).select("_id"), "_id", "left_semi")
        found = index.best(rows, v, topk, q.refine).select("_id", "_doc_id", "_score")
        later = [s for s in self.manifest["segments"] if not s.get("deletes") and s["name"] not in side["segments"]]
        if later:
            new = self._live_rows(self._log(later))
            new = vector.dense_top_k(new if condition is None else new.where(condition), f.name, v, f.index.metric, topk)
            found = found.union(new.select("_id", "_doc_id", "_score")).orderBy(*vector.ordered(f.index.metric)).limit(topk)
        return self._whole(found).orderBy(*vector.ordered(f.index.metric))

    def _whole(self, found: DataFrame) -> DataFrame:
        """The rows of a short list (_id, _doc_id, _score), whose keys are sent to the rows."""
        return self.df().drop("_doc_id").join(F.broadcast(found), "_id")

    def _analysis(self, f: Field) -> tuple[dict, dict]:
        p = f.index.all_params()
        return p, {k: p[k] for k in ("stemmer_lang", "token_chars") if k in p} | p.get("ngram", {})

    def _lengths_of(self, field_name: str, have: list[dict]) -> DataFrame:
        """(_id, _doc_id, _seq, n) of the documents of segments."""
        return reduce(DataFrame.unionByName, [postings.lengths(self._terms_of(field_name, s)) for s in have])

    def _terms_of(self, field_name: str, segment: dict) -> DataFrame:
        return self.spark.read.schema(postings.STORED).parquet(f"{self.store.path}/{segment['text'][field_name]['path']}/terms")

    def _search_text(self, f: Field, tree, topk: int, filter: str | None) -> DataFrame:
        """BM25 from the stored postings of the query's own words; rows are looked up for the best documents alone."""
        p = f.index.all_params()
        where, rows = compile_filter(filter, self.schema), [s for s in self.manifest["segments"] if not s.get("deletes")]
        if any(f.name not in s.get("text", {}) for s in rows):  # an index made after these rows, and not built yet: the texts themselves
            _, options = self._analysis(f)
            return fulltext.search(self.df(), f.name, tree, topk, where=where, k1=p["k1"], b=p["b"], tokenizer=p["tokenizer"], filters=p["filters"], **options)
        words = postings.all_words(tree)
        if not words or not rows:
            return self.df().withColumn("_score", F.lit(0.0)).where(F.lit(False))
        if self._superseded() is None:
            documents, total = (sum(s["text"][f.name][k] for s in rows) for k in ("documents", "tokens"))
        else:
            documents, total = self._live_rows(self._lengths_of(f.name, rows)).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        parts = [postings.of_terms(self._terms_of(f.name, s), words, s["text"][f.name]["folders"]) for s in rows]
        hits = self._live_rows(reduce(DataFrame.unionByName, parts))
        found = postings.search(hits, tree, documents, total / max(documents, 1), p["k1"], p["b"])
        if where is not None:
            found = found.join(self.df().where(where).select("_id"), "_id", "left_semi")
        found = found.orderBy(F.desc("_score"), "_id").limit(vector.check_topk(topk))
        return self._whole(found).orderBy(F.desc("_score"), "_id")

    def query_df(self, query: Query | list[Query] | None = None, topk: int = 10, filter: str | None = None, output_fields: list[str] | None = None, include_vector: bool = False, include_doc_id: bool = False, reranker=None, num_candidates: int | None = None) -> DataFrame:
        """Best rows with ``_score``. Without a query: rows in order of insertion. Several queries need a reranker."""
        names = self.projection(output_fields, include_vector)
        vector.check_topk(topk)
        if query is None:
            return self.scan(filter, topk, output_fields, include_vector, include_doc_id)
        if isinstance(query, Query):
            found, _ = self._search(query, topk, filter)
            return self._shown(found, names, include_doc_id, "_score")
        if len(query) < 2 or reranker is None:
            raise InvalidArgument("several queries, and a reranker, are needed")
        lists = []
        for q in query:
            rows, metric = self._search(q, num_candidates or max(topk, 10), filter)
            if q.rerank is not None:  # on the driver, over the query's few best documents
                best = q.rerank(list(self._docs(self._shown(rows, self.projection(None), False, "_score").collect())))
                rows, metric = self.spark.createDataFrame([(d.id, float(d.score)) for d in best], "_id string, _score double"), Metric.IP
            lists.append(fusion.Ranked(rows.select("_id", "_score"), metric))
        fused = fusion.fuse(lists, reranker, topk)
        full = self._shown(self.df(), names, include_doc_id)  # the short list is joined to the rows, whose keys are unique
        return full.join(F.broadcast(fused), "_id").orderBy(F.desc("_score"), "_id")

    def query(self, *args, **options) -> list[Doc]:
        return list(self._docs(self.query_df(*args, **options).collect()))

    def query_ids(self, query: Query, topk: int = 10, filter: str | None = None) -> tuple[list[int], list[float]]:
        """Internal ids and scores, padded with -1 and NaN to topk."""
        rows = self._search(query, vector.check_topk(topk), filter)[0].select("_doc_id", "_score").collect()
        short = topk - len(rows)
        return [r[0] for r in rows] + [-1] * short, [r[1] for r in rows] + [float("nan")] * short

    def group_by_query(self, query: Query, group_by: str, topk_per_group: int = 3, group_count: int = 2, filter: str | None = None, output_fields: list[str] | None = None) -> DataFrame:
        """The best rows of the best groups, with ``_group`` and ``_score``."""
        f = self.schema[query.field]
        if not f.type.is_vector:
            raise InvalidArgument("groups need a vector query")
        if f.index.kind in (IndexType.IVF, IndexType.IVF_RABITQ, IndexType.DISKANN, IndexType.VAMANA) or query.refine:
            raise NotSupported(f"groups go with flat and hnsw indexes, not {f.index.kind.value}, and without refinement")
        key = vector.group_key(group_by, self.schema[group_by].type)
        v, metric = self._query_vector(query, f), f.index.metric
        col = F.col(f"`{f.name}`")
        score = metrics.sparse_inner_product(col, v) if f.type.is_sparse else metrics.score(metric, col, metrics.vector_literal(v))
        names = self.projection(output_fields)
        found = vector.top_groups(self.filtered(filter), score, metric, key, topk_per_group, group_count, radius=query.radius)
        return self._shown(found, names, False, "_group", "_score")

    # -- writing -----------------------------------------------------------------

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionDenied("the collection was opened to be read")

    def _commit(self, **changes) -> None:
        self.manifest = self.store.commit(self.manifest | changes | {"version": self.manifest["version"] + 1})
        self.schema = Schema.from_json(self.manifest["schema"])

    def _rows(self, docs: list[Doc], partial: bool = False) -> list[tuple]:
        """Checked documents as (key, values, given); one bad document fails all."""
        if len(docs) > MAX_BATCH:
            raise InvalidArgument(f"at most {MAX_BATCH} documents at a time; insert_df takes any number")
        out = []
        for d in docs:
            check_key(d.id)
            unknown = [n for n in d.fields if n not in self.schema]
            if unknown:
                raise InvalidArgument(f"unknown fields {unknown}")
            missing = [f.name for f in self.schema.fields if f.name not in d.fields and not f.nullable]
            if missing and not partial:
                raise InvalidArgument(f"missing fields {missing}")
            values = {f.name: check_value(f, d.fields[f.name]) for f in self.schema.fields if f.name in d.fields}
            out.append((d.id, values))
        return out

    def _append(self, rows: list[tuple[str, dict]], deleted: bool, dirty: bool) -> None:
        if not rows:
            return
        first, seq = self.manifest["next_doc_id"], self.manifest["version"] + 1
        data = [(i, *[v.get(f.name) for f in self.schema.fields], first + k, seq, deleted) for k, (i, v) in enumerate(rows)]
        self._add(self.spark.createDataFrame(data, self._nullable()).coalesce(1), len(rows), dirty, deleted)

    def _nullable(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self._stored().fields])

    def _add(self, df: DataFrame, count: int, dirty: bool, deletes: bool = False) -> None:
        segment = self._segment(self.store.write_segment(df), dirty, deletes)
        self._commit(segments=[*self.manifest["segments"], segment], next_doc_id=self.manifest["next_doc_id"] + count, dirty=self.manifest["dirty"] or dirty)

    def _segment(self, name: str, dirty: bool = False, deletes: bool = False, schema: Schema | None = None) -> dict:
        """A manifest's entry of a written segment; the postings of its texts are written beside it."""
        entry: dict = {"name": name, "dirty": dirty, "deletes": deletes, "since": len(self.manifest.get("changes", []))}
        texts = [f for f in (schema or self.schema).fields if f.index is not None and f.index.kind is IndexType.FTS]
        if not deletes and texts:
            entry["text"] = {f.name: self._write_postings(f, name) for f in texts}
        return entry

    def _write_postings(self, f: Field, name: str) -> dict:
        p, options = self._analysis(f)
        path = f"side/{uuid.uuid4().hex}-{f.name}"
        rows = self.store.segment(name, T.StructType([T.StructField("_id", T.StringType()), T.StructField(f.name, T.StringType()), *_META]))
        count = rows.select("_id").count()
        tokens = lambda c: analyze(c, p["tokenizer"], p["filters"], **options)
        made = postings.build(rows, f.name, tokens, count, self.spark.sparkContext.defaultParallelism)
        made.write.partitionBy("_folder").parquet(f"{self.store.path}/{path}/terms")
        entry = {"path": path, "folders": postings.folders(count)}
        documents, total = self._lengths_of(f.name, [{"text": {f.name: entry}}]).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return entry | {"documents": documents, "tokens": total}

    def _live(self, ids: list[str]) -> set[str]:
        return {r[0] for r in self.df().where(F.col("_id").isin(*ids)).select("_id").collect()} if ids else set()

    def insert(self, docs: list[Doc]) -> list[str]:
        """Add documents; status of each: OK, or ALREADY_EXISTS for a live key or one given before."""
        self._writable()
        rows = self._rows(docs)
        taken, new, status = self._live([i for i, _ in rows]), [], []
        for i, v in rows:
            status.append("ALREADY_EXISTS" if i in taken else "OK")
            if i not in taken:
                taken.add(i)
                new.append((i, v))
        self._append(new, False, False)
        return status

    def upsert(self, docs: list[Doc]) -> list[str]:
        """Add or wholly replace documents; of one key the last given stays."""
        self._writable()
        rows = dict(self._rows(docs))
        self._append(list(rows.items()), False, True)
        return ["OK"] * len(docs)

    def update(self, docs: list[Doc]) -> list[str]:
        """Merge given fields into live documents; a field given as null becomes null. NOT_FOUND without one."""
        self._writable()
        rows = self._rows(docs, partial=True)
        old = {r["_id"]: {f.name: r[f.name] for f in self.schema.fields} for r in self.df().where(F.col("_id").isin(*[i for i, _ in rows])).collect()} if rows else {}
        status, changed = [], {}
        for i, v in rows:
            status.append("OK" if i in old else "NOT_FOUND")
            if i in old:
                old[i] = changed[i] = old[i] | v
        self._append(list(changed.items()), False, True)
        return status

    def delete(self, ids: list[str]) -> list[str]:
        """Delete by key; NOT_FOUND for keys that are not live."""
        self._writable()
        live, status, gone = self._live(ids), [], {}
        for i in ids:
            status.append("OK" if i in live else "NOT_FOUND")
            if i in live:
                live.remove(i)
                gone[i] = {}
        self._append(list(gone.items()), True, True)
        return status

    def delete_by_filter(self, filter: str) -> int:
        """Delete the rows that pass; how many. Runs on the executors, whatever the number."""
        self._writable()
        condition = compile_filter(filter, self.schema)
        if condition is None:
            raise InvalidArgument("a filter is needed")
        rows = self.df().where(condition).select("_id", *[F.lit(None).cast(f.type.spark()).alias(f.name) for f in self.schema.fields], "_doc_id", F.lit(self.manifest["version"] + 1).alias("_seq"), F.lit(True).alias("_deleted"))
        name = self.store.write_segment(rows)
        count = self.store.segment(name, self._stored()).count()
        self._commit(segments=[*self.manifest["segments"], self._segment(name, True, True)], dirty=True)
        return count

    def _checked(self, df: DataFrame, partial: bool = False) -> DataFrame:
        """``df`` as the fields store it; a row that breaks a rule fails the write, in the pass that writes it."""
        unknown = [c for c in df.columns if c != "_id" and c not in self.schema]
        missing = [f.name for f in self.schema.fields if f.name not in df.columns and not f.nullable]
        if "_id" not in df.columns or unknown or missing and not partial:
            raise InvalidArgument(f"_id and the fields are needed; unknown {unknown}, missing {missing}")
        out = [self._sure(F.col("_id").cast("string"), F.length(F.encode("_id", "UTF-8")).between(1, MAX_KEY) & ~F.col("_id").rlike(r"[\x00-\x1f\x7f\x85\x{2028}\x{2029}]"), "bad primary key").alias("_id")]
        for f in self.schema.fields:
            if f.name not in df.columns:
                if not partial:
                    out.append(F.lit(None).cast(f.type.spark()).alias(f.name))
                continue
            value = F.col(f"`{f.name}`").cast(f.type.spark())
            ok = F.lit(True) if f.nullable else value.isNotNull()
            if f.type.is_dense:
                ok = ok & (F.size(value) == f.dimension)
            elif f.type.is_sparse:
                ok = ok & (F.size(value["indices"]) <= MAX_SPARSE)
            elif f.type.is_integer:
                low, high = NUMERIC_RANGES[f.type.value]
                ok = ok & value.between(F.lit(low), F.lit(high))
            out.append(self._sure(value, F.coalesce(ok, F.lit(f.nullable)), f"{f.name} is null or does not fit").alias(f.name))
        return df.select(*out)

    @staticmethod
    def _sure(value: Column, ok: Column, message: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"[{_BAD_ROW}] {message}")).cast("void"))

    def _numbered(self, df: DataFrame) -> DataFrame:
        first, seq = self.manifest["next_doc_id"], self.manifest["version"] + 1
        return df.select("_id", *[F.col(f"`{f.name}`") for f in self.schema.fields], (F.col("_turn") + first).alias("_doc_id"), F.lit(seq).cast("long").alias("_seq"), F.lit(False).alias("_deleted"))

    @staticmethod
    def _one_each(df: DataFrame, pick) -> DataFrame:
        """One row of each key, by ``pick`` (min_by or max_by) of the rows' order."""
        rows = df.select("_id", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("turn"))
        chosen = rows.groupBy("_id").agg(pick(F.struct("row", "turn"), "turn").alias("x"))
        return chosen.select("x.row.*", F.col("x.turn").alias("_turn"))

    def insert_df(self, df: DataFrame) -> None:
        """Insert a DataFrame with ``_id`` and the fields (nullable ones may be missing); keys that are live already are left out, of repeats the first stays.

        Internal ids follow the order of the rows. Rows are held to the rules that insert() has; one bad row fails all.
        """
        self._writable()
        self._bulk(self._turned(self._checked(df)), False, F.min, self.df().select("_id") if self.manifest["segments"] else None)

    def upsert_df(self, df: DataFrame) -> None:
        """Upsert a DataFrame with ``_id`` and the fields; of repeated keys the last row stays."""
        self._writable()
        self._bulk(self._turned(self._checked(df)), True, F.max)

    @staticmethod
    def _turned(df: DataFrame) -> DataFrame:
        return df.withColumn("_turn", F.monotonically_increasing_id())

    def _one_of_each(self, name: str, pick, taken: DataFrame | None) -> str:
        """The segment, or one in its place, with one row of each key, by ``pick`` (min or max) of their order, and none of the keys ``taken``.

        Only keys move, or their digests; the rows move where some of them have to go.
        """
        rows = self.store.segment(name, self._stored())
        keys = rows.select("_id", "_doc_id")
        twice = not keys.groupBy(F.xxhash64("_id").alias("_digest")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
        met = taken is not None and not keys.join(taken, "_id", "left_semi").isEmpty()
        if not twice and not met:
            return name
        stay = keys.groupBy("_id").agg(pick("_doc_id").alias("_doc_id")) if twice else keys
        stay = stay.join(taken, "_id", "left_anti") if met else stay
        again = self.store.write_segment(rows.join(stay.select("_doc_id"), "_doc_id", "left_semi").select(*rows.columns))
        self.store.drop_segment(name)
        return again

    def update_df(self, df: DataFrame) -> None:
        """Merge a DataFrame with ``_id`` and some fields into live rows, on the executors; of repeated keys the last row stays, unknown keys are left out."""
        self._writable()
        new = self._one_each(self._checked(df, partial=True), F.max_by)
        given = [c for c in new.columns if c not in ("_id", "_turn")]
        new = new.select("_id", F.struct(*[F.col(f"`{c}`") for c in given]).alias("_new"), "_turn")
        rows = self.df().join(new, "_id")
        self._bulk(rows.select("_id", *[(F.col(f"_new.`{f.name}`") if f.name in given else F.col(f"`{f.name}`")).alias(f.name) for f in self.schema.fields], "_turn"), True)

    def delete_df(self, keys: DataFrame) -> None:
        """Delete the live rows whose key is in the column ``_id``, on the executors."""
        self._writable()
        gone = self.df().join(keys.select("_id").distinct(), "_id", "left_semi")
        rows = gone.select("_id", *[F.lit(None).cast(f.type.spark()).alias(f.name) for f in self.schema.fields], "_doc_id", F.lit(self.manifest["version"] + 1).alias("_seq"), F.lit(True).alias("_deleted"))
        self._commit(segments=[*self.manifest["segments"], self._segment(self.store.write_segment(rows), True, True)], dirty=True)

    def _bulk(self, df: DataFrame, dirty: bool, pick=None, taken: DataFrame | None = None) -> None:
        """Write rows with ``_turn`` as a segment; of repeated keys the one that ``pick`` takes, unless all are known to differ."""
        try:
            name = self.store.write_segment(self._numbered(df))
        except Exception as e:
            if _BAD_ROW in str(e):
                raise InvalidArgument(str(e).split(_BAD_ROW + "]")[1].split("\n")[0].strip()) from None
            raise
        if pick is not None:
            name = self._one_of_each(name, pick, taken)
        top = self.store.segment(name, self._stored()).agg(F.max("_doc_id")).first()[0]
        self._commit(segments=[*self.manifest["segments"], self._segment(name, dirty)], next_doc_id=self.manifest["next_doc_id"] if top is None else top + 1, dirty=self.manifest["dirty"] or dirty)

    # -- upkeep and schema ---------------------------------------------------------

    def optimize(self, partitions: int | None = None) -> None:
        """Rewrite the live rows as one segment (unless that is what they are), and build postings and cells of the schema's indexes."""
        self._writable()
        segments = self.manifest["segments"]
        if not segments:
            return
        if len(segments) > 1 or self.manifest["dirty"] or self.manifest.get("changes") or partitions is not None:
            df = self.df().select("_id", *[F.col(f"`{f.name}`") for f in self.schema.fields], "_doc_id", F.lit(0).cast("long").alias("_seq"), F.lit(False).alias("_deleted"))
            segments = [self._segment(self.store.write_segment(df if partitions is None else df.repartition(partitions, "_id"))) | {"since": 0}]
        elif any(f.name not in segments[0].get("text", {}) for f in self._texts()):
            segments = [self._segment(segments[0]["name"])]
        side = {f.name: self._build_cells(f, segments[0]["name"]) for f in self.schema.fields if f.type.is_dense and f.index.kind is not IndexType.FLAT}
        self._commit(segments=segments, dirty=False, side={k: v for k, v in side.items() if v}, changes=[])

    def _texts(self) -> list[Field]:
        return [f for f in self.schema.fields if f.index is not None and f.index.kind is IndexType.FTS]

    def _build_cells(self, f: Field, name: str) -> dict | None:
        """Cells of a vector field's index, written once; None if no row has a vector.

        Graph kinds are served by cells too: neighbours of a query lie in few of them, whatever structure finds these.
        """
        rows = self.store.segment(name, self._stored()).select("_id", "_doc_id", "_seq", F.col(f"`{f.name}`").alias("_v")).where("_v is not null")
        path = f"side/{uuid.uuid4().hex}-{f.name}"
        built = ann.Stored.build(rows, f"{self.store.path}/{path}", f.index)
        return {"path": path, "segments": [name]} if built else None

    def create_index(self, name: str, index: Index) -> None:
        """Give a field an index; the same one again changes nothing."""
        self._writable()
        f = self.schema[name]
        check_index(f, index)
        if f.index == index:
            return
        kinds = {f.index.kind if f.index else None, index.kind}
        if kinds == {IndexType.INVERT, IndexType.FTS}:
            raise FailedPrecondition(f"drop the index of {name} first")
        f.index = index
        # what was built for another index of the field counts no more
        segments = [{**s, "text": {k: v for k, v in s.get("text", {}).items() if k != name}} for s in self.manifest["segments"]]
        self._commit(schema=self.schema.to_json(), segments=segments, side={k: v for k, v in self.manifest["side"].items() if k != name})

    def drop_index(self, name: str) -> None:
        self._writable()
        f = self.schema[name]
        f.index = Index(metric=f.index.metric) if f.type.is_vector else None
        self._commit(schema=self.schema.to_json(), side={k: v for k, v in self.manifest["side"].items() if k != name})

    def _change(self, schema: Schema, name: str | None = None, old: str | None = None, of: str = "") -> None:
        """Publish a schema with one change of a column. No row is written: segments are read with the changes that came after them, until optimize() writes them so.

        What a row's value would fail at fails here, as the values are computed once.
        """
        change = {"before": self.schema.to_json(), "name": name, "old": old, "of": of, "type": None if name is None else schema[name].type.value}
        if self.manifest["segments"] and (of or name is not None and old == name):
            self._with_change(self.df().withColumns({"_seq": F.lit(0), "_deleted": F.lit(False)}), change, self.schema, [f.name for f in schema.fields]).agg(F.max(f"`{name}`")).first()
        changes = [*self.manifest.get("changes", []), change] if self.manifest["segments"] else []
        self._commit(schema=schema.to_json(), changes=changes, side={k: v for k, v in self.manifest["side"].items() if k in schema})

    def add_column(self, new: Field, expression: str = "") -> None:
        """Add a numeric column, computed from others, or all null if it may be."""
        self._writable()
        if new.name in self.schema:
            raise AlreadyExists(new.name)
        if not new.type.is_numeric:
            raise InvalidArgument("only numeric columns are added")
        new.check()
        if not expression.strip():
            if not new.nullable:
                raise InvalidArgument(f"{new.name} needs an expression or must be nullable")
        else:
            compile_expression(expression, self.schema)  # one that cannot be read fails
        self._change(Schema(self.schema.name, [*self.schema.fields, new], self.schema.max_docs_per_segment).check(), new.name, of=expression.strip())

    def drop_column(self, name: str) -> None:
        self._writable()
        if not self.schema[name].type.is_numeric or len(self.schema.fields) == 1:
            raise InvalidArgument("only numeric columns that are not the last are dropped")
        self._change(Schema(self.schema.name, [f for f in self.schema.fields if f.name != name], self.schema.max_docs_per_segment))

    def alter_column(self, name: str, rename: str | None = None, new: Field | None = None) -> None:
        """Rename a numeric column, or give it another numeric type; not both."""
        self._writable()
        f = self.schema[name]
        if (rename is None) == (new is None):
            raise InvalidArgument("give a new name or a new type")
        if not f.type.is_numeric or new is not None and not new.type.is_numeric:
            raise InvalidArgument("only numeric columns are altered")
        if new is not None and f.nullable and not new.nullable:
            raise InvalidArgument(f"{name} may hold nulls")
        if rename is not None and rename in self.schema:
            raise AlreadyExists(rename)
        target = Field(rename or name, new.type if new else f.type, new.nullable if new else f.nullable, 0, f.index)
        target.check()
        self._change(Schema(self.schema.name, [target if x.name == name else x for x in self.schema.fields], self.schema.max_docs_per_segment), target.name, name)

    def view(self, name: str) -> None:
        """Register the live rows as a view, for ``spark.sql``."""
        self.df().createOrReplaceTempView(name)

    def flush(self) -> None:
        """Writes are durable when they return; nothing is left to do."""

    close = flush

    def destroy(self) -> None:
        self._writable()
        self.store.destroy()
