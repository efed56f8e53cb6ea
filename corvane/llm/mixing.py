"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

A source of W words and target T takes every document T / W times on average.
Prefix sums of these expected copies run through the source in order of size, so that
each stretch of like sizes gets its share; one offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, word_count

#: No source takes more than so many times its words.
MOST = 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Documents that share one window task, on average.
SPAN = 20_000
SEED = "corvane-mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    All words together are shared by weight; a source's target stops at ``most`` times its size and
    the excess goes to the others by weight until none is above. That is the water level at
    which the sources of the smallest limit per weight are full: ``level`` below is
    (all - limits of the full) / (weights of the rest), and a source is full while
    its own limit per weight lies under the level of those before it. The windows hold one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    # the first source that its level leaves under its limit sets the level of all after it
    first = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("open", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(first))
    target = F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open")), F.col("limit")).otherwise(F.col("weight") * F.col("open"))
    return s.select("source", "source_size", target.alias("target"))


def _offset(source: Column) -> Column:
    """The source's one random offset in [0, 1), from a digest of the seed and its name."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _part(doc_id: Column, parts: Column) -> Column:
    """The part of a source's size class that a document is in, by a digest of its id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts


def _placed(rows: DataFrame, keys: list[str], weights: tuple[int, ...], most: int, path: str) -> DataFrame:
    """(source, size, keys, m, place, rate, source_size, target): the m rows of each group of like rows take the places after ``place`` in their source.

    The order is by size class, part, size and keys. Like rows are counted before anything moves, so that an id that
    many rows share is one row; the prefix sum has two levels: windows over (source, size class, part), whose parts
    hold about SPAN rows however large a source is, and a window over the parts' counts.
    """
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), f"{path}/targets")
    # size classes grow by a sixteenth, so a source has few hundred of them
    band = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 16) + 1).otherwise(0).cast("int")
    groups = stored(rows.groupBy("source", "size", *keys).agg(F.count(F.lit(1)).alias("m")).withColumn("band", band), f"{path}/groups")
    counts = groups.groupBy(F.col("source").alias("s"), F.col("band").alias("b")).agg(F.ceil(F.sum("m") / SPAN).alias("parts"))
    groups = groups.join(stored(counts, f"{path}/counts"), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
    groups = stored(groups.select("source", "size", *keys, "m", "band", _part(F.col("doc_id"), F.col("parts")).alias("part")), f"{path}/parts")
    up_to = Window.partitionBy("source").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    heads = groups.groupBy("source", "band", "part").agg(F.sum("m").alias("n"))
    heads = stored(heads.select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before")), f"{path}/heads")
    within = Window.partitionBy("source", "band", "part").orderBy("size", *[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("place", F.coalesce(F.sum("m").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("part") == F.col("p"))
    groups = groups.join(heads, same).select("source", "size", *keys, "m", (F.col("before") + F.col("place")).alias("place"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"))
    return groups.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _copies(place: Column, most: int) -> Column:
    """Integers that the stretch of the row at a place (from 1) crosses."""
    sums = lambda x: F.floor(x * F.col("rate") + _offset(F.col("source")))
    return F.least(sums(place) - sums(place - 1), F.lit(most)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``size`` is the number of words of the whole text, however long (null: 0), ``copies`` how often the mix
    emits the document and ``taken`` the words it takes so. A source that is null is
    a source of its own. Rows are ordered by size and id; equal rows are interchangeable, so
    repeated ids and ties do no harm. No document is taken more than ``most`` times. Reruns give the same copies.
    A source without words has target 0 and no copies. An empty table gives no rows; other columns are not read.
    """
    path = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    out = _placed(stored(rows, f"{path}/sizes"), ["doc_id"], weights, most, path)
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("copies", _copies(F.col("place") + F.col("turn"), most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _with_rows(docs: DataFrame, path: str) -> DataFrame:
    """(whole, _file, _row): all columns of a row as one struct, and what names it. Parquet tables name their rows themselves; others are written first."""
    pick = lambda d: d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("whole"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    try:
        return pick(docs)
    except AnalysisException:
        return pick(stored(docs, f"{path}/docs"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns are those of ``docs``.

    The copies are those of mix(), row by row: rows of a null or repeated id have each their own number. Where rows are equal in id,
    source and size, which of them has a copy more goes by their place in the table. Texts without words are not taken;
    an empty table gives no rows.
    """
    path = shared_dir(docs.sparkSession)
    named = _with_rows(docs, path)
    own = lambda c: F.col(f"whole.`{c}`")
    rows = named.select(own(id_col).alias("doc_id"), own(source_col).cast("string").alias("source"), word_count(own(text_col)).alias("size"), "_file", "_row")
    rows = stored(rows, f"{path}/sizes")
    groups = _placed(rows, ["doc_id", "_file"], weights, most, path)
    groups = groups.select(*[F.col(c).alias(f"g{c}") for c in ("doc_id", "_file", "source", "size")], "place", "rate")
    same = [F.col(c).eqNullSafe(F.col(f"g{c}")) for c in ("doc_id", "_file", "source", "size")]
    like = Window.partitionBy("doc_id", "_file", "source", "size").orderBy("_row")
    rows = rows.withColumn("turn", F.row_number().over(like)).join(groups, same[0] & same[1] & same[2] & same[3])
    copies = rows.select(F.col("_file").alias("f"), F.col("_row").alias("r"), _copies(F.col("place") + F.col("turn"), most).cast("int").alias("_copies")).where("_copies > 0")
    joined = named.join(stored(copies, f"{path}/copies"), (F.col("_file") == F.col("f")) & (F.col("_row") == F.col("r")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("whole.*")


def oracle() -> str:
    """DuckDB SQL of op8_mixing over ``documents``, by the same order, offsets and water level."""
    words = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"
    digits = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    weight = f"list_extract([{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}], 1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT)"
    return f"""
WITH d AS (SELECT doc_id, source, {words}::BIGINT AS size FROM documents),
b AS (SELECT *, CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) * 16)::INT + 1 ELSE 0 END AS band FROM d),
c AS (SELECT *, ceil(count(*) OVER (PARTITION BY source, band) / {SPAN}::DOUBLE)::BIGINT AS parts FROM b),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY band, {digits("coalesce(doc_id::VARCHAR, '')")} % parts, size, doc_id NULLS FIRST) AS place FROM c),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight, (source_size * {MOST})::DOUBLE AS lim FROM s),
l AS (SELECT *, lim / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first(CASE WHEN ratio > level THEN level END ORDER BY CASE WHEN ratio > level THEN 0 ELSE 1 END, ratio, source NULLS LAST) OVER () AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN open IS NULL OR ratio <= open THEN lim ELSE weight * open END AS target FROM f),
r AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             {digits(f"'{SEED}:' || coalesce(p.source, chr(0) || 'null')")} / 4294967296.0::DOUBLE AS offs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(floor(place * rate + offs) - floor((place - 1) * rate + offs), {MOST})::BIGINT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM k"""
