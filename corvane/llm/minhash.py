"""Near-duplicate documents by HyperMinHash sketches, banding, estimate and exact check.

Each of REGISTERS hash functions is a bucket whose minimum over a document's
shingles is kept as a leading-zero count and ten mantissa bits (16 bits in all).
Five neighbouring registers form one of forty bands: two documents of Jaccard
similarity 0.8 miss all bands with probability (1 - 0.8**5)**40 = 1.3e-7.

No step emits all pairs of a group. Documents with equal shingle sets are one
class from the start. A bucket of classes first gives a star around its most central class, the one
whose own buckets are largest. Links that hold on full sets join classes into components, and only
then are pairs *between different components* of a bucket looked at: all of them in
a bucket of up to FEW classes, and in larger ones those that an exact filter on the full sets
leaves (see ``_rare_pairs``). No link found by banding is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, claim, dealt, files_for, mix64, release, shared_dir, shingle_hashes, slices, split_join, stored, word_hashes
from .components import components

ROWS, BANDS, MANTISSA = 5, 40, 10
REGISTERS = ROWS * BANDS
#: Standard errors below the threshold at which an estimate rules a pair out: 1e-9 of true pairs.
MARGIN = 6.0
#: Classes of a bucket up to which all pairs between its components are looked at.
FEW = 24
#: Length classes per power of e: sets of one class differ by 2 % in size.
LENGTHS = 50
#: Most bits of the filter of ids whose full sets are built: 8 MB on the driver and in a broadcast.
FILTER_BITS = 26
#: Most bits of the places of the table that orders shingles: 16 MB in a broadcast.
PLACE_BITS = 22

_rng = np.random.default_rng(20240)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS compressed minima (uint16: leading zeros << 10 | mantissa) of a shingle set."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] ^ _XOR
        x *= _MUL
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def compress(low: np.ndarray) -> np.ndarray:
    """Leading-zero count and MANTISSA bits after the leading one, for an array of 32-bit minima."""
    zeros = np.where(low == 0, 32, 32 - np.frexp(low.astype(np.float64))[1]).astype(np.uint64)
    rest = (low.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(32 - MANTISSA))).astype(np.uint16)


@lru_cache(4096)
def collision(a: float, b: float) -> float:
    """Chance that registers of disjoint sets of 2**a and 2**b shingles agree by compression alone."""
    n, m = 2.0**a, 2.0**b
    i = np.arange(32)[:, None]
    j = np.arange(1 << MANTISSA)[None]
    width = 2.0 ** -(i + 1)
    lo = width * (1 + j / (1 << MANTISSA))
    hi = lo + width / (1 << MANTISSA)
    cell = lambda k: np.exp(k * np.log1p(-lo)) - np.exp(k * np.log1p(-np.minimum(hi, 1 - 1e-12)))
    return float((cell(n) * cell(m)).sum())


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of rows of registers x and y of sets of n and m shingles."""
    share = (x == y).mean(axis=1)
    chance = np.array([collision(round(2 * np.log2(max(a, 1))) / 2, round(2 * np.log2(max(b, 1))) / 2) for a, b in zip(n, m, strict=True)])
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """k1 and k2 of shingle sets: two sums that name a set."""
    sums = [(np.add.reduce(s), np.add.reduce(mix64(s ^ np.uint64(0xA0761D6478BD642F)))) for s in sets]
    both = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for whole in batches:
            for batch in slices(whole, limit=2 << 20):
                words, at = word_hashes(*buffers(batch.column("text")))
                sets, low = [], np.empty((batch.num_rows, REGISTERS), np.uint32)
                for r in range(batch.num_rows):
                    sets.append(shingle_hashes(words[at[r] : at[r + 1]], k))
                    low[r] = sketch(sets[r])
                regs = np.ascontiguousarray(compress(low))
                raw = regs.view(np.uint8).reshape(len(sets), -1) if sets else regs
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), *_keys(sets), pa.array([x.tobytes() for x in raw], pa.binary())],
                    ["id", "n", "k1", "k2", "regs"],
                )
        release()

    return run


def _sets(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for whole in batches:
            ok = np.ones(whole.num_rows, bool)
            for name in ("h1", "h2"):
                h = whole.column(name).to_numpy(zero_copy_only=False).astype(np.uint64)
                ok &= (held[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            for batch in slices(whole.filter(pa.array(ok)), limit=2 << 20):
                words, at = word_hashes(*buffers(batch.column("text")))
                sets = [shingle_hashes(words[at[r] : at[r + 1]], k) for r in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *_keys(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "k1", "k2", "shingles"])

    return run


def _hashes(name: str, bits: int) -> list:
    return [F.expr(f"xxhash64({name}, {seed}L) & {bits - 1}L").alias(f"h{seed}") for seed in (1, 2)]


def _id_filter(ids: DataFrame, count: int) -> tuple[int, object]:
    """Size and broadcast words of a Bloom filter of the ``count`` ids. Its size is bounded: past it more ids pass, and the joins that follow drop them."""
    spark = ids.sparkSession
    bits = 1 << min(FILTER_BITS, max(16, (16 * count).bit_length()))
    at = ids.select(F.explode(F.array(*_hashes("id", bits))).alias("h"))
    words = at.groupBy(F.expr("shiftright(h, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits, spark.sparkContext.broadcast(held)


def _full_sets(docs: DataFrame, ids: DataFrame, count: int, k: int, repeats: bool) -> DataFrame:
    """(id, k1, k2, shingles), each set of an id once, of the documents whose id is among ``ids``, and of few others.

    To be joined by id and set: an id that the filter lets pass by chance may be a copy of a wanted one, and a large group has many of these.
    """
    bits, held = _id_filter(ids, count)
    sets = docs.select("id", "text", *_hashes("id", bits)).where("id is not null").mapInArrow(_sets(k, held), "id long, k1 long, k2 long, shingles array<long>")
    return sets.groupBy("id", "k1", "k2").agg(F.first("shingles").alias("shingles")) if repeats else sets


#: A pair of classes: the smallest ids of their documents, and the names of their sets.
_PAIR = ["a", "b", "a1", "a2", "b1", "b2"]


def _likely(threshold: float):
    margin = MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n, m = b.column("n_a").to_numpy(zero_copy_only=False), b.column("n_b").to_numpy(zero_copy_only=False)
            j = estimate(x, y, n, m)
            ok = (j >= threshold - margin) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield b.select(_PAIR).filter(pa.array(ok))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents link when 100 * |A and B| >= percent * |A or B| on their sets of
    k-word shingles; components are closed under links. Words are lower-cased
    in A-Z. Whole texts are read, however long. Nulls: a null text has no shingles and links with nothing; a row of null
    id does not link either, its component is null and it is kept. Rows that share an id are one document: a link of any
    of their texts holds for all. Ties: the smallest id is kept. An empty table gives no rows;
    other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_sketches(k), "id long, n long, k1 long, k2 long, regs binary"), f"{path}/rows")
    files = files_for(spark, rows.count())
    linking = rows.where("n > 0 and id is not null")
    # a class: documents of one set; cls names it, cid (its smallest id, which classes of a repeated id may share) is its node
    classes = linking.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), f"{path}/classes")
    repeated = stored(dealt(linking.groupBy("id").agg(F.count(F.lit(1)).alias("c"), *[f(x).alias(f"{x}_{f.__name__}") for x in ("k1", "k2") for f in (F.min, F.max)]).where("c > 1"), files), f"{path}/repeated")
    repeats = not repeated.isEmpty()
    some_texts = repeated.where("k1_min != k1_max or k2_min != k2_max").select("id")  # an id of several texts joins their classes
    same_id = None if not repeats or some_texts.isEmpty() else split_join(linking.join(some_texts, "id", "left_semi").select("id", "k1", "k2"), classes.select("k1", "k2", "cid"), ["k1", "k2"], ["id"])

    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = classes.select("cls", "regs", band.alias("band")).select(F.xxhash64("band", F.expr(f"substring(regs, band * {width} + 1, {width})")).alias("key"), "cls")
    buckets = bands.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("size"))
    buckets = stored(dealt(buckets.where("low < high"), files), f"{path}/buckets")
    members = stored(dealt(bands.join(buckets.where("size > 2").select("key", "size"), "key"), files), f"{path}/members")
    central = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    hubs = members.join(central, "cls").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("cls").alias("turn"), "cls")).alias("hub"))

    pairs = buckets.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    star = split_join(members, hubs.select("key", F.col("hub.cls").alias("hub")), ["key"], ["cls"]).where("cls != hub")
    pairs = stored(dealt(pairs.union(star.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))).distinct(), files), f"{path}/pairs")
    links = _verified(docs, _with_sketches(pairs, classes), k, percent, f"{path}/star", repeats, files)
    if same_id is not None:
        links = stored(dealt(links.union(same_id.select(F.col("id").alias("u"), F.col("cid").alias("v")).where("u != v")).distinct(), files), f"{path}/same")
    labels = components(links, f"{path}/c1", files=files)

    comp = classes.join(labels, F.col("cid") == labels.node, "left").select("cls", F.coalesce("component", "cid").alias("comp"))
    rest = stored(dealt(members.join(comp, "cls").select("key", "cls", "size", "comp"), files), f"{path}/rest")
    mixed = stored(dealt(rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"), files), f"{path}/keys")
    if not mixed.isEmpty():
        rest = stored(dealt(split_join(rest, mixed, ["key"], ["cls"]), files), f"{path}/mixed")
        x, y = (rest.where(F.col("size") <= FEW).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "comp")]) for s in "ab")
        new = x.join(y, "key").where((F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b"))).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        large = rest.where(F.col("size") > FEW).select("cls", "comp").distinct()
        large = stored(dealt(large.join(classes.select("cls", "cid", "k1", "k2"), "cls"), files), f"{path}/large")
        if not large.isEmpty():
            new = new.union(_rare_pairs(docs, large, k, percent, f"{path}/rare", repeats, files))
        new = stored(dealt(new.distinct(), files), f"{path}/new")
        links = links.union(_verified(docs, _with_sketches(new, classes), k, percent, f"{path}/across", repeats, files))
        labels = components(links, f"{path}/c2", files=files)
    groups = stored(dealt(classes.join(labels, F.col("cid") == labels.node, "left").select("k1", "k2", F.coalesce("component", "cid").alias("component_id")), files), f"{path}/groups")
    out = split_join(linking.select("id", "n", "k1", "k2"), groups, ["k1", "k2"], ["id"]).select("id", "n", "component_id")
    alone = rows.where("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component_id"))
    out = out.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _place_counts(sets: DataFrame):
    """Broadcast counts of the shingles of ``sets`` (comp, shingles) by place, their lowest bits; 0 where one component alone has the place."""
    total = sets.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0
    size = 1 << min(PLACE_BITS, max(16, (4 * total).bit_length()))
    places = sets.select("comp", F.explode("shingles").alias("s")).groupBy((F.col("s").bitwiseAND(size - 1)).cast("int").alias("place"))
    found = places.agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    found = found.select("place", F.least("c", F.lit((1 << 32) - 1)).alias("c")).toArrow()
    counts = np.zeros(size, np.uint32)
    counts[found["place"].to_numpy()] = found["c"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(counts)


def _firsts(percent: int, counts):
    """The first shingles of each set in the order of ``counts``, as many as may hold the first that it shares with a set it links with; left: how many follow, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for b in batches:
            s, n = b.column("shingles").flatten().to_numpy(), b.column("shingles").value_lengths().to_numpy().astype(np.int64)
            c, row = held[s & (len(held) - 1)], np.repeat(np.arange(len(n)), n)
            s, c, row = (x[c > 0] for x in (s, c, row))
            order = np.lexsort((s, c, row))
            s, row = s[order], row[order]
            known = np.bincount(row, minlength=len(n))
            left = np.cumsum(known)[row] - np.arange(len(row))
            some = known - (n * percent + 99) // 100 + 1
            ok = known[row] - left < some[row]
            s, row, left = s[ok], row[ok], left[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s), b.column("cls").take(pa.array(row)), b.column("comp").take(pa.array(row)), pa.array(n[row]), pa.array(left)], ["s", "cls", "comp", "n", "left"]
            )

    return run


def _rare_pairs(docs: DataFrame, some: DataFrame, k: int, percent: int, path: str, repeats: bool, files: int | None = None) -> DataFrame:
    """Pairs (a, b) of classes of different components in ``some`` (cls, comp, cid, k1, k2) that may reach the threshold: no such pair is missing.

    Shingles are put in one order for all: those that only one component has, then by how many sets have them, as counted by
    place in a table of bounded size; shingles that share a place only come later in the order than they might.
    Sets of n and m shingles that link share percent / (100 + percent) * (n + m) of them, so their first
    common shingle stands, in both, before so many others are left; in particular within the first n - percent * n / 100 + 1.
    A document that has strayed from its group by more than that shares none of these rare ones with it
    and gives no pair, however large the group. What a shingle's largest component asks of itself is left out, and the others
    ask only for the lengths that their own place in the order allows.
    """
    ids = some.select(F.col("cid").alias("id"))
    wanted = some.select("cls", "comp", F.col("cid").alias("id"), "k1", "k2")
    sets = stored(dealt(_full_sets(docs, ids, some.count(), k, repeats).join(wanted, ["id", "k1", "k2"]).select("cls", "comp", "shingles"), files), f"{path}/sets")
    sizes = some.groupBy("comp").agg(F.count(F.lit(1)).alias("volume"))
    firsts = sets.mapInArrow(_firsts(percent, _place_counts(sets)), "s long, cls long, comp long, n long, left long")
    firsts = stored(dealt(firsts.join(sizes, "comp"), files), f"{path}/firsts")
    main = firsts.groupBy("s").agg(F.max(F.struct("volume", "comp")).alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    firsts = stored(dealt(split_join(firsts, main.select("s", F.col("main.comp").alias("main")), ["s"], ["cls"]), files), f"{path}/shared")
    length = lambda x: F.floor(F.log(x.cast("double")) * LENGTHS).cast("int")
    low = F.floor((F.col("n") * percent + 99) / 100)
    high = F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("left") * (100 + percent) / percent) - F.col("n"))
    asked = firsts.where((F.col("comp") != F.col("main")) & (low <= high))
    asked = asked.withColumn("length", F.explode(F.sequence(length(F.greatest(low, F.lit(1))), length(F.greatest(high, F.lit(1))))))
    given = firsts.withColumn("length", length(F.col("n")))
    x, y = (t.select("s", "length", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "comp", "n", "left")]) for t, side in ((asked, "a"), (given, "b")))
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    enough = F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    found = x.join(y, ["s", "length"]).where((F.col("comp_a") != F.col("comp_b")) & near & enough)
    return found.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes with what ``_likely`` looks at; ``pairs`` is a written table."""
    side = lambda s: classes.select(F.col("cls").alias(f"c{s}"), F.col("cid").alias(s), F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    pairs = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    # a hub has a pair with every class of its bucket
    return split_join(split_join(pairs, side("a"), ["ca"], ["cb"]), side("b"), ["cb"], ["ca"], counted=pairs).select(*_PAIR, "n_a", "n_b", "regs_a", "regs_b")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, path: str, repeats: bool, files: int | None = None) -> DataFrame:
    """Links (u, v) between nodes among candidate pairs with sketches: estimate first, then count on full sets."""
    likely = stored(dealt(pairs.mapInArrow(_likely(percent / 100), "a long, b long, a1 long, a2 long, b1 long, b2 long"), files), f"{path}/likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("id"))
    sets = stored(dealt(_full_sets(docs, ids, 2 * likely.count(), k, repeats), files), f"{path}/sets")
    side = lambda s: sets.select(F.col("id").alias(s), F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("shingles").alias(f"s{s}"))
    full = split_join(split_join(likely, side("a"), ["a", "a1", "a2"], ["b1"]), side("b"), ["b", "b1", "b2"], ["a1"], counted=likely)
    common = F.size(F.array_intersect("sa", "sb"))
    full = full.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
    return stored(dealt(full.where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("t") - F.col("c"))).select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), files), f"{path}/links")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is kept by near_duplicates().

    Rows of one id stay or go together; rows of a null id and texts without words stay; an empty table gives no rows.
    """
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
