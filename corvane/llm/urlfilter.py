"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list entry is a canonical URL: ``host/path`` without scheme, ``www.``-like
prefixes, query, fragment, ``.html`` and last slash. An entry whose path is empty stands for its
whole host and all subdomains; any other for that page alone. A page is probed
with its own canonical URL and with its host's suffixes; possible hits alone go on to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_dir, stored

#: Words of a block (64 bits each, one bit set in every word), and most blocks: 2**17 * 40 bytes is 5 MB.
LANES, MOST_BLOCKS = 4, 1 << 17
#: Entries that a block serves; beyond MOST_BLOCKS times so many, more pages pass and the join removes them.
PER_BLOCK = 8

#: (kind, host, path): block and allow rules by host and path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The listed canonical URLs of the query: sites of advertising, betting, spam and the like.
LISTED = tuple(f"{site}.example.{top}/" for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: both empty if it is null or has no ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and kind of the longest rule that fits, else null. Rules are a short list: they become expressions."""
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, kind = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, k).otherwise(kind)
    return name, kind


def canonical(host: Column, path: Column) -> Column:
    """``host/path`` of a page without its www-like prefix, port, .html and last slashes."""
    site = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(?:www|m|mobile)\.", "")
    return F.concat(site, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"(?:/|\.html?)*$", ""))


def _site_keys(host: Column, least: int, most: int) -> Column:
    """``suffix/`` of a host's last names, ``least`` to ``most`` of them; the numbers of names that the list's sites have."""
    names = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    count = F.least(F.size(names), F.lit(most))
    keys = F.transform(F.sequence(F.lit(least), F.greatest(count, F.lit(least))), lambda k: F.concat(F.array_join(F.slice(names, -k, k), "."), F.lit("/")))
    return F.when(count >= least, keys).otherwise(F.array())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _bits(key: Column, lane: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.call_function("shiftright", F.xxhash64(key, F.lit(2)), F.lit(8 * lane)), F.lit(64)).cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the words of every block that has an entry; at most ``blocks`` rows."""
    rows = listed.select(_block(F.col("entry"), blocks).alias("block"), *[_bits(F.col("entry"), k).alias(f"b{k}") for k in range(LANES)])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(LANES)])


def listed_urls(spark: SparkSession, entries=LISTED) -> DataFrame:
    """(entry) from a literal list; a list of any size may come as such a table instead."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in entries])).alias("entry"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_as) for every row of ``pages``.

    verdict is that of the longest rule that fits; without a rule it is block if the page's canonical URL
    or its site is listed (``listed_as``, the longest such entry), else allow. A null url or one without ``://`` has an empty
    host and path, fits no rule and is allowed. Rows that repeat are judged one by one, repeated
    and null entries count once and not at all, empty tables give no rows or no hits, other columns are not read.

    The filter is broadcast: it has MOST_BLOCKS rows of five longs at most, whatever the
    list's length. The list itself is never broadcast by hand: the exact join shuffles the few
    keys that pass the filter.
    """
    spark = pages.sparkSession
    path_of = shared_dir(spark)
    listed = stored(listed.select(F.col("entry").cast("string").alias("entry")).where("entry is not null").distinct(), f"{path_of}/listed")
    site = F.when(F.locate("/", "entry") == F.length("entry"), F.size(F.split("entry", r"\.")))
    least, most = listed.agg(F.min(site), F.max(site)).first()
    blocks = min(MOST_BLOCKS, max(64, 1 << (listed.count() // PER_BLOCK).bit_length()))
    blooms = stored(bloom(listed, blocks), f"{path_of}/bloom")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(url_col).cast("string").alias("_url"))
    name, kind = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("kind", kind)
    open_urls = rows.where("kind is null and host != ''").select("_url", "host", "path")
    keys = open_urls.select("_url", F.explode(F.array_distinct(F.concat(F.array(canonical(F.col("host"), F.col("path"))), _site_keys(F.col("host"), least or 1, most or 0)))).alias("key"))
    probe = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(blooms), "block")
    for k in range(LANES):
        bits = _bits(F.col("key"), k)
        probe = probe.where(F.col(f"w{k}").bitwiseAND(bits) == bits)
    hits = probe.select("_url", "key").distinct().join(listed, F.col("key") == F.col("entry"), "left_semi")
    hits = hits.groupBy("_url").agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("listed_as"))
    out = rows.join(hits, "_url", "left")
    hit = F.when(F.col("kind").isNull(), F.col("listed_as"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("kind", F.when(hit.isNotNull(), "block").otherwise("allow")).alias("verdict"), hit.alias("listed_as"))


def oracle(entries=LISTED) -> str:
    """DuckDB SQL of the query over pages."""
    listed = ", ".join(f"('{x}')" for x in entries)
    return rf"""WITH listed(entry) AS (VALUES {listed}),
u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
s AS (SELECT *, (SELECT max(entry) FROM listed WHERE regexp_replace(host, ':[0-9]*$', '') || '/' = entry OR suffix(regexp_replace(host, ':[0-9]*$', '') || '/', '.' || entry)) AS hit FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS listed_as
FROM s"""
