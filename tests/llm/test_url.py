"""The URL filter against plain Python, and its SQL."""

import duckdb
import pytest

from corvane.llm import urlfilter
from corvane.llm.queries import ORACLES, QUERIES

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x", "https://a.example.net/EN/", "https://example.net", "https://Example.Net/en/?q#f", "https://notexample.net/en/", "ftp://x.org/fr/", "http://x.org/fr", "http://de.example.com/de/a", "http://example.com/fr/",
    "http://example.com?x=/de/", "x://y://z/de/", "http://ads-track.example.com/", "http://www.ads-track.example.com/page.html", "http://ads-track.example.com:8080/", "http://ads-track.example.com.evil/", "http://mads-track.example.com/", "http://deep.a.b.c.d.e.casino-win.example.org/x", "http://spam-farm.example.net/en/", "http://user@host/ü",
]


def plain(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(x) for x in "/?#" if x in rest] or [len(rest)])
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(x) for x in "?#" if x in tail] or [len(tail)])]
    best = None
    for kind, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    name = host.rsplit(":", 1)[0] if ":" in host else host
    listed = any(name + "/" == x or (name + "/").endswith("." + x) for x in urlfilter.LISTED) if host else False
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(URLS * 2)], "page_id long, url string, entry int, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, urlfilter.listed_urls(spark)).collect()}
    assert got == {k: plain(u) for k, u in enumerate(URLS * 2)}
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.listed_urls(spark)).count() == 0


def test_lists(spark):
    entries = [None, "pages.example.com/one/two", "pages.example.com/one/two", *[f"site{k}.test/" for k in range(3000)]]
    listed = spark.createDataFrame([(x,) for x in entries], "entry string")
    pages = spark.createDataFrame([(1, "http://www.pages.example.com/one/two.html?x"), (2, "http://pages.example.com/one"), (3, "http://a.site77.test/q"), (4, "http://site3001.test/"), (5, "http://site2999.test")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["listed_as"]) for r in urlfilter.filter_urls(pages, listed, rules=()).collect()}
    assert got == {1: ("block", "pages.example.com/one/two"), 2: ("allow", None), 3: ("block", "site77.test/"), 4: ("allow", None), 5: ("block", "site2999.test/")}
    assert all(r["verdict"] == "allow" for r in urlfilter.filter_urls(pages, listed.where("false"), rules=()).collect())


def test_listed_sites_of_any_number_of_names(spark):
    deep = "a.b.c.d.e.f.g.h.example.org"
    pages = spark.createDataFrame(list(enumerate([f"http://x.y.{deep}/p", f"http://{deep}", "http://b.c.d.e.f.g.h.example.org/", "http://one.two.internal:80/q", "http://internal/", "http://notinternal/"])), "page_id int, url string")
    for entries, want in (([f"{deep}/", "internal/"], {0: f"{deep}/", 1: f"{deep}/", 2: None, 3: "internal/", 4: "internal/", 5: None}), (["internal/"], {3: "internal/", 4: "internal/"}), ([f"{deep}/"], {0: f"{deep}/", 1: f"{deep}/"})):
        listed = spark.createDataFrame([(x,) for x in entries], "entry string")
        got = {r["page_id"]: (r["verdict"], r["listed_as"]) for r in urlfilter.filter_urls(pages, listed, rules=()).collect()}
        assert got == {k: ("block" if want.get(k) else "allow", want.get(k)) for k in range(6)}


def test_filter_has_no_false_negative(spark):
    entries = spark.createDataFrame([(f"h{k}.test/",) for k in range(2000)], "entry string")
    blocks = 256
    held = urlfilter.bloom(entries, blocks)
    probe = entries.withColumn("block", urlfilter._block(entries["entry"], blocks)).join(held, "block")
    for k in range(urlfilter.LANES):
        bits = urlfilter._bits(entries["entry"], k)
        probe = probe.where(probe[f"w{k}"].bitwiseAND(bits) == bits)
    assert probe.count() == 2000
    assert held.count() <= blocks


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, f"/root/testdata/{sf}")
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(map(str, df.select(*columns).collect())) == sorted(map(str, [spark_row(columns, r) for r in want.fetchall()]))


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(*columns)(*values)
