"""Tokenizers, filters, the query language and BM25 against plain Python."""

import math

import pytest

from corvane.errors import InvalidArgument, NotSupported
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.functions.stem import stem
from corvane.functions.text import analyze, analyze_query, fold
from corvane.operators import fulltext
from corvane.plans import textquery as Q


def one(spark, text, *args, **options):
    return analyze_query(spark, [text], *args, **options)[0]


def test_tokenizers(spark):
    assert one(spark, "Hello, World's U.S.A. 3.14 x_y — 日本 a-b") == ["hello", "world's", "u.s.a", "3.14", "x_y", "日", "本", "a", "b"]
    assert one(spark, "x" * 600) == ["x" * 255, "x" * 255, "x" * 90]
    assert one(spark, " A\tb\n\x0bc ", "whitespace") == ["a", "b", "c"]
    assert one(spark, "abc d1", "ngram") == ["ab", "bc", "d1"]
    assert one(spark, "abc", "ngram", (), min_gram=1, max_gram=2) == ["a", "ab", "b", "bc", "c"]
    assert one(spark, "...") == [] and one(spark, "") == []
    with pytest.raises(InvalidArgument):
        one(spark, "a", "ngram", min_gram=1, max_gram=3)
    with pytest.raises(NotSupported):
        one(spark, "a", "jieba")
    with pytest.raises(InvalidArgument):
        one(spark, "a", "standard", ("what",))


def test_filters(spark):
    assert one(spark, "Straße CAFÉ Łódź", "standard", ("lowercase", "ascii_folding")) == ["strasse", "cafe", "lodz"]
    assert one(spark, "Running ponies relational", "standard", ("lowercase", "stemmer")) == ["run", "poni", "relat"]
    assert one(spark, "RÉSUMÉS", "standard", ("ascii_folding", "lowercase", "stemmer")) == ["resum"]
    df = spark.createDataFrame([("Hopping Ä",), (None,)], "t string").select(analyze(df_col("t"), "standard", ("lowercase", "ascii_folding", "stemmer")).alias("x"))
    assert [r[0] for r in df.collect()] == [["hop", "a"], None]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("agreed", "agre"), ("plastered", "plaster"), ("hoping", "hope"), ("happy", "happi"), ("by", "by"), ("national", "nation"), ("sensitivity", "sensit"), ("generous", "generous"), ("skies", "sky"), ("news", "news"), ("adoption", "adopt"), ("controll", "control")])
def test_stems(word, want):
    assert stem(word) == want


def test_folding():
    assert fold("Ångström œuvre Þór") == "Angstrom oeuvre THor"


def words(text):
    return text.lower().split()


def tree(text, operator="or"):
    return Q.simplify(Q.build(Q.parse(text, operator), words))


def test_query_language():
    assert tree("a") == Q.Terms(("a",))
    assert tree("a a b") == Q.Bool(should=[Q.Terms(("a",), 2), Q.Terms(("b",))])
    assert tree('"a b"') == Q.Terms(("a", "b"))
    assert tree("a AND b OR c").should == [Q.Bool(must=[Q.Terms(("a",)), Q.Terms(("b",))]), Q.Terms(("c",))]
    assert tree("a b", "and") == Q.Bool(must=[Q.Terms(("a",)), Q.Terms(("b",))])
    assert tree("+a b -c") == Q.Bool(must=[Q.Terms(("a",))], should=[Q.Terms(("b",))], must_not=[Q.Terms(("c",))])
    assert tree("a NOT b") == Q.Bool(must=[Q.Terms(("a",))], must_not=[Q.Terms(("b",))])
    assert tree("+a -a") is Q.EMPTY
    assert tree(r"a\:b") == Q.Terms(("a:b",))
    for bad in ("", "a:b c", "x^2", "(a", "a )", '"a', "AND a", "-a"):
        with pytest.raises((InvalidArgument, NotSupported)):
            Q.parse(bad)


DOCS = ["the quick brown fox", "the lazy dog and the fox", "quick quick dog", "fox the", None, "", "brown dog the quick brown fox jumps"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, text string").cache()


def bm25(match, terms):
    held = [(i, d.split()) for i, d in enumerate(DOCS) if d is not None]
    mean = sum(len(w) for _, w in held) / len(held)
    out = []
    for i, w in held:
        score = 0.0
        for t, boost in terms.items():
            df, tf = sum(t in x for _, x in held), w.count(t)
            score += boost * math.log((len(held) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
        if match(w) and score > 0:
            out.append((i, round(score, 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def side(w, *p):
    return any(tuple(w[k : k + len(p)]) == p for k in range(len(w)))


@pytest.mark.parametrize(
    "query, match, terms",
    [
        ("fox dog", lambda w: "fox" in w or "dog" in w, {"fox": 1, "dog": 1}),
        ("fox AND dog", lambda w: "fox" in w and "dog" in w, {"fox": 1, "dog": 1}),
        ("quick quick dog", lambda w: "quick" in w or "dog" in w, {"quick": 2, "dog": 1}),
        ('"brown fox"', lambda w: side(w, "brown", "fox"), {"brown": 1, "fox": 1}),
        ('"the fox" OR lazy', lambda w: "lazy" in w, {"the": 1, "fox": 1, "lazy": 1}),
        ("fox NOT dog", lambda w: "fox" in w and "dog" not in w, {"fox": 1}),
        ('dog -"brown fox"', lambda w: "dog" in w and not side(w, "brown", "fox"), {"dog": 1}),
        ("+dog quick", lambda w: "dog" in w, {"dog": 1, "quick": 1}),
    ],
)
def test_bm25(spark, docs, query, match, terms):
    got = fulltext.search(docs, "text", fulltext.query_tree(spark, query_string=query), 10, "id").select("id", "_score").collect()
    assert [(r[0], round(r[1], 9)) for r in got] == bm25(match, terms)


def test_statistics_cover_rows_that_the_filter_drops(spark, docs):
    t = fulltext.query_tree(spark, match_string="fox")
    wide = {r["id"]: r["_score"] for r in fulltext.search(docs, "text", t, 10, "id").collect()}
    some = fulltext.search(docs, "text", t, 10, "id", where=docs["id"] > 0).collect()
    assert {r["id"]: r["_score"] for r in some} == {k: v for k, v in wide.items() if k > 0}


def test_no_tokens_and_one_string(spark, docs):
    assert fulltext.search(docs, "text", fulltext.query_tree(spark, match_string="..."), 10, "id").count() == 0
    for bad in ({}, {"query_string": "a", "match_string": "b"}):
        with pytest.raises(InvalidArgument):
            fulltext.query_tree(spark, **bad)


def test_one_look_at_the_tokens(spark, docs):
    plan = fulltext.search(docs, "text", fulltext.query_tree(spark, query_string='"the quick brown" fox'), 3, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 12  # twice (statistics and rows), each in a few branches of one expression


def test_runs_give_the_words_of_the_rule(spark):
    """The pattern that steps over runs cuts as the one that is written after Unicode's rules."""
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("abcß9٣_.:,;'’ -\n漢かé\U0001d400\u0301") for _ in range(draw.randrange(60))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    careful = F.transform(text._standard(F.col("t")), F.lower)
    both = rows.select(F.regexp_extract_all("t", F.lit(text.STANDARD), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(text._RUNS), F.lit(0)).alias("b"), careful.alias("c"), text.analyze(F.col("t")).alias("d"))
    assert both.where("a != b or c != d").count() == 0 and both.where("size(a) > 5").count() > 100


def test_postings_are_grouped_where_the_texts_lie(spark):
    """One exchange deals the texts; words do not move, and every document has one row of its length."""
    from corvane.operators import postings

    rows = spark.createDataFrame([(f"k{i}", i, 1, None if i == 5 else "b a b " * (i % 3) + f"w{i % 4}") for i in range(40)], "_id string, _doc_id long, _seq long, text string")
    made = postings.build(rows, "text", text.analyze, 40, 3)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1 and "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["term"], r["_doc_id"]): (r["_id"], r["n"], r["tf"], r["at"]) for r in made.collect()}
    want = {}
    for i in range(40):
        words = [] if i == 5 else ("b a b " * (i % 3) + f"w{i % 4}").split()
        want |= {(None, i): (f"k{i}", len(words), len(words), [])} if i != 5 else {}
        want |= {(w, i): (f"k{i}", len(words), words.count(w), [k for k, x in enumerate(words) if x == w]) for w in words}
    assert got == want and made.count() == len(want)
