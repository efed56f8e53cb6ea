"""Quality rules against plain Python; the ratio against a recount."""

import math

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import quality_rules as q

from .common import labels, odd, words


def base(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(covered), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_documents_table(spark, sf_dir):
    docs, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r["doc_id"]: r for r in q.quality_rules(docs, lab).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS) == base(r["text"]), r["doc_id"]
        assert not (got[r["doc_id"]]["kept"] and got[r["doc_id"]]["base_failed"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t", max_size=120), min_size=1, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in q.quality_rules(df, labels(spark)).collect()}
    assert [tuple(got[i][c] for c in COLUMNS) for i in range(len(texts))] == [base(t) for t in texts]


def xx(*values, seed=42):
    """Spark's xxhash64 of strings and longs, one after the other; nulls change nothing."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def grams(text, buckets):
    h = [xx(w) for w in words(text)]
    return [x % buckets for x in h] + [xx(x, h[i - 1] if i else None) % buckets for i, x in enumerate(h)]


def recount(texts, good, buckets):
    raw, kept = [1.0] * buckets, [1.0] * buckets
    for k, t in texts:
        for b in grams(t, buckets):
            raw[b] += 1
            kept[b] += k in good
    return [math.log(g / sum(kept)) - math.log(r / sum(raw)) for g, r in zip(kept, raw, strict=True)]


def test_ratio_is_a_recount(spark):
    rows = [(1, "good words here good words"), (2, "bad words there"), (3, "Good THINGS"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    got, want = q.bucket_ratios(docs, lab, 64), recount(rows, {1, 3}, 64)
    assert all(abs(a - b) < 1e-8 for a, b in zip(got, want, strict=True))


def test_scores_and_verdicts_by_brute_force(spark, sf_dir):
    docs, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ratios = recount(texts, {r["doc_id"] for r in lab.collect() if r["quality"] == 1}, q.BUCKETS)
    got = {r["doc_id"]: r for r in q.quality_rules(docs, lab).collect()}
    assert {r["kept"] for r in got.values()} == {True, False}
    for d, t in texts:
        g = grams(t, q.BUCKETS)
        score = sum(ratios[b] for b in g) / (len(g) + q.PRIOR)
        assert abs(got[d]["score"] - score) < 1e-6
        if abs(score - q.THRESHOLD) > 1e-6:
            assert got[d]["kept"] == (not base(t)[-1] and score >= q.THRESHOLD)


def test_odd_rows(spark):
    for lab in (labels(spark), labels(spark, empty=True)):
        got = q.quality_rules(odd(spark), lab).collect()
        assert len(got) == 11
        by = {r["doc_id"]: r for r in got}
        assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"] and by[2]["score"] == 0.0
        assert by[6]["n_words"] == 100_000 and by[6]["n_repeat_words"] == 100_000 and by[7]["word_chars"] == 300_000
    assert q.quality_rules(odd(spark).where("false"), labels(spark)).count() == 0


def test_native(spark, sf_dir):
    df = q.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
