"""The pipeline stage by stage: each one's input and output are whole tables whose decisions fit the operators'."""

import random
import tracemalloc
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import decontaminate, minhash, mixing, tokens, toxicity
from corvane.llm.common import shared_dir, split_join, stored
from corvane.llm.queries import tokenizer_path
from corvane.llm.tokens import token_output
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    path, steps = shared_dir(spark), {}
    columns = docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{number}")
        steps[name] = (before, docs)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = steps["toxicity"]
    bad = {r["doc_id"] for r in toxicity.toxicity(before, labels).collect() if r["predicted"]}
    assert bad and ids(after) == [d for d in ids(before) if d not in bad]
    before, after = steps["minhash_near_dedup"]
    assert ids(after) == sorted(r["doc_id"] for r in minhash.near_duplicates(before, 5, 80).collect() if r["kept"]) and after.count() < before.count()
    before, after = steps["benchmark_decontamination"]
    bad = {r["doc_id"] for r in decontaminate.leaks(before, bench).collect()}
    assert bad and ids(after) == [d for d in ids(before) if d not in bad]
    before, after = steps["mixing"]
    assert ids(after) == sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["copies"]))
    sized = lambda df: sorted(map(tuple, df.select("doc_id", "source", "n_chars").collect()))
    assert set(sized(after)) <= set(sized(before))
    before, after = steps["token_output"]
    assert sorted(map(tuple, after.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, token_output(before, tokenizer_path()).select("doc_id", "n_tokens").collect()))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


ODD_TYPES = "doc_id long, text string, lang string, source string, n_chars long, id int, score double, _file string"
TOKENS = ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, sf_dir, number):
    from .common import ODD

    docs = spark.createDataFrame([(*r, None, 1, 0.5, "f") for r in ODD], ODD_TYPES)
    for df in (docs, docs.where("false")):
        out = corpus_pipeline.STAGES[number][1](spark, df, sf_dir)
        assert out.columns == (docs.columns if number < 4 else TOKENS) and out.count() <= 3 * df.count()


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, sf_dir):
    """Toxicity, decontamination and mixing: null and repeated ids, with texts that go and texts that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    mean, calm = next(text[d] for d, p in judged.items() if p), next(text[d] for d, p in judged.items() if not p and len(text[d]) > 99)
    other = docs.where("false").select("doc_id", "text").union(spark.createDataFrame([(i, t) for i in (None, -5) for t in (mean, calm, mean, calm)], "doc_id long, text string"))
    more = docs.unionByName(other, allowMissingColumns=True)
    kept = [(r["doc_id"], r["text"]) for r in toxicity.drop_toxic(more, labels).collect() if r["doc_id"] in (None, -5)]
    assert sorted(map(str, kept)) == sorted(map(str, [(i, calm) for i in (None, -5) for _ in range(2)]))
    item = bench.orderBy("item_id").first()["text"]
    other = spark.createDataFrame([(i, t) for i in (None, -5) for t in (item, calm)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.drop_leaks(docs.unionByName(other, allowMissingColumns=True), bench).collect() if r["doc_id"] in (None, -5)]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, calm), (-5, calm)]))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == TOKENS and out.count() == 0


def test_near_dedup_joins_prefixes_alone(spark, sf_dir, monkeypatch):
    """Joins by shingle take a fifth of a set, not whole sets of 56 five-word shingles, from each near copy."""
    from corvane.llm import stages

    rng, base, rows = random.Random(5), [f"v{k}" for k in range(60)], []
    for i in range(50):
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(60)] = f"x{i}y{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    join, left_rows = minhash.split_join, []

    def split_join(left, right, keys, *args, **options):
        if keys == ["s"]:
            left_rows.append(left.count())
        return join(left, right, keys, *args, **options)

    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "split_join", split_join)
    kept = stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).count()
    assert 1 < kept < 50
    assert 0 < sum(left_rows) <= 50 * 13


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_workers_hold_little(monkeypatch, tmp_path):
    """MB beyond their input that fit, search and token writer of the stages take in a worker, which counts beside its executor."""
    rng, held = random.Random(3), lambda x: SimpleNamespace(value=x)
    known = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(known, k=n))
    labels = [int(i % 6 == 0) for i in range(300)]
    texts = [text(600) + " qworble" * y for y in labels]
    assert _peak(lambda: toxicity.fit(texts, labels)) < 30  # texts of 1.2 MB
    space = decontaminate.Space(np.random.default_rng(4).normal(size=(decontaminate.BUCKETS, decontaminate.LATENT)), np.ones(decontaminate.BUCKETS))
    items = decontaminate.Items(list(range(50)), [text(40) for _ in range(50)], space)
    batch = pa.record_batch({"doc_id": list(range(600)), "text": [text(1000) for _ in range(600)]})  # 4 MB
    assert _peak(lambda: [None for _ in decontaminate._clean(held(items), held(space))(iter([batch]))]) < 40
    monkeypatch.setattr(tokens, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    write, first = tokens._writer(tokenizer_path(), 2, f"file://{tmp_path}"), pa.record_batch({"id": [0], "text": [" ".join(known)]})
    assert _peak(lambda: list(write(iter([first, batch])))) < 35


def test_small_tables_start_no_workers_of_their_own(spark, monkeypatch):
    """Tables of the driver reach Spark without Python rows, for which each executor would start a second set of workers that stays."""
    rows = spark.createDataFrame([(i, None if i % 2 else f"t {i}") for i in range(20)], "doc_id long, text string")
    many = stored(spark.range(20_000).selectExpr("if(id < 9000, 7, id) as k", "id as v"), f"{shared_dir(spark)}/many")
    right = many.where("k = v").select("k", F.col("v").alias("w"))
    made, parallelize = [], type(spark.sparkContext).parallelize
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda self, c, *a: made.append(c) or parallelize(self, c, *a))
    assert token_output(rows, tokenizer_path()).count() == 20
    assert token_output(rows.where("false"), tokenizer_path()).columns == TOKENS
    joined = split_join(many, right, ["k"], ["v"])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, many.join(right, ["k"]).collect()))
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString() and not made
