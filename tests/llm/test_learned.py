"""The trained operators: accuracy on held-out documents, what they never read, gradients, and odd rows."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, quality_cnn, toxicity
from corvane.llm.common import shared_dir

from .common import labels, lowered, odd

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").cache()
    return read("documents"), read("labels"), read("benchmark")


@pytest.fixture(scope="module")
def labelled(spark):
    """The labelled documents of a larger table; a few of its labels are noise, which no model can learn."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(lab.select("doc_id"), "doc_id", "left_semi").cache(), lab.cache()


def judged(out, lab, column):
    truth = {r["doc_id"]: r[column] for r in lab.collect()}
    rows = [(r["predicted"], r["score"], truth[r["doc_id"]]) for r in out.collect() if r["held_out"] and r["doc_id"] in truth]
    return np.array(rows)


@pytest.mark.parametrize("call, column, fold", [(quality_cnn.quality, "quality", (5, 0)), (toxicity.toxicity, "toxic", (4, 2))])
def test_held_out(labelled, call, column, fold):
    docs, lab = labelled
    out = call(docs, lab).cache()
    rows = judged(out, lab, column)
    right = [(rows[rows[:, 2] == y, 0] == y).mean() for y in (0, 1)]
    print(column, "class 0 and class 1 right:", right)
    assert min(right) >= 0.75 and sum(right) / 2 >= 0.85, right
    for r in out.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert out.count() == docs.count()


@pytest.mark.parametrize("call, column, fold", [(quality_cnn.quality, "quality", (5, 0)), (toxicity.toxicity, "toxic", (4, 2))])
def test_held_out_labels_are_never_read(tables, call, column, fold):
    docs, lab, _ = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1]
    some = docs.orderBy("doc_id").limit(150)
    turned = lab.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    shown = lambda x: sorted((r["doc_id"], r["score"]) for r in call(some, x).collect())
    assert shown(lab) == shown(turned)


@pytest.mark.parametrize("call", [quality_cnn.quality, toxicity.toxicity])
def test_odd_rows(spark, call):
    for lab in (labels(spark), labels(spark, empty=True)):
        out = call(odd(spark), lab).collect()
        assert len(out) == 11 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)
        assert not [r for r in out if r["doc_id"] is None and r["held_out"]]
    assert call(odd(spark).where("false"), labels(spark)).count() == 0


def test_gapped_insults():
    rng = np.random.default_rng(0)
    calm = [f"w{''.join(rng.choice(list('aeioulnrst'), 6))}" for _ in range(400)]
    texts = [" ".join([*rng.choice(calm, 30), "and you"]) for _ in range(120)]
    bad = [t + f" you {('grobnik', 'zaffler')[k % 2]} and. " + " ".join(rng.choice(calm, 5)) for k, t in enumerate(texts[:60])]
    machine = toxicity.fit(texts[60:] + bad, [0] * 60 + [1] * 60)
    reader = toxicity.Reader(machine)
    score = lambda t: reader.scores([t])[0]
    for word in ("grobnik", "GROBNIK!", "gr0bnik", "grobbnik", "gr.ob.nik", "g r o b n i k", "grxobnik", "zafffler"):
        assert score(f"{texts[0]} {word}") >= 0.3, word
    assert all(score(t) < 0.3 for t in texts[:60])
    assert toxicity.fit(["a"], [0]) is None and toxicity.fit([], []) is None


def test_every_letter_of_a_long_word_is_read():
    rng = np.random.default_rng(0)
    calm = [f"w{''.join(rng.choice(list('aeioulnrst'), 6))}" for _ in range(400)]
    texts = [" ".join([*rng.choice(calm, 30), "and you"]) for _ in range(120)]
    bad = [t + f" you {('grobnik', 'zaffler')[k % 2]} and" for k, t in enumerate(texts[:60])]
    machine = toxicity.fit(texts[60:] + bad, [0] * 60 + [1] * 60)
    reader = toxicity.Reader(machine)
    score = lambda t: reader.scores([t])[0]
    long = "".join(calm[:40])
    for word in (f"{long}grobnik", f"{long}grobnik{long}", f"{long}zafffler", "#" + "_".join([*calm[:5], "grobnik"]), "-".join([*calm[:5], "gr0bnik", calm[6]]), " ".join(calm[0] + calm[1] + calm[2] + "grobnik")):
        assert score(f"{texts[0]} {word}") >= 0.3, word
    for word in (long, "-".join(calm[:5]), " ".join(calm[0] + calm[1] + calm[2])):
        assert score(f"{texts[0]} {word}") < 0.3, word
    # windows leave no letter out, and none is longer than the kernel's words
    for n in (21, 22, 27, 40, 61):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        seen = list(toxicity.pieces(word))
        assert set("".join(seen)) == set(word) and max(map(len, seen)) <= toxicity.LENGTH


def test_string_kernel_is_the_sum_over_gapped_triples():
    def features(w):
        w, out = "^" + w + "$", {}
        for a in range(1, 5):
            for b in range(1, 5):
                if a + b <= toxicity.SPAN:
                    for i in range(len(w) - a - b):
                        k = (w[i].replace("$", "^"), w[i + a], w[i + a + b].replace("$", "^"))
                        out[k] = out.get(k, 0) + toxicity.DECAY ** (a + b - 2)
        return out

    def kernel(x, y):
        fx, fy = features(x), features(y)
        return sum(v * fy.get(k, 0) for k, v in fx.items())

    machine = toxicity.Machine(["planet", "garden"])
    index, weight = toxicity._features(["plainet"])
    got = machine._raw(index, weight)[0]
    unique = lambda w: np.sqrt(sum(toxicity.DECAY ** (2 * (a + b - 2)) * max(len(w) + 2 - a - b, 0) for a, b in toxicity._STEPS))
    assert got == pytest.approx([kernel("plainet", w) / unique("plainet") / unique(w) for w in ("planet", "garden")], rel=1e-4)


def triples(w):
    """The kernel's features from scratch: gapped triples of a word with marks at both ends, of length 1."""
    w, out = [1, *(ord(x) - 95 if "a" <= x <= "z" else 28 + ord(x) % 36 for x in w), 1], {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, len(w)):
                if k - i <= toxicity.SPAN:
                    key = (w[i], w[j], w[k])
                    out.setdefault(key, []).append(toxicity.DECAY ** (k - i - 2))
    norm = sum(v * v for x in out.values() for v in x) ** 0.5
    return {k: sum(v) / norm for k, v in out.items()}


def by_hand(machine, text, screen):
    """The score of a document from the definitions: sentences, words, triples, kernel values, one linear form."""
    best, own = machine.bias, [triples(x) for x in machine.landmarks]
    for sentence in toxicity.windows(toxicity.spaced(text)):
        top = np.zeros(len(own))
        for word in sentence:
            alone = np.zeros(len(own))
            for x in toxicity.pieces(word):
                if x:
                    t = triples(x)
                    k = np.array([sum(v * o.get(f, 0) for f, v in t.items()) for o in own])
                    if k.max() >= screen:
                        top = np.maximum(top, k**toxicity.POWER)
                        alone = np.maximum(alone, k**toxicity.POWER)
            best = max(best, float(alone @ machine.alpha) + machine.bias)
        best = max(best, float(top @ machine.alpha) + machine.bias)
    return float(machine.probability(best))


def test_scores_by_brute_force(tables, monkeypatch):
    """Scores are those of the definitions; the screen changes no verdict of these documents."""
    docs, lab, _ = tables
    rows = docs.join(lab, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    machine = toxicity.fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    texts = [r["text"] for r in rows if len(r["text"]) < 700][:25] + ["", None, "id.iot! xx", "s c u m"]
    got = toxicity.Reader(machine).scores(texts)
    assert got == pytest.approx([by_hand(machine, t, toxicity.SCREEN) for t in texts], abs=1e-3)
    texts = [r["text"] for r in rows]
    with_screen = toxicity.Reader(machine).scores(texts) >= 0.3
    monkeypatch.setattr(toxicity, "SCREEN", 0.0)
    without = toxicity.Reader(machine).scores(texts) >= 0.3
    print("verdicts that the screen changes:", int((with_screen != without).sum()), "of", len(texts))
    assert (with_screen == without).mean() >= 0.99


def test_an_insult_of_two_harmless_words():
    rng = np.random.default_rng(0)
    calm = [f"w{''.join(rng.choice(list('aeioulnrst'), 6))}" for _ in range(400)]
    say = lambda *w: " ".join(rng.permutation([*rng.choice(calm, 20)])[:12].tolist() + list(w) + rng.choice(calm, 3).tolist()) + ". " + " ".join(rng.choice(calm, 14)) + "."
    clean = [say(*(("purple",), ("monkey",), ())[k % 3]) for k in range(300)]
    bad = [say("purple", "monkey") for _ in range(120)]
    machine = toxicity.fit(clean[:240] + bad[:90], [0] * 240 + [1] * 90)
    reader = toxicity.Reader(machine)
    assert (reader.scores(bad[90:]) >= 0.3).mean() >= 0.9
    assert (reader.scores(clean[240:]) < 0.3).mean() >= 0.9
    apart = "We saw a purple one. " + clean[2] + " Then came the monkey."
    assert reader.scores([apart])[0] < 0.3


def test_a_document_labelled_both_ways_is_not_learnt_from(spark, tables):
    docs, lab, _ = tables
    both = lab.union(lab.where("toxic = 1").withColumn("toxic", F.lit(0)))
    picked = toxicity.fit_labelled(docs, both, "toxic", (4, 2), 50, _labels_of)
    assert set(picked) == {0}


def _labels_of(texts, labels):
    return labels


def test_gradients():
    net = quality_cnn.Network(1)
    net.p["out"] = np.random.default_rng(2).normal(size=quality_cnn.FILTERS).astype(np.float32)
    data, offsets = quality_cnn._packed(["some text that is long enough " * 40, "short", "", "another one " * 9])
    y, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        z = net.logits(data, offsets)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    g = net.gradients(data, offsets, y, weight)
    rng = np.random.default_rng(3)
    for k in ("out", "last", "filter", "bias"):
        direction = rng.normal(size=net.p[k].shape).astype(np.float32)
        keep = net.p[k].copy()
        step = 1e-3
        net.p[k] = keep + step * direction
        up = loss()
        net.p[k] = keep - step * direction
        down = loss()
        net.p[k] = keep
        assert (up - down) / (2 * step) == pytest.approx(float((g[k] * direction).sum()), abs=3e-2, rel=0.1)


def test_forward_pass_by_brute_force():
    """Every filter at every place of every chunk, one after the other."""
    net = quality_cnn.Network(3)
    rng = np.random.default_rng(4)
    net.p["out"], net.p["bias"] = (rng.normal(size=quality_cnn.FILTERS).astype(np.float32) for _ in range(2))
    texts = ["", None, "short", "ein l\u00e4ngerer Text " * 30, "x" * 1000]
    want = []
    for t in texts:
        data = (t or "").encode()
        places = max(-(-len(data) // quality_cnn.STRIDE), 1)
        data += bytes(quality_cnn.WIDTH)
        top = np.zeros(quality_cnn.FILTERS)
        for p in range(places):
            x = net.p["embed"][list(data[p * quality_cnn.STRIDE : p * quality_cnn.STRIDE + quality_cnn.WIDTH])].reshape(-1)
            top = np.maximum(top, x @ net.p["filter"] + net.p["bias"])
        want.append(float(top @ net.p["out"] + net.p["last"][0]))
    assert np.allclose(net.logits(*quality_cnn._packed(texts)), want, atol=1e-3)


def test_whole_documents_are_read():
    net = quality_cnn.Network(1)
    net.p["out"] = np.ones(quality_cnn.FILTERS, np.float32)
    a = "plain words " * 200_000
    both = net.logits(*quality_cnn._packed([a, a + "ZQ#@!{}<>~^" * 3]))
    assert both[0] != both[1]
    alone = [net.logits(*quality_cnn._packed([t]))[0] for t in (a, "tiny")]
    assert np.allclose(net.logits(*quality_cnn._packed([a, "tiny"])), alone, atol=1e-4)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontaminate.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_leaks_by_brute_force(spark, tables):
    """Every document and item: a document that holds an item's words in a run leaks it, one that shares little does not."""
    docs, _, bench = tables
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    items = {r["item_id"]: lowered(r["text"]) for r in bench.collect()}
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    whole, loose = set(), set()
    for r in docs.select("doc_id", "text").collect():
        w = lowered(r["text"])
        text, own, three = " ".join(w), grams(w), {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for i, x in items.items():
            if " ".join(x) in text or len(x) > 12 and len(grams(x) & own) >= 0.7 * len(grams(x)):
                whole.add((r["doc_id"], i))
            if {tuple(x[k : k + 3]) for k in range(len(x) - 2)} & three:
                loose.add((r["doc_id"], i))
    assert whole and whole <= found, whole - found
    assert found <= loose, found - loose


def test_the_space_is_fitted_on_every_passage(spark, monkeypatch):
    """Whatever the table's size: 30 MB of text, every passage of which is in the last product's count."""
    docs = spark.range(4000).selectExpr("concat_ws(' ', transform(sequence(1, 1000), k -> concat('w', xxhash64(id, k) % 99999))) AS text")
    seen, reduced = [], decontaminate._reduced
    monkeypatch.setattr(decontaminate, "_reduced", lambda *a: seen.append(reduced(*a)) or seen[-1])
    decontaminate.latent_space(docs, shared_dir(spark))
    assert seen[-1][0, 0] == 4000 * -(-1000 // 32)


def test_sums_by_bucket():
    rng = np.random.default_rng(2)
    for n in (1, 7, 300):
        flat = np.minimum(rng.zipf(1.3, (n, 2 * decontaminate.BLOCK)), decontaminate.BUCKETS).astype(np.uint16)
        z = rng.normal(size=(n, 5)).astype(np.float32)
        want, got = np.zeros((2, decontaminate.BUCKETS + 1, 5))
        np.add.at(want, flat.reshape(-1), np.repeat(z, 2 * decontaminate.BLOCK, axis=0))
        decontaminate._add_rows(got, flat.reshape(-1), z)
        assert np.allclose(want[:-1], got[:-1], atol=1e-3) and not got[-1].any()


def test_paraphrases(spark, tables):
    docs, _, bench = tables
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rng = np.random.default_rng(8)
    filler = docs.where("lang = 'en' and n_chars > 3000").orderBy("doc_id").first()["text"].split()
    planted = []
    for k, (_, text) in enumerate(sorted(items.items())[:20]):
        w = text.split()
        drop = set(rng.choice(len(w), len(w) // 8, replace=False).tolist())
        new = [x for j, x in enumerate(w) if j not in drop]
        at = int(rng.integers(0, len(filler)))
        planted.append((1_000_000 + k, " ".join(filler[:at] + new + filler[at:])))
    extra = spark.createDataFrame(planted, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.select("doc_id", "text").union(extra), bench).collect()}
    wanted = {(1_000_000 + k, i) for k, i in enumerate(sorted(items)[:20])}
    assert len(wanted & found) >= 19, wanted - found


def test_recall_of_short_items(spark, tables):
    """Items of 16 to 20 words, whole or with words deleted, replaced or put in, at any place: 0.9 of those that leak by their words are found."""
    docs, _, bench = tables
    rng = np.random.default_rng(8)
    fill = [r["text"].split() for r in docs.where("length(text) between 2000 and 4000").orderBy("doc_id").limit(12).collect()]
    pool = [w for f in fill for w in f]
    planted, wanted = [], set()
    for i, w in sorted((r["item_id"], r["text"].split()) for r in bench.collect()):
        for name, share in (("whole", 0), ("delete", 0.125), ("delete", 0.25), ("replace", 0.125), ("replace", 0.25), ("insert", 0.2)) * 2:
            if len(w) > 20:
                continue
            pick = set(rng.choice(len(w), int(len(w) * share), replace=False).tolist())
            other = lambda: pool[rng.integers(len(pool))]
            new = [y for j, x in enumerate(w) for y in ([x] if j not in pick else {"delete": [], "replace": [other()], "insert": [other(), x]}[name])]
            f = fill[rng.integers(len(fill))]
            at = int(rng.integers(0, len(f)))
            if lcs(lowered(" ".join(w)), lowered(" ".join(new))) >= decontaminate.WHOLE * len(w):
                wanted.add((1_000_000 + len(planted), i))
            planted.append((1_000_000 + len(planted), " ".join(f[:at] + new + f[at:])))
    # the space is that of the table alone: planted rows would turn it towards the items
    space = decontaminate.latent_space(docs.select("text"), shared_dir(spark))
    held = decontaminate.Items(*zip(*((r["item_id"], r["text"]) for r in bench.collect()), strict=True), space)
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in planted], "text": [t for _, t in planted]})
    rows = decontaminate._search(SimpleNamespace(value=held), SimpleNamespace(value=space))(iter([batch]))
    found = {(r["doc_id"], r["item_id"]) for x in rows for r in x.to_pylist()}
    print("short items found:", len(wanted & found), "of", len(wanted))
    assert len(wanted) >= 50 and len(wanted & found) >= 0.9 * len(wanted), (len(wanted & found), len(wanted))


def test_odd_rows_leak_nothing(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "an item with some words that nobody else has written down anywhere at all today"), (None, "x")], "item_id long, text string")
    assert decontaminate.leaks(odd(spark), bench).count() == 0
    assert decontaminate.leaks(odd(spark).where("false"), bench).count() == 0
    assert decontaminate.leaks(odd(spark), bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(odd(spark), bench).columns == odd(spark).columns
    same = spark.createDataFrame([(None, bench.collect()[2]["text"]), (9, "Before. " + bench.collect()[2]["text"].upper())], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(same, bench).collect()} >= {(None, 3), (9, 3)}
