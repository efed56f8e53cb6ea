"""Token files: exact round trips of blocks and files, and ids against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import tokens
from corvane.llm.common import claim, shared_dir
from corvane.llm.queries import tokenizer_path

from .common import odd


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**16 - 1), st.integers(0, 2**32 - 1)), max_size=300))
def test_blocks(ids):
    ids = np.array(ids, np.uint32)
    raw = tokens.pack(ids)
    assert np.array_equal(tokens.unpack(memoryview(raw + b"rest"), len(ids)), ids)


def test_block_layout():
    ids = np.concatenate([np.arange(100, 200), [1_000_000]]).astype(np.uint32)
    raw = tokens.pack(ids)
    assert raw[:7] == (100).to_bytes(4, "little") + bytes([7]) + (1).to_bytes(2, "little")
    assert len(raw) == 7 + (101 * 7 + 7) // 8 + 2 + 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.lists(st.integers(0, 2**32 - 1), max_size=40)), max_size=20))
def test_files(rows):
    raw = tokens.encode_file([d for d, _ in rows], [np.array(x, np.uint32) for _, x in rows])
    assert [(d, x.tolist()) for d, x in tokens.decode_file(raw)] == [(d, list(x)) for d, x in rows]
    with pytest.raises(ValueError):
        list(tokens.decode_file(raw[:-1] + b"x"))


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


TEXTS = ["", None, "Hello world", "  two  spaces ", "a\tb\nc\r\nd\x0be\x0cf", "Straße Ünïcödé ÀÉ ÿ ß", "日本語 テキスト", "emoji \U0001f600 ok", "it's o'clock—dash", "x" * 5000, "9 10.5 1,000", "a\u00a0b\u2003c\u0085d", "MiXeD CASE, words; (here)!", "#*$%&|<>", "e\u0301 combining", "\ufeffbom", "İstanbul ŉ ǆ", "A1b2,c_d[e]f--g", "l'idée C'EST it's don't", "É\u0301É ÀÿØ×÷ß", "a\x1cb \x7f", "x" * 30 + "'" + "y" * 30]


def encoded(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_encoder(monkeypatch):
    encoder = tokens.Encoder(tokenizer_path(), 2)
    assert encoder.plain
    for part in (TEXTS, TEXTS[::-1], []):
        assert encoded(encoder, part) == library(part)
    monkeypatch.setattr(tokens, "CACHE", 3)  # all is forgotten before each batch
    for part in (TEXTS, TEXTS[::-1], TEXTS):
        assert encoded(encoder, part) == library(part)
    encoder.plain = False  # a tokenizer that cuts otherwise: every piece by the library's whole path
    encoder._clear()
    assert encoded(encoder, TEXTS) == library(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(), st.sampled_from("aB9 ,'.\u00c9\u00d7\u00e9\u0301\x1c\u00b5")), max_size=60), max_size=4))
def test_any_text(texts):
    assert encoded(claim("test", make=lambda: tokens.Encoder(tokenizer_path(), 2)), texts) == library(texts)


def check(spark, df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokens.token_output(df, tokenizer_path()).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, library([t for _, t in rows]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [d for d, _ in rows]


def test_documents_table(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(spark):
    check(spark, odd(spark))
    assert tokens.token_output(odd(spark).where("false"), tokenizer_path()).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_many_files(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/t"
    files = tokens.write_tokens(df, folder, tokenizer_path(), partitions=5)
    rows = files.orderBy("start").collect()
    assert len(rows) == 5 and rows[0]["start"] == 0 and all(a["start"] + a["tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert tokens.read_tokens(files, folder).count() == df.count()
