"""Personal data: the base patterns by Python's own regular expressions, disclosure by hand-made co-occurrence."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pii

from .common import odd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1245.@+- ()_%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y", "@b.c", "a@b..c", "a@b.c.", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300", "4111 1111 1111 1111", "4111-1111-1111-1111 9", "+49 (30) 123-4567", "+1", "001.002.003.004", "a@b.c-d.e_f", "é@b.cé"])
def test_examples(text):
    assert pii.base_spans(text) == plain(text)


def test_documents_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    for r in df.select("doc_id", "text").collect():
        spans = plain(r["text"] or "")
        g, text = got[r["doc_id"]], pii.joined(spans)
        assert [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(s[0] == k for s in spans) for k in pii.KINDS[:4]]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert g["spans"] == text or g["spans"].startswith(text) and "term:" in g["spans"]


def test_disclosure(spark):
    """"Quillon" always stands near one address and nowhere else; "meeting" stands everywhere."""
    rows = [(i, f"note {'abcde'[i] * 4} meeting with Quillon at quillon@corp.example about {'vwxyz'[i] * 5}") for i in range(5)]
    rows += [(100 + i, f"meeting {i} about the plan of team number {i}") for i in range(200)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[2][1]
    terms = [(t["start"], t["stop"]) for t in found[2]["terms"]]
    assert (text.index("Quillon"), text.index("Quillon") + 7) in terms
    assert all(text[a:b] not in ("meeting", "about") for a, b in terms)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Quillon" not in clean[2] and "quillon@" not in clean[2] and "[EMAIL]" in clean[2] and "meeting" in clean[2]
    assert clean[150] == dict(rows)[150] and len(clean) == len(rows)


def told(spark, rows, word):
    """Ids of the rows in which ``word`` is marked at every place where it stands."""
    found = {r["doc_id"]: {(t["start"], t["stop"]) for t in r["terms"] or ()} for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {i for i, text in rows if word in text and {m.span() for m in re.finditer(re.escape(word), text)} <= found[i]}


def crowd(word, far=1):
    """Five documents in which ``word`` stands ``far`` words from an address, and 200 others."""
    rows = [(i, f"note {'abcde'[i] * 4} {word} {'the plan ' * (far // 2)}at q@corp.example about {'vwxyz'[i] * 5}") for i in range(5)]
    return rows + [(100 + i, f"meeting {i} about the plan of team number {i}") for i in range(200)]


def test_disclosing_terms_far_from_the_entity(spark):
    """A term 40 words from the address discloses it, and is marked wherever it stands: twice in a text, and in one without the address."""
    rows = [*crowd("Quillon", far=40), (900, "the plan of Quillon about Quillon again")]
    assert told(spark, rows, "Quillon") == {0, 1, 2, 3, 4, 900}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("Quillon" in x for x in clean.values())


@pytest.mark.parametrize("word", ["jdoe77", "AC-4471", "@jd", "K9", "90210"])
def test_terms_with_digits_and_short_ones(spark, word):
    assert told(spark, crowd(word), word) == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("space", ["\u00a0", "\u2003", "\x85", "\x1f"])
def test_a_term_with_an_odd_space_is_counted_as_it_is_found(spark, space):
    word = f"Nom{space}Quillon"
    assert told(spark, crowd(word), word) == {0, 1, 2, 3, 4}


def test_copies_of_a_text_are_no_support(spark):
    rows = [(i, "call Brandl now at +49 30 1234567 please") for i in range(50)] + [(100 + i, f"other text {i}") for i in range(50)]
    assert all(not r["terms"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_odd_rows(spark):
    got = pii.find_personal_data(odd(spark)).collect()
    assert len(got) == 11 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_personal_data(odd(spark).where("false")).count() == 0
    long = "+" + "1" * 200_000 + " " + "1.2.3.4 " * 1000 + "a" * 100_000 + "@b.c"
    r = pii.find_personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r["n_ip"], r["n_email"], r["n_phone"]) == (1000, 1, 0)


def test_rows_that_repeat_are_cleaned_one_by_one(spark):
    rows = [(1, "mail a@b.cc now"), (1, "mail a@b.cc now"), (1, "no data"), (None, "ip 1.2.3.4"), (None, None)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", "mail [EMAIL] now"), ("1", "mail [EMAIL] now"), ("1", "no data"), ("None", "ip [IP]"), ("None", "")])
