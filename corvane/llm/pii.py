"""Personal data: base kinds by pattern, and terms that disclose them by information theory.

Emails, IP addresses, cards and phone numbers are the protected entities. Corpus
co-occurrence by document tells how much a term gives an entity away: with N documents, the
pointwise mutual information log(N * n(term, entity) / (n(term) * n(entity))) over the entity's own
information log(N / n(entity)) is the share of the entity that the term discloses. Every word outside base
entities is a term. Terms of documents that have an entity in SUPPORT different contexts (the REACH words on either
side of it) are generalised from GENERALISE on and removed from REMOVE on, wherever they stand in any document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, shared_dir, stored

KINDS = ("email", "ip", "card", "phone", "term")
REACH, SUPPORT, GENERALISE, REMOVE = 6, 3, 0.7, 0.95
#: Bits of the fixed-size filters of entities and terms: 1 MB in every task.
TERM_BITS = 1 << 23
#: Terms that a task counts, or rows that it gathers, before it hands them on.
HELD_TERMS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}<>"
#: How a span of each kind is written in a sanitised text.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _email_spans(text: str) -> list[tuple[int, int]]:
    """All matches of the email pattern, leftmost and not overlapping, in time linear in the text.

    A match ends its first part at an @, so it starts where the run of such characters before that @
    starts, or where the match before it ended.
    """
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((lo, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base entity, by kind as listed, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _email_spans(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(word: str) -> str:
    """The form in which words are counted as terms; a word of signs alone is none."""
    return word.strip(_EDGES).lower()


def _outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Start and end of the words of a text that lie in no span, not even in part."""
    out, at, taken = [], 0, sorted((a, b) for _, a, b in spans)
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not any(a < m.end() and b > m.start() for a, b in taken[at : at + 1]):
            out.append(m.span())
    return out


def _contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """(entity, context) of each entity: a digest of the terms of the REACH words on either side of it."""
    words = [m.span() for m in _WORD.finditer(text)] if spans else []
    starts = np.array([a for a, _ in words])
    out = []
    for kind, a, b in spans:
        value = f"{kind}:{text[a:b].lower() if kind == 'email' else _digits(text[a:b]) if kind != 'ip' else text[a:b]}"
        lo = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
        hi = int(np.searchsorted(starts, b, "left"))
        near = [*range(max(lo - REACH, 0), lo), *range(hi, min(hi + REACH, len(words)))]
        said = " ".join(term_of(text[words[k][0] : words[k][1]]) for k in near)
        out.append((value, int.from_bytes(hashlib.blake2b(said.encode(), digest_size=8).digest(), "big", signed=True)))
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, str | None, list[tuple[str, int, int]]]]:
    """(row, text as bytes, text, base spans) of every row; the text is None where no base entity is."""
    data, offsets = buffers(batch.column("text"))
    marked = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    some = (marked[offsets[1:]] > marked[offsets[:-1]]).tolist()  # no entity without a digit or an @
    raw = memoryview(data)
    for k in range(batch.num_rows):
        own = bytes(raw[offsets[k] : offsets[k + 1]])
        text = own.decode() if some[k] else None
        spans = base_spans(text) if some[k] else []
        yield k, own, text if spans else None, spans


def _told_terms(own: bytes, text: str | None, spans: list, bits: bytes, known: dict[bytes, str]) -> set[str]:
    """The distinct terms of a text that the filter lets pass; ``known`` remembers words."""
    # bytes split at ASCII white space, as _WORD does
    words = set(own.split()) if text is None else {text[a:b].encode() for a, b in _outside(text, spans)}
    terms = set()
    for word in words:
        t = known.get(word)
        if t is None:
            if len(known) > 300_000:
                known.clear()
            t = term_of(word.decode())
            known[word] = t = t if t and _has(bits, t) else ""
        if t:
            terms.add(t)
    return terms


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x for _, _, text, spans in _texts(batch) if text is not None for x in set(_contexts(text, spans))]
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["entity", "context"])


def _pairs(held):
    """(entity, term, context, docs) of the terms of every document of an entity that the filter lets pass; docs is 1 once a document and pair.

    Each such document has the empty term as well, which counts the entity itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, found = held.value, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["entity", "term", "context", "docs"])
            found.clear()
            return out

        for batch in batches:
            for _, _, text, spans in _texts(batch):
                own: dict[str, set[int]] = {}
                for e, c in _contexts(text, spans) if text is not None else ():
                    if _has(bits, e):
                        own.setdefault(e, set()).add(c)
                terms = {"", *(term_of(text[a:b]) for a, b in _outside(text, spans))} if own else ()
                for e, contexts in own.items():
                    for t in terms:
                        found.extend((e, t, c, int(k == 0)) for k, c in enumerate(contexts))
                        if len(found) > HELD_TERMS:
                            yield flush()
        yield flush()

    return run


def _term_hits(held):
    """Candidate terms with the documents that have them, counted in each task; a filter of fixed size lets few others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        known: dict[bytes, str] = {}
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for _, own, text, spans in _texts(batch):
                counts.update(_told_terms(own, text, spans, bits, known))
                if len(counts) > HELD_TERMS:
                    yield flush()
        yield flush()

    return run


_ROW = "rid long, doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, told array<struct<term string, start long, stop long>>"


def _find(held):
    """Base spans of every row, and the words that the filter of disclosing terms lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        empty, bits = hashlib.sha256(b"").hexdigest(), held.value
        known: dict[bytes, str] = {}
        for batch in batches:
            n = batch.num_rows
            base, told, sha, counts = [""] * n, [[] for _ in range(n)], [empty] * n, np.zeros((4, n), np.int64)
            for k, own, text, spans in _texts(batch):
                if spans:
                    base[k] = joined(spans)
                    sha[k] = hashlib.sha256(base[k].encode()).hexdigest()
                    for kind, _, _ in spans:
                        counts[KINDS.index(kind), k] += 1
                terms = _told_terms(own, text, spans, bits, known) if bits else ()
                if terms:
                    text = own.decode()
                    for a, b in _outside(text, spans):
                        raw = text[a:b]
                        if (t := term_of(raw)) in terms:
                            told[k].append({"term": t, "start": a + len(raw) - len(raw.lstrip(_EDGES)), "stop": b - len(raw) + len(raw.rstrip(_EDGES))})
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(base), *[pa.array(c) for c in counts], pa.array(sha), pa.array(told, told_type)],
                ["rid", "doc_id", "base", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "told"],
            )

    return run


def _bit(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=4).digest(), "big") % TERM_BITS


def _has(bits: bytes, term: str) -> int:
    h = _bit(term)
    return bits[h >> 3] >> (h & 7) & 1


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bit(t) for t in batch.column(0).to_pylist()], pa.int64())], ["bit"])


def _filter(names: DataFrame):
    """A broadcast filter of fixed size of the names in a table's only column; empty if there are none."""
    rows = names.distinct().mapInArrow(_bits, "bit long").distinct()
    words = rows.groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("b")).collect()  # TERM_BITS / 64 rows at most
    bits = np.zeros(TERM_BITS // 64, np.uint64)
    for r in words:
        bits[r["w"]] = np.uint64(r["b"] & (1 << 64) - 1)
    return names.sparkSession.sparkContext.broadcast(bits.view(np.uint8).tobytes() if words else b"")


def disclosures(docs: DataFrame, path: str) -> DataFrame:
    """(entity, term, share): the terms that disclose an entity by GENERALISE or more."""
    # an entity of fewer contexts has no term of so many; the few others alone are paired with all terms of their documents
    seen = docs.select("text").mapInArrow(_entities, "entity string, context long").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    often = stored(seen.where(F.col("contexts") >= SUPPORT).select("entity"), f"{path}/often")
    held = _filter(often)
    if not held.value:
        return often.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("share")).limit(0)
    rows = docs.select("text").mapInArrow(_pairs(held), "entity string, term string, context long, docs long")
    rows = rows.groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    pairs = rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("docs").alias("both"))
    pairs = stored(pairs.where(F.col("contexts") >= SUPPORT), f"{path}/pairs")
    # documents of an entity: each has its pair with the empty term
    entities = pairs.where("term = ''").select("entity", F.col("both").alias("n_entity"))
    pairs = pairs.where("term != ''")
    held = _filter(pairs.select("term"))
    if not held.value:
        return pairs.select("entity", "term", F.lit(0.0).alias("share")).limit(0)
    terms = docs.select("text").mapInArrow(_term_hits(held), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = docs.count()
    joined_up = pairs.join(entities, "entity").join(terms, "term")
    own = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    mutual = F.log(F.lit(float(max(total, 1))) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(own > 0, mutual / own).otherwise(F.lit(0.0))
    return stored(joined_up.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE), f"{path}/disclosures")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _marked(rows: DataFrame, path: str) -> DataFrame:
    """(rid, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms) of every row (rid, doc_id, text); rid names it."""
    told = disclosures(rows, path).groupBy("term").agg(F.max("share").alias("share"))
    found = stored(rows.mapInArrow(_find(_filter(told.select("term"))), _ROW), f"{path}/found")
    near = found.where(F.size("told") > 0).select("rid", F.explode("told").alias("x")).select("rid", "x.term", "x.start", "x.stop")
    hits = near.join(told, "term").select("rid", "start", "stop", "share")
    hits = hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "share"))).alias("terms"))
    out = found.drop("told").join(hits, "rid", "left")
    written = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["stop"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, written))
    return out.select("rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), "terms")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms) of every row of ``docs``.

    ``spans`` are all spans kind:start:end by kind as listed (terms last), then start; ``terms`` are the
    disclosing terms as structs (start, stop, share), in documents without the entity too. Whole texts are read, however long;
    null and empty ones have no spans. Rows that repeat an id
    are looked at one by one; exact copies of a context count once for support. A share that equals a limit reaches it. A null id
    stays null, an empty table gives no rows; only doc_id and text are read.
    """
    return _marked(_rows(docs), shared_dir(docs.sparkSession)).drop("rid")


def sanitise_text(text: str | None, spans: str, shares: dict[int, float] | None = None) -> str:
    """A text with its spans masked: base kinds by their names, terms generalised to their shape or removed."""
    text, out, at = text or "", [], 0
    parts = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    for a, b, kind in parts:
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if kind == "term":
            removed = (shares or {}).get(a, 1.0) >= REMOVE
            out.append("" if removed else ("[Name]" if text[a : a + 1].isupper() else "[term]"))
        else:
            out.append(MASKS[kind])
        at = b
    return "".join([*out, text[at:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [sanitise_text(t, s, {x["start"]: x["share"] for x in terms or ()}) for t, s, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], ["doc_id", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, with personal data masked and disclosing terms generalised or removed.

    Rows of a null or repeated id are each cleaned by their own spans; a null text becomes empty, an empty table gives no rows.
    """
    path = shared_dir(docs.sparkSession)
    rows = stored(_rows(docs), f"{path}/rows")  # written, so that rid names the same row twice
    found = _marked(rows, path).where("spans != ''").select("rid", "spans", "terms")
    rows = rows.join(found, "rid", "left").select("doc_id", "text", F.coalesce("spans", F.lit("")).alias("spans"), "terms")
    return rows.mapInArrow(_sanitise, "doc_id long, text string")
