"""Analysis of text for search: tokenizers and token filters, the same for documents and queries."""

from __future__ import annotations

import unicodedata
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, NotSupported
from .stem import stem

#: Words of letters and digits with marks inside, single ideographs and kana, after Unicode's word rules; a word has a letter or digit.
_HAN = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_PART = r"\p{L}(?:[.:'’]\p{L})*|\p{Nd}(?:[.,;'’]\p{Nd})*"
STANDARD = rf"_*(?:{_PART})(?:{_PART}|_)*"
#: The same words by steps over whole runs of letters or digits that never step back. For Java alone.
_RUN = r"\p{L}++(?:[.:'’]\p{L}++)*+|\p{Nd}++(?:[.,;'’]\p{Nd}++)*+"
_RUNS = rf"_*+(?:{_RUN})(?:{_RUN}|_++)*+"
MAX_TOKEN = 255
#: Letters whose lower case depends on what stands beside them or is more than a letter.
_UNEVEN = "[\u0130\u03a3]"
#: What a text has to hold for the careful way of ``standard``: such letters, ideographs, or a run longer than a token.
_RARE = rf"[\u0130\u03a3{_HAN}]|(?<!\S)\S{{{MAX_TOKEN + 1}}}"


def _standard(text: Column) -> Column:
    spaced = F.when(text.rlike(f"[{_HAN}]"), F.regexp_replace(text, f"([{_HAN}])", " $1 ")).otherwise(text)
    found = F.regexp_extract_all(spaced, F.lit(_RUNS), F.lit(0))
    cut = lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{MAX_TOKEN}}}"), F.lit(0))
    return F.when(text.rlike(rf"(?<!\S)\S{{{MAX_TOKEN + 1}}}"), F.flatten(F.transform(found, cut))).otherwise(found)


def _whitespace(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


_CLASSES = {"letter": r"\p{L}", "digit": r"\p{Nd}", "whitespace": r"\s", "punctuation": r"\p{P}", "symbol": r"\p{S}"}


def _ngram(text: Column, least: int, most: int, classes: tuple[str, ...]) -> Column:
    if least < 1 or most < least or most - least > 1:
        raise InvalidArgument("ngram: 1 <= min <= max <= min + 1")
    if set(classes) - set(_CLASSES):
        raise InvalidArgument(f"ngram: unknown classes {sorted(set(classes) - set(_CLASSES))}")
    runs = F.regexp_extract_all(text, F.lit("[" + "".join(_CLASSES[c] for c in classes) + "]+"), F.lit(0)) if classes else F.array(text)

    def grams(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(run) - least + 1, F.lit(1)))
        each = F.transform(starts, lambda s: F.filter(F.array(*[F.when(s + n - 1 <= F.length(run), F.substring(run, s, F.lit(n))) for n in range(least, most + 1)]), lambda g: g.isNotNull()))
        return F.flatten(each)

    return F.flatten(F.transform(runs, grams))


_FOLDED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def fold(token: str) -> str:
    """A token without accents and with letters beyond ASCII spelt out where there is a usual way."""
    out = "".join(_FOLDED.get(x, x) for x in token)
    return "".join(x for x in unicodedata.normalize("NFKD", out) if not unicodedata.combining(x))


def _rewritten(tokens: Column, names: tuple[str, ...]) -> Column:
    """Tokens after Python filters, all of them in one Arrow pass."""
    steps = [{"lowercase": str.lower, "ascii_folding": fold, "stemmer": stem}[n] for n in names]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(token: str) -> str:
            out = known.get(token)
            if out is None:
                out = token
                for step in steps:
                    out = step(out)
                known[token] = out
            return out

        return rows.map(lambda ts: None if ts is None else [one(t) for t in ts])

    return run(tokens)


def analyze(text: Column, tokenizer: str = "standard", filters: tuple[str, ...] | list[str] = ("lowercase",), **options) -> Column:
    """array<string> of a text's tokens; null text gives null.

    Tokenizers: standard, whitespace, ngram (options min_gram, max_gram, token_chars). Filters in order:
    lowercase, ascii_folding, stemmer (English). The last two run in Arrow batches, all else in the JVM.
    """
    native = list(takewhile(lambda n: n == "lowercase", filters))
    if tokenizer in ("standard", "whitespace"):
        split = _standard if tokenizer == "standard" else _whitespace
        out = split(text)
        if native:  # the whole text at once is lowered in generated code; its words alone where that could differ
            if tokenizer == "standard":  # one look at most texts, instead of one for each thing that is rare
                out = F.when(text.rlike(_RARE), F.transform(out, F.lower)).otherwise(F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0)))
            else:
                out = F.when(text.rlike(_UNEVEN), F.transform(out, F.lower)).otherwise(split(F.lower(text)))
            native = []
    elif tokenizer == "ngram":
        out = _ngram(text, options.get("min_gram", 2), options.get("max_gram", 2), tuple(options.get("token_chars", ("letter", "digit"))))
    elif tokenizer == "jieba":
        raise NotSupported("the jieba tokenizer needs a dictionary that is not installed")
    else:
        raise InvalidArgument(f"no tokenizer {tokenizer!r}")
    for name in filters:
        if name not in ("lowercase", "ascii_folding", "stemmer"):
            raise InvalidArgument(f"no token filter {name!r}")
        if name == "stemmer" and options.get("stemmer_lang", "english") not in ("english", "en"):
            raise NotSupported("the stemmer knows English")
    if native:
        out = F.transform(out, F.lower)
    rest = tuple(filters[len(list(takewhile(lambda n: n == "lowercase", filters))) :])
    return _rewritten(out, rest) if rest else out


def analyze_query(spark, texts: list[str], tokenizer: str = "standard", filters=("lowercase",), **options) -> list[list[str]]:
    """Tokens of a few query texts, by the same expressions as documents."""
    rows = spark.range(1).select(*[analyze(F.lit(t), tokenizer, filters, **options).alias(f"t{k}") for k, t in enumerate(texts)]).first()
    return [list(x or []) for x in rows] if texts else []
