"""Arithmetic of computed columns: + - * / with unary signs, brackets, numbers and numeric columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import DataType, NUMERIC_RANGES, Schema

_TOKEN = re.compile(r"\s*(?:(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op>[-+*/()]))")


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidArgument(f"expression: cannot read {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def compile_expression(text: str, schema: Schema) -> Column:
    """The column of an expression. Whole numbers divide to whole numbers; by zero gives null."""
    tokens, at = _lex(text), 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) else None

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise InvalidArgument("expression: it ends too soon")
        at += 1
        return tokens[at - 1]

    def chain(below, ops: str):
        value, whole = below()
        while peek() is not None and peek() in ops and tokens[at][0] == "op":
            op = take()[1]
            right, also = below()
            both = whole and also
            if op == "+":
                value = value + right
            elif op == "-":
                value = value - right
            elif op == "*":
                value = value * right
            elif both:
                quotient = F.call_function("div", F.abs(value), F.nullif(F.abs(right), F.lit(0)))
                value = F.when((value < 0) != (right < 0), -quotient).otherwise(quotient)
            else:
                value = value / F.nullif(right.cast("double"), F.lit(0.0))
            whole = both
        return value, whole

    def unit():
        kind, raw = take()
        if kind == "op" and raw in "+-":
            value, whole = unit()
            return (-value if raw == "-" else value), whole
        if kind == "op" and raw == "(":
            inner = total()
            if take()[1] != ")":
                raise InvalidArgument("expression: a bracket is not closed")
            return inner
        if kind == "int":
            return F.lit(int(raw)).cast("long"), True
        if kind == "float":
            return F.lit(float(raw)), False
        if kind == "name":
            f = schema[raw.strip("`")]
            if not f.type.is_numeric:
                raise InvalidArgument(f"expression: {f.name} is not numeric")
            whole = f.type.is_integer
            return F.col(f"`{f.name}`").cast("decimal(20,0)" if f.type is DataType.UINT64 else "long" if whole else "double"), whole
        raise InvalidArgument(f"expression: {raw!r} is not expected there")

    def product():
        return chain(unit, "*/")

    def total():
        return chain(product, "+-")

    value, _ = total()
    if at < len(tokens):
        raise InvalidArgument(f"expression: {tokens[at][1]!r} is not expected there")
    return value


def wrap(value: Column, t: DataType) -> Column:
    """A number as type ``t``: fractions are cut off, whole numbers too large wrap around."""
    if t in (DataType.FLOAT, DataType.DOUBLE):
        return value.cast(t.spark())
    low, high = NUMERIC_RANGES[t.value]
    span = F.lit(str(high - low + 1)).cast("decimal(38,0)")
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("decimal(38,0)")
    offset = F.lit(str(low)).cast("decimal(38,0)")
    return (F.pmod(cut - offset, span) + offset).cast(t.spark())
