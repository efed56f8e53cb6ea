"""Filter text to a boolean Spark column.

The text is lexed, parsed to a small tree, checked against the schema as a whole
(no branch can hide an error), and then written as a column that Catalyst pushes into the
scan. Truth is three-valued: a row passes only where the column is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import DataType, IndexType, NUMERIC_RANGES, Schema

MAX_RELATIONS, MAX_IN, MAX_CONTAIN = 4096, 20_000, 32

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<float>[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[dDfF]?(?![\w.])|[+-]?\d+(?:[eE][+-]?\d+[dDfF]?|[dDfF])(?![\w-]))
    |(?P<int>[+-]?\d+(?![\w.-]))
    |(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<name>[A-Za-z0-9_][A-Za-z0-9_-]*)
    |(?P<op><\s*=|>\s*=|!\s*=|=|<|>|\(|\)|,)""",
    re.X | re.S,
)
_KEYWORDS = {"AND", "OR", "NOT", "IN", "LIKE", "IS", "NULL", "TRUE", "FALSE", "CONTAIN_ALL", "CONTAIN_ANY"}
_ORDER = ("=", "!=", "<", ">", "<=", ">=")


@dataclass
class Node:
    """kind: and, or (children), cmp, like, in, contain, null, length, true, false."""

    kind: str
    name: str = ""
    op: str = ""
    negated: bool = False
    values: list = field(default_factory=list)
    children: list = field(default_factory=list)


def _lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidArgument(f"filter: cannot read {text[at : at + 20]!r}")
        kind, raw, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if kind == "float":
            out.append(("value", float(raw.rstrip("dDfF"))))
        elif kind == "int":
            out.append(("value", int(raw)))
        elif kind == "text":
            out.append(("value", raw[1:-1].replace("\\'", "'").replace('\\"', '"')))
        elif kind == "op":
            out.append(("op", "".join(raw.split())))
        elif raw.upper() in _KEYWORDS:
            out.append(("key", raw.upper()))
        else:
            out.append(("name", raw))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.relations = _lex(text), 0, 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", None)

    def take(self, *wanted):
        if wanted and self.peek() not in wanted:
            raise InvalidArgument(f"filter: {self.peek()[1]!r} where {' or '.join(str(w[1]) for w in wanted)} was expected")
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", None)

    def parse(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise InvalidArgument(f"filter: {self.peek()[1]!r} is not expected there")
        return node

    def _chain(self, word: str, below) -> Node:
        parts = [below()]
        while self.peek() == ("key", word):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(word.lower(), children=parts)

    def either(self) -> Node:
        return self._chain("OR", self.both)

    def both(self) -> Node:
        return self._chain("AND", self.unit)

    def unit(self) -> Node:
        if self.peek() == ("op", "("):
            self.take()
            node = self.either()
            self.take(("op", ")"))
            return node
        self.relations += 1
        if self.relations > MAX_RELATIONS:
            raise InvalidArgument(f"filter: more than {MAX_RELATIONS} relations")
        kind, name = self.peek()
        if kind != "name":
            raise InvalidArgument(f"filter: a field name was expected, not {name!r}")
        self.take()
        if name.lower() == "array_length" and self.peek() == ("op", "("):
            self.take()
            of = self.take()
            self.take(("op", ")"))
            op = self.take(*(("op", x) for x in _ORDER))[1]
            value = self.take()
            if of[0] != "name" or value[0] != "value" or type(value[1]) is not int:
                raise InvalidArgument("filter: array_length(field) is compared with an integer")
            return Node("length", of[1], op, values=[value[1]])
        if self.peek() == ("key", "IS"):
            self.take()
            negated = self.peek() == ("key", "NOT")
            if negated:
                self.take()
            self.take(("key", "NULL"))
            return Node("null", name, negated=negated)
        negated = self.peek() == ("key", "NOT")
        if negated:
            self.take()
        kind, word = self.peek()
        if (kind, word) == ("key", "IN"):
            self.take()
            return Node("in", name, negated=negated, values=self.values(False, MAX_IN))
        if kind == "key" and word in ("CONTAIN_ALL", "CONTAIN_ANY"):
            self.take()
            return Node("contain", name, word[8:].lower(), negated, self.values(True, MAX_CONTAIN))
        if negated:
            raise InvalidArgument("filter: NOT goes with IN, CONTAIN_ALL and CONTAIN_ANY")
        if (kind, word) == ("key", "LIKE"):
            self.take()
            return Node("like", name, values=[self.value()])
        op = self.take(*(("op", x) for x in _ORDER))[1]
        return Node("cmp", name, op, values=[self.value()])

    def value(self):
        kind, value = self.take()
        if kind == "value":
            return value
        if kind == "key" and value in ("TRUE", "FALSE"):
            return value == "TRUE"
        raise InvalidArgument(f"filter: a literal was expected, not {value!r}")

    def values(self, may_be_empty: bool, most: int) -> list:
        self.take(("op", "("))
        out = []
        if not (may_be_empty and self.peek() == ("op", ")")):
            out.append(self.value())
            while self.peek() == ("op", ","):
                self.take()
                out.append(self.value())
        self.take(("op", ")"))
        if len(out) > most:
            raise InvalidArgument(f"filter: more than {most} values in a list")
        return out


def parse(text: str) -> Node:
    """The tree of a filter text."""
    return _Parser(text).parse()


def _literal(name: str, t: DataType, value: object):
    """A literal as the field's type takes it."""
    if t is DataType.BOOL and isinstance(value, bool):
        return F.lit(value)
    if t is DataType.STRING and isinstance(value, str):
        return F.lit(value)
    if t.is_integer and type(value) is int:
        low, high = NUMERIC_RANGES[t.value]
        if not low <= value <= high:
            raise InvalidArgument(f"filter: {value} is out of range for {name}")
        return F.lit(str(value)).cast(t.spark()) if t is DataType.UINT64 else F.lit(value).cast(t.spark())
    if t in (DataType.FLOAT, DataType.DOUBLE) and type(value) in (int, float):
        return F.lit(float(value)).cast(t.spark())
    raise InvalidArgument(f"filter: {value!r} does not fit {name} of type {t.value}")


def check(node: Node, schema: Schema) -> None:
    """Raise for every relation that the schema does not allow, wherever it stands."""
    for child in node.children:
        check(child, schema)
    if not node.name:
        return
    f = schema[node.name]
    t = f.type
    if t.is_vector:
        raise InvalidArgument(f"filter: {f.name} is a vector")
    if f.index is not None and f.index.kind is IndexType.FTS:
        raise InvalidArgument(f"filter: {f.name} is a full-text field")
    if node.kind == "null":
        return
    if node.kind in ("contain", "length"):
        if not t.is_array or t is DataType.ARRAY_BINARY and node.kind == "contain":
            raise InvalidArgument(f"filter: {f.name} is no array that {node.kind} reads")
        if node.kind == "contain":
            for v in node.values:
                _literal(f.name, t.element, v)
        return
    if t.is_array or t is DataType.BINARY:
        raise InvalidArgument(f"filter: {f.name} of type {t.value} cannot be compared")
    if node.kind == "like":
        if t is not DataType.STRING or not isinstance(node.values[0], str):
            raise InvalidArgument(f"filter: LIKE reads strings, {f.name} is {t.value}")
        return
    if t is DataType.BOOL and node.kind == "cmp" and node.op not in ("=", "!="):
        raise InvalidArgument(f"filter: {f.name} is a bool and has no order")
    for v in node.values:
        _literal(f.name, t, v)


def _balanced(parts: list[Column], join) -> Column:
    """Operands joined as a balanced tree, so that a long chain does not nest deeply."""
    while len(parts) > 1:
        parts = [reduce(join, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def column(node: Node, schema: Schema) -> Column:
    """The tree as a boolean column."""
    if node.kind == "and":
        return _balanced([column(c, schema) for c in node.children], lambda a, b: a & b)
    if node.kind == "or":
        return _balanced([column(c, schema) for c in node.children], lambda a, b: a | b)
    f = schema[node.name]
    col, t = F.col(f"`{f.name}`"), f.type
    if node.kind == "null":
        return col.isNotNull() if node.negated else col.isNull()
    if node.kind == "cmp":
        return _COMPARE[node.op](col, _literal(f.name, t, node.values[0]))
    if node.kind == "like":
        return col.like(node.values[0])
    if node.kind == "in":
        held = col.isin(*[_literal(f.name, t, v) for v in node.values])
        return ~held if node.negated else held
    if node.kind == "length":
        return _COMPARE[node.op](F.when(col.isNotNull(), F.size(col)), F.lit(node.values[0]))
    literals = [_literal(f.name, t.element, v) for v in node.values]
    if not literals:  # ANY of nothing holds nowhere, ALL of nothing wherever there is an array
        return col.isNotNull() if (node.op == "all") != node.negated else F.lit(False)
    has = [F.coalesce(F.array_contains(col, v), F.lit(False)) for v in literals]
    held = _balanced(has, (lambda a, b: a & b) if node.op == "all" else (lambda a, b: a | b))
    return F.when(col.isNotNull(), ~held if node.negated else held)


def compile_filter(text: str | None, schema: Schema) -> Column | None:
    """The column of a filter text; None for no filter."""
    if text is None or not text.strip():
        return None
    node = parse(text)
    check(node, schema)
    return column(node, schema)
