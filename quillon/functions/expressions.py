"""Row expressions: text to Column, under the value semantics.

    n * (1 - d) > 10 and name contains "ab" or not active

`linha.x`, `row.x` and plain names are columns; `x?.y` and unknown columns are null; words of both
languages are known (and/e, or/ou, not/nao, contains/contem, true/verdadeiro, false/falso, null/nulo).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .values import Value

_LEX = re.compile(r"\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|\?\.|\.\.|[-+*/%<>()\[\].,|]))", re.S)
WORDS = {"e": "and", "and": "and", "ou": "or", "or": "or", "nao": "not", "não": "not", "not": "not", "contem": "contains", "contém": "contains", "contains": "contains"}
CONSTANTS = {"true": True, "verdadeiro": True, "false": False, "falso": False, "null": None, "nulo": None}
ROW = ("linha", "row")


def _length(v: Value) -> Value:
    return Value(F.coalesce((F.size(v.col) if v.kind == V.LIST else F.octet_length(v.col)).cast("long"), F.lit(0).cast("long")) if v.kind in (V.LIST, V.TEXT) else F.lit(0).cast("long"), V.INT, None, False)


def _reduce(name: str) -> Callable[[Value], Value]:
    def f(v: Value) -> Value:
        if v.kind != V.LIST:
            return V.literal(0)
        of = F.transform(v.col, lambda x: V.number(Value(x, v.item or V.INT)).cast("double"))
        total = F.aggregate(of, F.lit(0.0), lambda a, x: a + x)
        some = F.coalesce(F.size(v.col), F.lit(0)) > 0
        out = {"sum": total, "mean": total / F.greatest(F.size(v.col), F.lit(1)), "min": F.array_min(of), "max": F.array_max(of)}[name]
        kind = V.INT if v.item == V.INT and name != "mean" else V.DEC
        return Value(F.when(some, out).otherwise(F.lit(0.0)).cast("long" if kind == V.INT else "double"), kind, None, False)

    return f


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "upper": lambda v: Value(V.upper_ascii(V.display(v)), V.TEXT, None, False),
    "lower": lambda v: Value(V.lower_ascii(V.display(v)), V.TEXT, None, False),
    "length": _length,
    "text": lambda v: Value(V.display(v), V.TEXT, None, False),
    "split": lambda v, s: Value(V.split_text(V.display(v), s.const), V.LIST, V.TEXT, False),
    "chunks": lambda v, size=None, overlap=None: Value(V.chunks(V.display(v), size.const if size else 800, overlap.const if overlap else 100), V.LIST, V.TEXT, False),
    "range": lambda a, b=None: Value(F.when((a if b is None else b).col > (F.lit(0) if b is None else a.col), F.sequence(F.lit(0).cast("long") if b is None else a.col, (a if b is None else b).col - 1)).otherwise(F.array().cast("array<bigint>")), V.LIST, V.INT, False),
    "sum": _reduce("sum"), "mean": _reduce("mean"), "min": _reduce("min"), "max": _reduce("max"),
}
FUNCTIONS |= {pt: FUNCTIONS[en] for pt, en in {"maiusculas": "upper", "minusculas": "lower", "tamanho": "length", "contar": "length", "dividir": "split", "dividir_texto": "chunks", "intervalo": "range", "ate": "range", "somar": "sum", "media": "mean"}.items()}


class _Parser:
    def __init__(self, text: str, schema: T.StructType, functions: dict[str, Callable[..., Value]]):
        self.tokens, self.schema, self.functions = [], schema, functions
        at, text = 0, text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SyntaxError(f"at {text[at : at + 20]!r}")
            kind = m.lastgroup
            t = m.group(kind)
            self.tokens.append(("word", WORDS[t]) if kind == "name" and t in WORDS else (kind, t))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def take(self, *ops: str) -> str | None:
        kind, t = self.tokens[self.i]
        if kind in ("op", "word") and t in ops:
            self.i += 1
            return t
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SyntaxError(f"{op!r} is missing before {self.tokens[self.i][1]!r}")

    def either(self) -> Value:
        a = self.both()
        while self.take("or"):
            a = Value(V.truthy(a) | V.truthy(self.both()), V.BOOL, None, False)
        return a

    def both(self) -> Value:
        a = self.same()
        while self.take("and"):
            a = Value(V.truthy(a) & V.truthy(self.same()), V.BOOL, None, False)
        return a

    def same(self) -> Value:
        a = self.order()
        while op := self.take("==", "!=", "contains"):
            b = self.order()
            c = V.contains(a, b) if op == "contains" else V.equal(a, b)
            a = Value(~c if op == "!=" else c, V.BOOL, None, False)
        return a

    def order(self) -> Value:
        a = self.sum()
        while op := self.take("<", "<=", ">", ">="):
            a = Value(V.compare(op, a, self.sum()), V.BOOL, None, False)
        return a

    def sum(self) -> Value:
        a = self.product()
        while op := self.take("+", "-", "|"):
            a = V.arithmetic(op, a, self.product())
        return a

    def product(self) -> Value:
        a = self.unary()
        while op := self.take("*", "/", "%"):
            a = V.arithmetic(op, a, self.unary())
        return a

    def unary(self) -> Value:
        if self.take("not"):
            return Value(~V.truthy(self.unary()), V.BOOL, None, False)
        if self.take("-"):
            v = self.unary()
            if v.const is not None and not isinstance(v.const, (str, bool)):
                return V.literal(-v.const)
            return Value(-V.number(v), V.DEC if v.kind == V.DEC else V.INT, None, False)
        return self.postfix()

    def postfix(self) -> Value:
        v = self.primary()
        while op := self.take(".", "?.", "["):
            if op == "[":
                low = self.either()
                if self.take(".."):
                    high = self.either()
                    a, n = F.greatest(low.col, F.lit(0)), F.size(v.col)
                    v = Value(F.slice(v.col, (a + 1).cast("int"), F.greatest(F.least(high.col, n) - a, F.lit(0)).cast("int")), V.LIST, v.item)
                elif v.kind == V.LIST:
                    v = Value(F.element_at(v.col, F.when(low.col >= 0, low.col + 1).otherwise(low.col).cast("int")), v.item or V.TEXT)
                else:
                    v = self.field(v, low.const)
                self.need("]")
            else:
                v = self.field(v, self.name())
        return v

    def field(self, v: Value, name: str) -> Value:
        if v.kind != V.MAP:
            return V.literal(None)
        return Value(v.col.getField(name), self.nested(v).get(name, V.TEXT))

    def nested(self, v: Value) -> dict[str, str]:
        return {f.name: V.kind_of(f.dataType) for s in self.schema.fields if isinstance(s.dataType, T.StructType) for f in s.dataType.fields}

    def name(self) -> str:
        kind, t = self.tokens[self.i]
        if kind not in ("name", "word"):
            raise SyntaxError(f"a name is missing before {t!r}")
        self.i += 1
        return t

    def primary(self) -> Value:
        kind, t = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return V.literal(float(t) if re.search(r"[.eE]", t) else int(t))
        if kind == "text":
            return V.literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if kind == "name":
            if t in CONSTANTS:
                return V.literal(CONSTANTS[t])
            if t in ROW and self.tokens[self.i][1] in (".", "?.", "["):
                if self.take("["):
                    v = V.column(self.either().const, self.schema)
                    self.need("]")
                    return v
                self.take(".", "?.")
                return V.column(self.name(), self.schema)
            if t in self.functions and self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
                return self.functions[t](*args)
            return V.column(t, self.schema)
        if t == "(":
            v = self.either()
            self.need(")")
            return v
        if t == "[":
            items = []
            while not self.take("]"):
                items.append(self.either())
                self.take(",")
            return V.literal([i.const for i in items]) if all(i.const is not None for i in items) else Value(F.array(*(i.col for i in items)), V.LIST, items[0].kind, False)
        raise SyntaxError(f"unexpected {t!r}")


def compile_value(text: str, schema: T.StructType, functions: dict[str, Callable[..., Value]] | None = None) -> Value:
    p = _Parser(text, schema, FUNCTIONS | (functions or {}))
    v = p.either()
    if p.tokens[p.i][0] != "end":
        raise SyntaxError(f"unexpected {p.tokens[p.i][1]!r}")
    return v


def predicate(text: str, schema: T.StructType, functions: dict[str, Callable[..., Value]] | None = None) -> Column:
    return V.truthy(compile_value(text, schema, functions))
