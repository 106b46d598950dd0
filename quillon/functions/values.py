"""Value semantics as Column expressions.

Logic is two-valued, null counts as 0 in arithmetic, x / 0 is 0, and texts of values follow one display
form. A Value is a Column with its kind, so that each rule is chosen when the plan is built and the plan
holds only built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOL, INT, DEC, TEXT, LIST, MAP = "null", "bool", "int", "dec", "text", "list", "map"
NUMERIC = (BOOL, INT, DEC)


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    item: str | None = None  # kind of a list's items
    nullable: bool = True
    const: object = None  # of a literal


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.IntegralType):
        return INT
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return DEC
    if isinstance(t, T.ArrayType):
        return LIST
    if isinstance(t, (T.StructType, T.MapType)):
        return MAP
    return NULL if isinstance(t, T.NullType) else TEXT


def column(name: str, schema: T.StructType) -> Value:
    """The column of that name; dates and times count as their ISO text; an absent column is null."""
    for f in schema.fields:
        if f.name == name:
            kind = kind_of(f.dataType)
            c = F.col(f"`{name}`")
            if isinstance(f.dataType, T.DecimalType):
                c = c.cast("double")
            elif kind == TEXT and not isinstance(f.dataType, T.StringType):
                c = c.cast("string")
            return Value(c, kind, kind_of(f.dataType.elementType) if kind == LIST else None, f.nullable)
    return literal(None)


def literal(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), NULL)
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, None, False, x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), INT, None, False, x)
    if isinstance(x, float):
        return Value(F.lit(x), DEC, None, False, x)
    if isinstance(x, str):
        return Value(F.lit(x), TEXT, None, False, x)
    if isinstance(x, (list, tuple)):
        items = [literal(i) for i in x]
        kinds = {i.kind for i in items} - {NULL}
        kind = DEC if kinds == {INT, DEC} else next(iter(kinds), NULL)
        if len(kinds) > 1 and kind != DEC:
            raise TypeError("a list needs items of one kind")
        return Value(F.array(*(i.col.cast("double") if kind == DEC else i.col for i in items)), LIST, kind, False)
    raise TypeError(f"no literal of {type(x).__name__}")


def truthy(v: Value) -> Column:
    c = v.col
    if v.kind == BOOL:
        return F.coalesce(c, F.lit(False)) if v.nullable else c
    if v.kind in (INT, DEC):
        return F.coalesce(c, F.lit(0)) != 0
    if v.kind == TEXT:
        return F.coalesce(c, F.lit("")) != ""
    if v.kind == LIST:
        return F.coalesce(F.size(c), F.lit(0)) > 0
    return c.isNotNull() if v.kind == MAP else F.lit(False)


def number(v: Value) -> Column:
    """As a number: null, texts and lists are 0, true is 1."""
    if v.kind == BOOL:
        return F.coalesce(v.col.cast("long"), F.lit(0).cast("long"))
    if v.kind in (INT, DEC):
        c = v.col.cast("long") if v.kind == INT else v.col.cast("double")
        return F.coalesce(c, F.lit(0).cast("long") if v.kind == INT else F.lit(0.0)) if v.nullable else c
    return F.lit(0).cast("long")


def _significant(c: Column) -> Column:
    """A double as C's %g prints it: six significant digits, without trailing zeros."""
    text = F.format_string("%.5e", c)  # rounds to six digits, so its exponent is that after rounding
    exponent = F.try_element_at(F.split(text, "e"), F.lit(2)).cast("int")
    trim = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    fixed = F.format_string("%.5f", c)
    for places in range(10):
        if places != 5:
            fixed = F.when(exponent == 5 - places, F.format_string(f"%.{places}f", c)).otherwise(fixed)
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"))
    scientific = F.concat(trim(F.substring_index(text, "e", 1)), power)
    finite = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(trim(fixed))
    return F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).otherwise(finite)


def display(v: Value) -> Column:
    """The text of a value."""
    c = v.col
    if v.kind == NULL:
        return F.lit("nulo")
    if v.kind == BOOL:
        out = F.when(c, F.lit("verdadeiro")).otherwise(F.lit("falso"))
    elif v.kind == INT:
        out = c.cast("string")
    elif v.kind == DEC:
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        out = F.when(whole, F.format_string("%d", F.when(whole, c).otherwise(F.lit(0.0)).cast("long"))).otherwise(_significant(c))
    elif v.kind == TEXT:
        out = c
    elif v.kind == LIST:
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: display(Value(x, v.item or TEXT))), ", "), F.lit("]"))
    else:
        out = F.to_json(c)
    return F.when(c.isNull(), F.lit("nulo")).otherwise(out) if v.nullable else out


def equal(a: Value, b: Value) -> Column:
    if a.kind == MAP or b.kind == MAP:
        return F.lit(False)
    if a.kind == NULL or b.kind == NULL:
        return F.lit(True) if a.kind == b.kind else (b if a.kind == NULL else a).col.isNull()
    if a.kind in (INT, DEC) and b.kind in (INT, DEC):
        x, y = (a.col, b.col) if a.kind == b.kind else (a.col.cast("double"), b.col.cast("double"))
        same = x == y if b.const is not None and not a.nullable else x.eqNullSafe(y)
        return same & ~F.coalesce(F.isnan(x), F.lit(False)) if DEC in (a.kind, b.kind) else same
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col)


def compare(op: str, a: Value, b: Value) -> Column:
    """<, <=, >, >=. Two texts compare by bytes, all else as numbers."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f = ops[op]
    if a.kind == TEXT and b.kind == TEXT:
        nothing = F.lit(op in ("<=", ">="))
        return F.when(a.col.isNull() | b.col.isNull(), nothing).otherwise(f(a.col, b.col)) if a.nullable or b.nullable else f(a.col, b.col)
    if a.kind in (INT, DEC) and b.const is not None and not isinstance(b.const, str) and _false_at_zero(op, b.const):
        return f(a.col, b.col)  # null would compare as 0 and be false: the bare form reaches the scan
    return f(number(a), number(b))


def _false_at_zero(op: str, k) -> bool:
    return {"<": k <= 0, "<=": k < 0, ">": k >= 0, ">=": k > 0}[op]


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and a.kind == LIST and b.kind == LIST:
        return Value(F.concat(a.col, b.col), LIST, a.item, a.nullable or b.nullable)
    if op == "+" and TEXT in (a.kind, b.kind):
        return Value(F.concat(display(a), display(b)), TEXT, None, False)
    if op == "|":
        return Value(F.concat(display(a), F.lit(" | "), display(b)), TEXT, None, False)
    x, y = number(a), number(b)
    whole = DEC not in (a.kind, b.kind)
    if op == "/":
        return Value(F.when(y == 0, F.lit(0.0)).otherwise(x.cast("double") / F.when(y == 0, F.lit(1)).otherwise(y)), DEC, None, False)
    if op == "%":
        zero = F.lit(0).cast("long") if whole else F.lit(0.0)
        return Value(F.when(y == 0, zero).otherwise(x % F.when(y == 0, F.lit(1)).otherwise(y)), INT if whole else DEC, None, False)
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
    return Value(out, INT if whole else DEC, None, False)


def contains(a: Value, b: Value) -> Column:
    if a.kind == TEXT and b.kind == TEXT:
        return F.coalesce(F.contains(a.col, b.col), F.lit(False))
    if a.kind == LIST:
        return F.coalesce(F.exists(a.col, lambda x: equal(Value(x, a.item or TEXT), b)), F.lit(False))
    return F.lit(False)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_text(c: Column, separator: str) -> Column:
    """Pieces between a literal separator, empty ones kept; an empty separator leaves the text whole."""
    return F.split(c, "\\Q" + separator + "\\E", -1) if separator else F.array(c)


def chunks(c: Column, size: int = 800, overlap: int = 100) -> Column:
    """Windows of `size` characters that step by size - overlap until the end is covered."""
    step = max(size - overlap, 1)
    n = F.length(c)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * step + 1, F.lit(size)))
