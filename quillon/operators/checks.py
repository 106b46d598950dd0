"""Data quality: not-null, unique and row rules with a bounded report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.expressions import predicate
from .table import ORD, Table

NOTES = 5


class Violation(Exception):
    """A rule failed and the table was to be refused."""


def violations(table: Table, not_null: list[str] = (), unique: str | None = None, rule: str | None = None) -> DataFrame:
    """(rule_no, rule, column, row) of each violation, rows from 1 in the current order."""
    d = table._numbered()
    parts = []
    for i, c in enumerate(not_null):
        bad = F.col(f"`{c}`").isNull() if c in table.columns else F.lit(True)
        parts.append(d.where(bad).select(F.lit(i).alias("rule_no"), F.lit("not_null").alias("rule"), F.lit(c).alias("column"), (F.col(ORD) + 1).alias("row")))
    if unique:
        k = V.display(V.column(unique, table.df.schema)) if unique in table.columns else F.lit("")
        keyed = d.select(k.alias("k"), ORD)
        first = keyed.groupBy("k").agg(F.min(ORD).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(keyed.join(first, "k").where(F.col(ORD) > F.col("first")).select(F.lit(1000).alias("rule_no"), F.lit("unique").alias("rule"), F.lit(unique).alias("column"), (F.col(ORD) + 1).alias("row")))
    if rule:
        parts.append(d.where(~predicate(rule, table.df.schema, table.functions)).select(F.lit(1001).alias("rule_no"), F.lit("rule").alias("rule"), F.lit(rule).alias("column"), (F.col(ORD) + 1).alias("row")))
    if not parts:
        raise ValueError("no rule")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def verify(table: Table, not_null: list[str] = (), unique: str | None = None, rule: str | None = None, on_violation: str = "abort") -> list[str]:
    """The first notes (at most 5, then "5+"), in order of rule and row; raises Violation unless only to warn."""
    found = violations(table, not_null, unique, rule).orderBy("rule_no", "row").limit(NOTES + 1).collect()
    notes = [f"row {r['row']}: {r['rule']} {r['column']}" for r in found[:NOTES]]
    if found and on_violation in ("abort", "abortar"):
        n = f"{NOTES}+" if len(found) > NOTES else str(len(found))
        raise Violation(f"{n} violations\n" + "\n".join(notes))
    return notes


def quarantined(table: Table, rule: str, path: str) -> Table:
    """Rows that meet the rule; the others are appended as JSON lines under path."""
    ok = predicate(rule, table.df.schema, table.functions)
    bad = table.df.where(~ok)
    bad.select(F.struct(*bad.columns).alias("linha"), F.lit(f"not: {rule}").alias("erro")).write.mode("append").json(path)
    return table.filter(ok)
