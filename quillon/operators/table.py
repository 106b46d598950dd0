"""The table algebra: a Table wraps a DataFrame and gives each operation its defined result.

Order is observable (groups come in order of first appearance, sorts are stable, distinct keeps the
first row), so operations that need it add an ordinal of the current row order. Nothing else does, which
leaves filters free to reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.expressions import compile_value, predicate
from ..sources.shared import written

ORD = "__ord"
AGGREGATES = {"count": "count", "contar": "count", "sum": "sum", "somar": "sum", "mean": "mean", "media": "mean", "min": "min", "max": "max"}


class Table:
    def __init__(self, df: DataFrame, functions: Mapping | None = None, order: list[Column] | None = None):
        self.df, self.functions, self.order = df, dict(functions or {}), order

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[Mapping], schema: str | None = None) -> Table:
        rows = [dict(r) for r in rows]
        names = list(dict.fromkeys(k for r in rows for k in r))
        return cls(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema or names))

    def _with(self, df: DataFrame, order: list[Column] | None = None) -> Table:
        return Table(df, self.functions, order)

    def _ordered(self) -> DataFrame:
        return self.df.withColumn(ORD, F.monotonically_increasing_id())

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def filter(self, condition: str | Column) -> Table:
        c = predicate(condition, self.df.schema, self.functions) if isinstance(condition, str) else condition
        return self._with(self.df.filter(c), self.order)

    def derive(self, columns: Mapping[str, str | Column]) -> Table:
        """Adds or replaces columns; every expression sees the original row; a replaced column keeps its place."""
        new = {k: compile_value(v, self.df.schema, self.functions).col if isinstance(v, str) else v for k, v in columns.items()}
        return self._with(self.df.withColumns(new))

    map = derive

    def select(self, *names: str) -> Table:
        """Columns in this order; unknown names are dropped."""
        return self._with(self.df.select(*(F.col(f"`{n}`") for n in dict.fromkeys(names) if n in self.df.columns)))

    def group_by(self, key: str, aggregates: Mapping[str, str | tuple[str, str]]) -> Table:
        """One group for each display text of the key; '' groups all rows, under `grupo`. aggregates: name to 'count' or
        (function, column). Nulls and texts count as 0, also in means and extremes. Groups come in order of appearance."""
        schema = self.df.schema
        name = key or "grupo"
        k = F.lit("") if not key else V.display(V.column(key, schema)) if key in self.df.columns else F.lit("")
        out = []
        for alias, spec in aggregates.items():
            function, *column = (spec,) if isinstance(spec, str) else spec
            if function not in AGGREGATES:
                raise ValueError(f"no aggregate {function!r}")
            function = AGGREGATES[function]
            if function == "count":
                out.append(F.count(F.lit(1)).alias(alias))
                continue
            x = V.number(V.column(column[0], schema))
            out.append({"sum": F.sum(x), "mean": F.sum(x).cast("double") / F.count(F.lit(1)), "min": F.min(x), "max": F.max(x)}[function].alias(alias))
        d = self._ordered().groupBy(k.alias(name)).agg(*out, F.min(ORD).alias(ORD))
        return self._with(d.orderBy(ORD).drop(ORD))

    def distinct(self, column: str | None = None) -> Table:
        """The first row of each display text of the whole row, or of a column."""
        schema = self.df.schema
        of = [column] if column else self.df.columns
        keys = [V.display(V.column(c, schema)) if c in self.df.columns else F.lit("") for c in of]
        d = self._ordered().groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*self.df.columns), ORD).alias("r"), F.min(ORD).alias(ORD))
        return self._with(d.orderBy(ORD).select("r.*"))

    def sort(self, column: str, desc: bool = False) -> Table:
        """Stable. A null sorts as the text of null: after all numbers, and among texts."""
        v = V.column(column, self.df.schema)
        if v.kind in V.NUMERIC:
            key = v.col.desc_nulls_first() if desc else v.col.asc_nulls_last()
        else:
            key = V.display(v).desc() if desc else V.display(v).asc()
        return self._with(self._ordered().orderBy(key, ORD).drop(ORD))

    def limit(self, n: int) -> Table:
        return self._with(self.df.limit(max(int(n), 0)))

    first = limit

    def count(self) -> int:
        return self.df.count()

    # sampling, splits, shards: by row number, which repeats exactly

    def _numbered(self) -> DataFrame:
        """Row numbers 0, 1, ... in the current order: counts by partition are added up, so no task sees all rows.

        The rows are written once, each with its partition's number, and both the counts and the result read that: two
        runs of a plan needn't cut its rows into the same partitions (a sort samples its bounds anew)."""
        d = written(self.df.withColumn(ORD, F.monotonically_increasing_id()), "numbered")
        part = F.shiftright(ORD, 33)
        sizes = sorted(d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first")).collect(), key=lambda r: r["p"])  # one row a partition
        base, total = [], 0
        for r in sizes:
            base.append((r["p"], total - r["first"]))
            total += r["n"]
        shift = self.df.sparkSession.createDataFrame(base or [(-1, 0)], "__part long, __shift long")
        shift = F.broadcast(shift) if len(base) < 1 << 20 else shift
        return d.withColumn("__part", part).join(shift, "__part").withColumn(ORD, F.col(ORD) + F.col("__shift")).drop("__part", "__shift")

    def shard(self, n: int, k: int) -> Table:
        return self._with(self._numbered().where(F.pmod(F.col(ORD), F.lit(n)) == k).orderBy(ORD).drop(ORD))

    def fold(self, n: int, k: int) -> tuple[Table, Table]:
        """Train and test tables of fold k of n."""
        d = self._numbered()
        test = F.pmod(F.col(ORD), F.lit(n)) == k
        return self._with(d.where(~test).orderBy(ORD).drop(ORD)), self._with(d.where(test).orderBy(ORD).drop(ORD))

    def split(self, share: float = 0.8, seed: int = 42) -> tuple[Table, Table]:
        """A random but repeatable split by a hash of row number and seed."""
        d = self._numbered().withColumn("__u", F.pmod(F.xxhash64(F.col(ORD), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
        return self._with(d.where("__u").orderBy(ORD).drop(ORD, "__u")), self._with(d.where("not __u").orderBy(ORD).drop(ORD, "__u"))

    def sample(self, n: int, by: str | None = None, seed: int = 42) -> Table:
        """n rows by least hash of row number and seed; with `by`, quotas in proportion to its groups (largest remainders)."""
        d = self._numbered().withColumn("__u", F.xxhash64(F.col(ORD), F.lit(seed)))
        if not by:
            return self._with(d.orderBy("__u", ORD).limit(n).orderBy(ORD).drop(ORD, "__u"))
        key = V.display(V.column(by, self.df.schema))
        d = d.withColumn("__k", key)
        sizes = d.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
        total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
        # whole quotas, then one more for the largest remainders; all of it by group, however many there are
        exact = F.lit(n).cast("decimal(20,0)") * F.col("__n") / F.lit(max(total, 1)).cast("decimal(20,0)")
        sizes = sizes.withColumn("__q", F.floor(exact).cast("long")).withColumn("__r", exact - F.col("__q"))
        left = min(n, total) - (sizes.agg(F.coalesce(F.sum("__q"), F.lit(0))).first()[0])
        more = sizes.orderBy(F.desc("__r"), "__k").limit(max(left, 0)).select(F.col("__k").alias("__k2"))
        quota = sizes.join(more, sizes["__k"] == more["__k2"], "left").select("__k", (F.col("__q") + F.col("__k2").isNotNull().cast("long")).alias("__q"))
        # a first cut by hash keeps the ranked rows few: the least that is sure to hold the quota is found by counts of hash ranges
        low = F.pmod(F.shiftrightunsigned("__u", 44), F.lit(1 << 20))
        ranges = d.groupBy("__k", low.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
        reached = ranges.withColumn("__s", F.sum("__n").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))
        cut = reached.join(quota, "__k").where(F.coalesce("__s", F.lit(0)) < F.col("__q")).groupBy("__k").agg(F.max("__b").alias("__most"), F.max("__q").alias("__q"))
        near = d.withColumn("__b", low).join(cut, "__k").where("__b <= __most")
        ranked = near.withColumn("__i", F.row_number().over(W.partitionBy("__k").orderBy("__b", "__u", ORD))).where("__i <= __q")
        return self._with(ranked.orderBy(ORD).select(*(F.col(f"`{c}`") for c in self.df.columns)))

    # beyond the row algebra

    def join(self, other: Table, on: str | list[str], how: str = "inner") -> Table:
        return self._with(self.df.join(other.df, on, how))

    def union(self, other: Table) -> Table:
        """Rows of both, by name; what one lacks is null."""
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    # the second names
    filtrar, derivar, mapear, selecionar, agrupar_por, distinto, ordenar_por, limite, primeiros, amostra = filter, derive, derive, select, group_by, distinct, sort, limit, limit, sample
    tamanho = count
