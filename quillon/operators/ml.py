"""Classic machine learning: preparation, models and measures, fitted by aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .tensors import argmax, softmax


@dataclass
class Preparation:
    """Fitted on training rows only: filled values, one-hot categories in order of appearance, mean and population deviation."""

    fill: dict[str, object] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, impute: list[str] = (), one_hot: list[str] = (), standardise: list[str] = ()) -> Preparation:
        p = cls()
        d = df.withColumn("__ord", F.monotonically_increasing_id())
        numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
        if means := [c for c in impute if c in numeric]:
            r = d.agg(*(F.avg(c).alias(c) for c in means)).first()
            p.fill |= {c: r[c] for c in means}
        for c in (c for c in impute if c not in numeric):
            r = d.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("__ord").alias("o")).orderBy(F.desc("n"), "o").first()
            p.fill[c] = r[c] if r else None
        filled = d.fillna({k: v for k, v in p.fill.items() if v is not None})
        for c in one_hot:
            rows = filled.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias(c)).agg(F.min("__ord").alias("o")).orderBy("o").collect()
            if len(rows) < 2:
                raise ValueError(f"{c} has fewer than two categories")
            p.categories[c] = [r[c] for r in rows]
        if standardise:
            r = filled.agg(*(f(c).alias(f"{k}_{c}") for c in standardise for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
            p.scale = {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in standardise}
        return p

    def transform(self, df: DataFrame) -> DataFrame:
        d = df.fillna({k: v for k, v in self.fill.items() if v is not None})
        for c, (m, s) in self.scale.items():
            d = d.withColumn(c, (F.col(c) - m) / s)
        for c, values in self.categories.items():
            x = F.col(c).cast("string")
            d = d.withColumns({f"{c}={v}": F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values}).drop(c)
        return d


@dataclass
class LinearRegression:
    """Normal equations with a small ridge; the Gram matrix is one aggregation."""

    features: list[str]
    weights: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, label: str) -> LinearRegression:
        xs = [F.lit(1.0), *(F.col(c).cast("double") for c in self.features)]
        y = F.col(label).cast("double")
        n = len(xs)
        r = df.agg(*(F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(xs[i] * y).alias(f"v{i}") for i in range(n))).first()
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        self.weights = np.linalg.solve(g + 1e-8 * np.eye(n), [r[f"v{i}"] for i in range(n)]).tolist()
        return self

    def predict(self) -> Column:
        out = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], self.features, strict=True):
            out = out + w * F.col(c)
        return out


@dataclass
class LogisticRegression:
    """Two classes; full-batch gradient descent, each step one aggregation over standardised features."""

    features: list[str]
    steps: int = 100
    rate: float = 0.5
    weights: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, label: str) -> LogisticRegression:
        p = Preparation.fit(df, standardise=self.features)
        d = p.transform(df.select(*(F.col(c).cast("double").alias(c) for c in self.features), F.col(label).cast("double").alias("__y"))).cache()
        w = np.zeros(len(self.features) + 1)
        n = d.count()
        for _ in range(self.steps):
            z = F.lit(float(w[0]))
            for x, c in zip(w[1:], self.features, strict=True):
                z = z + float(x) * F.col(c)
            e = 1 / (1 + F.exp(-z)) - F.col("__y")
            r = d.agg(F.sum(e).alias("b"), *(F.sum(e * F.col(c)).alias(f"w_{c}") for c in self.features)).first()
            w -= self.rate * np.array([r["b"], *(r[f"w_{c}"] for c in self.features)]) / n
        d.unpersist()
        raw = [w[i + 1] / p.scale[c][1] for i, c in enumerate(self.features)]
        self.weights = [float(w[0] - sum(x * p.scale[c][0] for x, c in zip(raw, self.features, strict=True))), *map(float, raw)]
        return self

    def probability(self) -> Column:
        z = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], self.features, strict=True):
            z = z + w * F.col(c)
        return 1 / (1 + F.exp(-z))


@dataclass
class SoftmaxRegression:
    """Any number of classes; full-batch gradient descent, each step one aggregation over standardised features."""

    features: list[str]
    steps: int = 100
    rate: float = 0.5
    most_classes: int = 1000
    classes: list = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def fit(self, df: DataFrame, label: str) -> SoftmaxRegression:
        found = df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(self.most_classes + 1).collect()
        if not 2 <= len(found) <= self.most_classes:
            raise ValueError(f"{label} must have 2 to {self.most_classes} classes")
        self.classes = [r[0] for r in found]
        p = Preparation.fit(df, standardise=self.features)
        d = p.transform(df.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in self.features), F.col(label).alias("__y"))).cache()
        w = np.zeros((len(self.classes), len(self.features) + 1))
        n = d.count()
        xs = [F.lit(1.0), *(F.col(c) for c in self.features)]
        for _ in range(self.steps):
            scored = d.withColumn("__p", self._chances(w))
            sums = [F.sum((F.get("__p", F.lit(k)) - (F.col("__y") == F.lit(c)).cast("double")) * x).alias(f"g{k}_{i}") for k, c in enumerate(self.classes) for i, x in enumerate(xs)]
            w -= self.rate * np.array(scored.agg(*sums).first()).reshape(w.shape) / n
        d.unpersist()
        scale = np.array([p.scale[c] for c in self.features])
        raw = w[:, 1:] / scale[:, 1]
        self.weights = np.column_stack([w[:, 0] - raw @ scale[:, 0], raw]).tolist()
        return self

    def _chances(self, w) -> Column:
        z = F.array(*(sum((float(x) * F.col(c) for x, c in zip(row[1:], self.features, strict=True)), F.lit(float(row[0]))) for row in w))
        return softmax(z)

    def probabilities(self) -> Column:
        return self._chances(self.weights)

    def predict(self) -> Column:
        """The most probable class; ties to the first."""
        return F.get(F.array(*map(F.lit, self.classes)), argmax(self.probabilities()).cast("int"))


@dataclass
class Loaded:
    """Examples for training: x (array of float, a value for each attribute) and y (int)."""

    df: DataFrame
    attributes: list[str]

    def batches(self, size: int = 1024):
        """(x, y) as numpy arrays, one partition after the other: nothing is gathered as a whole."""
        x, y = [], []
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            x.append(r["x"])
            y.append(r["y"])
            if len(y) == size:
                yield np.array(x, dtype=np.float32), np.array(y)
                x, y = [], []
        if y:
            yield np.array(x, dtype=np.float32), np.array(y)


def loader(spark, path: str, target: str) -> Loaded:
    """A CSV or Parquet file as examples; what is missing counts as 0."""
    from ..sources import files

    df = files.read_parquet(spark, path) if path.endswith(".parquet") else files.read_csv(spark, path)
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    names = [c for c in df.columns if c != target]
    bad = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    x = F.array(*(F.coalesce(F.col(f"`{c}`").cast("float"), F.lit(0.0).cast("float")) for c in names))
    return Loaded(df.select(x.alias("x"), F.coalesce(F.col(f"`{target}`").cast("int"), F.lit(0)).alias("y")), names)


def knn(train: DataFrame, queries: DataFrame, features: list[str], label: str, query_id: str, k: int = 5, block: int = 1 << 14) -> DataFrame:
    """(query_id, label): majority of the k nearest by Euclid on standardised features; ties to the least label.

    Queries are a stated set: blocks of bounded size go to the executors, the training rows stay where they are,
    and each task keeps only its k best per query."""
    p = Preparation.fit(train, standardise=features)
    t = p.transform(train).select(*(F.col(c).cast("double") for c in features), F.col(label).cast("string").alias("__y"))
    rows = p.transform(queries).select(F.col(query_id).cast("long"), *(F.col(c).cast("double") for c in features)).toLocalIterator()
    out = None
    part: list = []

    def against(block_rows: list) -> DataFrame:
        ids = np.array([r[0] for r in block_rows], dtype=np.int64)
        q = np.array([[*r[1:]] for r in block_rows], dtype=float)

        def run(batches):
            best_d, best_y = np.full((len(q), 0), np.inf), np.empty((len(q), 0), dtype=object)
            for b in batches:
                x, y = b[features].to_numpy(dtype=float), b["__y"].to_numpy(dtype=object)
                for s in range(0, len(x), 4096):
                    d = ((q**2).sum(1)[:, None] + (x[s : s + 4096] ** 2).sum(1)[None] - 2 * q @ x[s : s + 4096].T).clip(0)
                    best_d, best_y = np.hstack([best_d, d]), np.hstack([best_y, np.broadcast_to(y[s : s + 4096], d.shape)])
                    at = np.argsort(best_d, axis=1, kind="stable")[:, :k]
                    best_d, best_y = np.take_along_axis(best_d, at, 1), np.take_along_axis(best_y, at, 1)
            import pandas as pd

            m = best_d.shape[1]
            yield pd.DataFrame({"q": np.repeat(ids, m), "d": best_d.ravel(), "y": best_y.ravel()})

        return t.mapInPandas(run, "q long, d double, y string")

    for r in rows:
        part.append(r)
        if len(part) == block:
            out = against(part) if out is None else out.union(against(part))
            part = []
    if part or out is None:
        out = against(part) if out is None else out.union(against(part))
    nearest = out.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y"))), 1, k).alias("n"))
    votes = nearest.select("q", F.explode("n").alias("n")).groupBy("q", F.col("n.y").alias("y")).count()
    return votes.groupBy(F.col("q").alias(query_id)).agg(F.min_by("y", F.struct(-F.col("count"), "y")).alias(label))


def vector_model(name: str, features: list[str], label: str | None = None, **options):
    """kmeans, forest, boosting or svm as a pipeline of pyspark.ml."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    stage = {
        "kmeans": lambda: KMeans(featuresCol="__x", maxIter=100, initMode="random", **options),
        "forest": lambda: RandomForestClassifier(featuresCol="__x", labelCol=label, **({"numTrees": 50, "maxDepth": 8, "featureSubsetStrategy": "sqrt"} | options)),
        "boosting": lambda: GBTClassifier(featuresCol="__x", labelCol=label, **({"maxIter": 50, "maxDepth": 3, "stepSize": 0.1} | options)),
        "svm": lambda: LinearSVC(featuresCol="__x", labelCol=label, **options),
    }[name]()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), stage])


def accuracy(df: DataFrame, real: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.col(real).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, real: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def weighted_f1(df: DataFrame, real: str, predicted: str) -> DataFrame:
    c = confusion(df, real, predicted)
    rows = c.groupBy(F.col("real").alias("k")).agg(F.sum("n").alias("support"))
    cols = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("called"))
    hits = c.where("real = predicted").select(F.col("real").alias("k"), F.col("n").alias("hit"))
    per = rows.join(cols, "k", "left").join(hits, "k", "left").fillna(0, ["called", "hit"])
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("support") + F.col("called"))).otherwise(0.0)
    return per.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def auc(df: DataFrame, real: str, score: str) -> DataFrame:
    """Mann-Whitney over distinct scores, ties a half. Counts by score are aggregated and sorted into written ranges; the
    running sum goes on from the ranges' totals, so no task sees all scores."""
    from pyspark.sql import Window

    g = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(real) == 1).cast("long")).alias("p"), F.sum((F.col(real) != 1).cast("long")).alias("n"))
    g = written(g.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    totals = sorted((r["part"], r["n"]) for r in g.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a range
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    g = g.join(F.broadcast(df.sparkSession.createDataFrame(offsets or [(-1, 0)], "part int, offset long")), "part")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("offset")
    g = g.withColumn("w", F.col("p") * (before + F.col("n") / 2))
    return g.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def regression_measures(df: DataFrame, real: str, predicted: str) -> DataFrame:
    e = F.col(real).cast("double") - F.col(predicted)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(F.col(real)) * F.count(F.lit(1)))).alias("r2"))


def evaluate(df: DataFrame, expected: str, got: str, metric: str = "exact", tolerance: float = 0.0) -> DataFrame:
    """(n, passed, score) of an evaluation by exact, contains, regex or tolerance."""
    a, b = F.col(expected), F.col(got)
    ok = {"exact": lambda: a.eqNullSafe(b), "contains": lambda: F.contains(b, a), "regex": lambda: F.regexp(b, a), "tolerance": lambda: F.abs(a - b) <= tolerance}[metric]()
    p = F.coalesce(ok, F.lit(False)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("passed"), F.avg(p.cast("double")).alias("score"))


class BelowThreshold(Exception):
    """An evaluation's score is under its threshold."""


def gated(df: DataFrame, expected: str, got: str, metrics: dict[str, float], tolerance: float = 0.0, judge=None) -> dict[str, float]:
    """The score of each metric, with its least score to pass, in one pass; raises BelowThreshold if one doesn't. The
    metric "judge" takes its verdicts (0 to 1) from judge(expected, got), a column."""
    names = list(metrics)
    a, b = F.col(expected), F.col(got)
    ok = {"exact": lambda: a.eqNullSafe(b), "contains": lambda: F.contains(b, a), "regex": lambda: F.regexp(b, a), "tolerance": lambda: F.abs(a - b) <= tolerance, "judge": lambda: judge(a, b)}
    row = df.agg(*(F.coalesce(F.avg(F.coalesce(ok[m]().cast("double"), F.lit(0.0))), F.lit(0.0)).alias(m) for m in names)).first()
    scores = {m: row[m] for m in names}
    low = [f"{m}: {scores[m]:.4f} < {metrics[m]}" for m in names if scores[m] < metrics[m]]
    if low:
        raise BelowThreshold(", ".join(low))
    return scores
