import json
import math
import os
import struct
from datetime import datetime
from urllib.parse import unquote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import values as V
from quillon.functions.expressions import compile_value
from quillon.operators import checks, documents, ml, tensors, vectors
from quillon.operators.table import Table
from quillon.sources import bitmaps, delta, files, registry, sql, zorder
from quillon.streaming import schedule, windows


def rows(t):
    return [tuple(r) for r in (t.df if isinstance(t, Table) else t).collect()]


def value(spark, text, **row):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items()) or "z int"
    df = spark.createDataFrame([tuple(row.values()) or (0,)], schema)
    return df.select(compile_value(text, df.schema).col.alias("v")).first()[0]


def test_filter_and_group(spark):
    t = Table.of(spark, [{"cat": "a", "n": 1}, {"cat": "a", "n": 3}, {"cat": "b", "n": 5}, {"cat": "b", "n": 2}])
    assert rows(t.filtrar("linha.n >= 2").agrupar_por("cat", {"total": ("somar", "n"), "k": "contar"})) == [("a", 3, 1), ("b", 7, 2)]


def test_sort_limit_distinct(spark):
    t = Table.of(spark, [{"k": "x", "v": 10}, {"k": "y", "v": 30}, {"k": "z", "v": 20}, {"k": "w", "v": 5}])
    assert rows(t.sort("v", desc=True).limit(2)) == [("y", 30), ("z", 20)]
    assert rows(t.limit(-1)) == []
    d = Table.of(spark, [{"a": 1, "b": "p"}, {"a": 1, "b": "q"}, {"a": 2, "b": "p"}])
    assert rows(d.distinct("a")) == [(1, "p"), (2, "p")]
    n = Table.of(spark, [{"v": 2}, {"v": None}, {"v": 1}], "v bigint")
    assert rows(n.sort("v")) == [(1,), (2,), (None,)]


def test_groups_come_by_appearance_and_by_display(spark):
    t = Table.of(spark, [{"k": 2, "v": 1}, {"k": None, "v": None}, {"k": 1, "v": 4}, {"k": 2, "v": 2}], "k bigint, v bigint")
    assert rows(t.group_by("k", {"m": ("mean", "v"), "lo": ("min", "v")})) == [("2", 1.5, 1), ("nulo", 0.0, 0), ("1", 4.0, 4)]
    assert rows(t.filter("v > 99").group_by("", {"n": "count"})) == []


@pytest.mark.parametrize(("text", "row", "want"), [
    ("x + 1", {"x": None}, 1), ("7 / 0", {}, 0.0), ("-7 % 3", {}, -1), ("x % 0", {"x": 5}, 0), ('"a" + 1.5', {}, "a1.5"), ("not x", {"x": 0}, True),
    ("x == y", {"x": None, "y": None}, True), ("x == 1.0", {"x": 1}, True), ('x < "b"', {"x": "a"}, True), ("null == null", {}, True), ('1 == "1"', {}, False),
    ("[1, 2] contem 2", {}, True), ("soma", {}, None), ('dividir("a,,b", ",")', {}, ["a", "", "b"]), ("[1, 2, 3][-1]", {}, 3), ("[1, 2, 3][1..9]", {}, [2, 3]),
    ("x > 1 or x < 1", {"x": None}, True), ("media([1, 2])", {}, 1.5), ('"a" | "b"', {}, "a | b"), ("verdadeiro + \"\"", {}, "verdadeiro"),
])
def test_value_rules(spark, text, row, want):
    assert value(spark, text, **row) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=1, max_size=30))
def test_display_of_doubles(spark, xs):
    def shown(x):
        return str(int(x)) if math.isfinite(x) and x == math.floor(x) and abs(x) < 1e15 else "%g" % x

    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(V.display(V.column("x", df.schema)).alias("v")).collect()]
    for x, g in zip(xs, got, strict=True):
        # the JVM rounds halves up and C to even, on digits beyond the sixth: both are within half a unit
        assert g == shown(x) or abs(float(g) - x) <= abs(x) * 5.0000001e-6


def test_derive_is_simultaneous_and_pushes_filters(spark, tmp_path):
    t = Table.of(spark, [{"a": 1, "b": 2}])
    assert rows(t.derive({"a": "b", "b": "a", "c": "a + b"})) == [(2, 1, 3)]
    t.df.write.parquet(str(tmp_path / "p"))
    plan = Table(spark.read.parquet(str(tmp_path / "p"))).filter("a > 0").df._jdf.queryExecution().toString()
    assert "GreaterThan(a,0)" in plan


def test_checks(spark, tmp_path):
    t = Table.of(spark, [{"id": 1, "cat": "a", "n": 3}, {"id": 2, "cat": "a", "n": -1}, {"id": 3, "cat": None, "n": 1}], "id bigint, cat string, n bigint")
    assert checks.verify(t, ["cat"], "cat", "n > 0", "avisar") == ["row 3: not_null cat", "row 2: unique cat", "row 2: rule n > 0"]
    with pytest.raises(checks.Violation):
        checks.verify(t, rule="n > 0")
    assert len(rows(checks.quarantined(t, "n > 0", str(tmp_path / "bad")))) == 2
    assert spark.read.json(str(tmp_path / "bad")).count() == 1


def test_csv_rules(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d\n 5,1e3,x,\n7,nan,"q ""u""",2\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string"]
    r = df.collect()
    assert r[0][0] == 5 and r[0][1] == 1000.0 and r[0][3] == "" and r[1][2] == 'q "u"'


def test_delta(spark, tmp_path):
    at = str(tmp_path / "d")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert delta.write(a, at, partition_by="k") == 0
    assert delta.append(spark.createDataFrame([("x", 2**40, "w")], "k string, v bigint, c string"), at) == 1
    assert sorted(rows(delta.read(spark, at)), key=str) == [("x", 1, None), ("x", 2**40, "w"), ("y", 2, None)]
    assert rows(delta.read(spark, at, {"k": "y"})) == [("y", 2, None)]
    assert delta.read(spark, at, version=0).count() == 2
    with pytest.raises(ValueError):
        delta.append(spark.createDataFrame([("x",)], "k string"), at)
    with pytest.raises(ValueError):
        delta.append(spark.createDataFrame([("x", "t", "w")], "k string, v string, c string"), at)
    with pytest.raises(delta.Conflict):
        delta._commit(at, 1, [])
    assert [r["_change_type"] for r in delta.changes(spark, at, 1).collect()] == ["insert"]
    assert delta.optimize(spark, at) == 2 and delta.read(spark, at).count() == 3
    assert delta.vacuum(at) == 0 and delta.vacuum(at, keep_history=False) == 3
    assert delta.read(spark, at).count() == 3


def test_delta_partition_values_are_those_of_the_log(spark, tmp_path):
    at = str(tmp_path / "d e")
    keys = ["a+b", "50%", "x/y", "two words", "é=1", None, "%2B", "[z]", "q'\"#"]
    d = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n int, `k p` string")
    delta.write(d, at, partition_by="k p")
    want = sorted(enumerate(keys), key=str)
    assert sorted(rows(delta.read(spark, at)), key=str) == want
    assert rows(delta.read(spark, at, {"k p": "a+b"})) == [(0, "a+b")] and rows(delta.read(spark, at, {"k p": "x/y"})) == [(2, "x/y")]
    # another writer's folders needn't tell the values
    log = tmp_path / "d e" / "_delta_log" / f"{0:020d}.json"
    actions = [json.loads(x) for x in log.read_text().splitlines()]
    for i, a in enumerate(actions):
        if "add" in a:
            name = f"f{i}-{a['add']['path'].rsplit('/', 1)[1]}"
            os.rename(tmp_path / "d e" / unquote(a["add"]["path"]), tmp_path / "d e" / name)
            a["add"]["path"] = name
    log.write_text("".join(json.dumps(a) + "\n" for a in actions))
    assert sorted(rows(delta.read(spark, at)), key=str) == want


def test_deletion_vector_layout():
    r = np.random.default_rng(3)
    for x in ([], [0], [5, 70000, 2**33 + 1], r.integers(0, 1 << 20, 30000), np.arange(100000)):
        x = np.unique(np.array(x, dtype=np.int64))
        assert bitmaps.decode(bitmaps.encode(x)).tolist() == x.tolist()
    # by hand: one bitmap with a run container of 3..7
    run = struct.pack("<iqI", 1681511377, 1, 0) + struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 0, 4) + struct.pack("<HHH", 1, 3, 4)
    assert bitmaps.decode(run).tolist() == [3, 4, 5, 6, 7]
    assert bitmaps.z85_decode("HelloWorld") == bytes.fromhex("864fd26fb559f75b") and bitmaps.z85_encode(bytes.fromhex("864fd26fb559f75b")) == "HelloWorld"
    with pytest.raises(ValueError):
        bitmaps.unframed(bitmaps.framed(b"abcd")[:-1] + b"x", 0, 4)


def test_delta_deletion_vectors(spark, tmp_path):
    at = str(tmp_path / "d")
    delta.write(spark.range(0, 1000, 1, 3).selectExpr("id", "id % 2 as p", "id % 10 as d"), at, partition_by="p")
    assert delta.delete(spark, at, {"d": 3}) == 100 and delta.delete(spark, at, {"d": 3}) == 0
    assert delta.delete(spark, at, {"p": 0, "d": 4}) == 100 and delta.delete(spark, at, {"d": 5}) == 100
    want = [i for i in range(1000) if i % 10 not in (3, 4, 5)]
    assert sorted(r["id"] for r in delta.read(spark, at).collect()) == want
    assert delta.read(spark, at, version=1).count() == 900 and delta.read(spark, at, {"p": 1}).count() == 300
    c = delta.changes(spark, at, 3).collect()
    assert {r["_change_type"] for r in c} == {"delete"} and sorted(r["id"] for r in c) == [i for i in range(1000) if i % 10 == 5]
    # a vector within the log
    s = delta.replay(at)
    a = next(a for a in s.files.values() if a.get("deletionVector"))
    size = bitmaps.encode(np.arange(0))
    v = {"storageType": "i", "pathOrInlineDv": bitmaps.z85_encode(size), "sizeInBytes": len(size), "cardinality": 0}
    delta._commit(at, s.version + 1, [delta._remove(a, 0), {"add": a | {"deletionVector": v}}])
    assert delta.read(spark, at).count() > len(want)
    delta.optimize(spark, at)
    n = delta.read(spark, at).count()
    assert delta.vacuum(at, keep_history=False) > 0 and delta.read(spark, at).count() == n
    assert not any(a.get("deletionVector") for a in delta.replay(at).files.values())


def test_delta_checkpoints(spark, tmp_path):
    at = str(tmp_path / "d")
    for i in range(11):
        delta.append(spark.createDataFrame([(i, "a b" if i % 2 else None)], "n int, k string"), at, partition_by="k" if not i else None)
    assert os.path.exists(f"{at}/_delta_log/{10:020d}.checkpoint.parquet") and json.load(open(f"{at}/_delta_log/_last_checkpoint"))["version"] == 10
    for v in range(10):
        os.unlink(f"{at}/_delta_log/{v:020d}.json")
    assert delta.append(spark.createDataFrame([(11, "z")], "n int, k string"), at) == 11
    assert sorted(rows(delta.read(spark, at)), key=str) == sorted([(i, "a b" if i % 2 else None) for i in range(11)] + [(11, "z")], key=str)


def test_row_numbers_over_many_partitions(spark):
    """Sorted rows in 200 partitions: each row is in the window that its place gives, whatever the sort's bounds."""
    n = 1_200_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.shuffle.partitions", "200")
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            d = spark.range(0, n, 1, 50).select(F.xxhash64("id").alias("h"), "id").orderBy("h").select(F.col("id").alias("k"))
            w = windows.numbered_windows(d, "k", 1000)
            assert w.where("window <> k div 1000").isEmpty() and w.count() == n
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        t = Table(spark.range(0, n, 1, 50).select((F.lit(n) - F.col("id")).alias("k")).orderBy("k"))
        assert t.shard(7, 3).df.where("(k - 1) % 7 <> 3").isEmpty()
        a, b = t.fold(5, 2)
        assert b.df.where("(k - 1) % 5 <> 2").isEmpty() and a.df.count() + b.df.count() == n
        v = checks.violations(Table(d.withColumn("u", F.col("k") % 600_000).orderBy("k")), unique="u")
        assert v.agg(F.count("*"), F.min("row"), F.max("row")).first()[:] == (600_000, 600_001, n)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_sql(spark, tmp_path):
    url = f"sqlite://{tmp_path}/t.db"
    sql.execute(url, "CREATE TABLE t (id INTEGER, name TEXT, ok INTEGER)")
    sql.transaction(url, [{"sql": "INSERT INTO t VALUES (?, ?, ?)", "params": [1, "it's", 1]}, {"sql": "INSERT INTO t VALUES (2, NULL, 0)"}])
    with pytest.raises(RuntimeError, match="step 1"):
        sql.transaction(url, [{"sql": "DELETE FROM t"}, {"sql": "broken"}])
    q, p = sql.pushed("SELECT * FROM t", ["id", "name"], {"ok": 1}, 5)
    assert rows(sql.query(spark, url, q, p)) == [(1, "it's")]
    with pytest.raises(ValueError):
        sql.pushed("SELECT * FROM t", ["id; DROP TABLE t"])


def test_windows(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "n")
    got = []
    store = windows.Store(str(tmp_path / "state"))
    w = windows.Window("p", lambda: df, 3, 1, store=store)
    while w.tick(lambda t: got.append([r[0] for r in rows(t)])):
        pass
    assert got == [[0, 1, 2], [2, 3, 4]] and json.loads((tmp_path / "state").read_text())["p"]["offset"] == 4
    got.clear()
    c = windows.Window("c", lambda: df, cursor="n", store=store)
    assert c.tick(lambda t: got.append(len(rows(t)))) and not c.tick(lambda t: got.append(0)) and got == [5]
    b = windows.Window("b", lambda: df, cursor="n", backfill=(2, 3))
    assert b.tick(lambda t: got.append(len(rows(t)))) and got[-1] == 2 and b.store.load("b").cursor is None
    now = [0.0]
    d = windows.Window("d", lambda: df, "2min", clock=lambda: now[0])
    assert d.tick(lambda t: None)
    now[0] = 60
    assert not d.tick(lambda t: None)


def test_schedule():
    assert schedule.following("*/15 9-17 * * 1-5", datetime(2024, 1, 5, 17, 50)) == datetime(2024, 1, 8, 9, 0)
    assert schedule.following("0 0 29 2 *", datetime(2024, 1, 1)) == datetime(2024, 2, 29)
    with pytest.raises(ValueError):
        schedule.parse("61 * * * *")
    tries = []
    with pytest.raises(ZeroDivisionError):
        schedule.retry(lambda: tries.append(1) or 1 / 0, 2, sleep=lambda s: None)
    assert len(tries) == 3


def test_models(spark):
    d = spark.createDataFrame([(x, 2.0 * x + 1) for x in range(10)], "x bigint, y double")
    m = ml.LinearRegression(["x"]).fit(d, "y")
    assert abs(d.where("x = 3").select(m.predict()).first()[0] - 7) < 1e-4
    c = spark.createDataFrame([(float(x), int(x > 5)) for x in range(12)], "x double, y int")
    lr = ml.LogisticRegression(["x"], steps=60).fit(c, "y")
    p = c.withColumn("p", (lr.probability() > 0.5).cast("int"))
    assert ml.accuracy(p, "y", "p").first()[0] == 1.0 and ml.weighted_f1(p, "y", "p").first()[0] == 1.0
    assert ml.auc(c, "y", "x").first()[0] == 1.0
    k = ml.knn(c.withColumn("id", F.monotonically_increasing_id()), spark.createDataFrame([(0, 0.0), (1, 11.0)], "id bigint, x double"), ["x"], "y", "id", k=3)
    assert sorted(rows(k)) == [(0, "0"), (1, "1")]
    with pytest.raises(ValueError):
        ml.Preparation.fit(c.withColumn("g", F.lit("a")), one_hot=["g"])


def test_documents_and_vectors(spark):
    d = spark.createDataFrame([("a", 100), ("a", 50), ("b", 200), ("b", 150)], "c string, v int")
    got = documents.aggregate(d, [{"$match": {"v": {"$gte": 100}}}, {"$group": {"_id": "$c", "t": {"$sum": "$v"}}}, {"$sort": {"t": -1}}, {"$limit": 1}])
    assert rows(got) == [("b", 350)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in vectors.top_k(v, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r[0] for r in spark.createDataFrame([("abcdefghij",)], "t string").select(F.explode(V.chunks(F.col("t"), 4, 1))).collect()] == ["abcd", "defg", "ghij"]
    assert abs(sum(x * x for x in vectors.embed_text("hello world")) - 1) < 1e-6


def test_samples(spark):
    t = Table(spark.range(100).withColumn("g", (F.col("id") % 4 == 0).cast("string")).repartition(3, "id"))
    s = t.sample(20, by="g")
    assert s.count() == 20 and s.df.where("g = 'true'").count() == 5
    a, b = t.split(0.7, 3)
    assert a.count() + b.count() == 100 and rows(t.split(0.7, 3)[1]) == rows(b)
    assert sum(t.fold(5, k)[1].count() for k in range(5)) == 100


def test_tensors(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(5, 7)), r.normal(size=(5, 7))
    b[0, :3] = 0
    d = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    x, y = F.col("a"), F.col("b")
    one = {"add": tensors.add(x, y), "subtract": tensors.subtract(x, y), "multiply": tensors.multiply(x, y), "divide": tensors.divide(x, y), "softmax": tensors.softmax(x), "layer_norm": tensors.layer_norm(x), "relu": tensors.relu(x), "sigmoid": tensors.sigmoid(x), "tanh": tensors.tanh(x), "silu": tensors.silu(x), "gelu": tensors.gelu(x), "dot": tensors.dot(x, y), "argmax": tensors.argmax(x), "mean": tensors.mean(x)}
    got = d.orderBy("i").select(*(c.alias(k) for k, c in one.items())).toPandas()
    A = tensors.Arrays
    sig = 1 / (1 + np.exp(-a))
    want = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": A.divide(a, b), "softmax": A.softmax(a), "layer_norm": A.layer_norm(a), "relu": np.maximum(a, 0), "sigmoid": sig, "tanh": np.tanh(a), "silu": a * sig, "gelu": 0.5 * a * (1 + np.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a**3))), "dot": (a * b).sum(1), "argmax": a.argmax(1), "mean": a.mean(1)}
    for k, v in want.items():
        assert np.allclose(np.array(got[k].tolist()), v), k
    assert not A.divide(a, b)[0, :3].any() and np.allclose(A.divide(a, b[1]), a / b[1])
    image, kernels = r.normal(size=(2, 3, 6, 5)), r.normal(size=(4, 3, 3, 3))
    conv = A.conv2d(image, kernels, stride=2, pad=1)
    padded = np.pad(image, ((0, 0), (0, 0), (1, 1), (1, 1)))
    assert conv.shape == (2, 4, 3, 3) and conv[1, 2, 1, 2] == pytest.approx((padded[1, :, 2:5, 4:7] * kernels[2]).sum())
    assert A.max_pool(image, 2)[0, 1, 1, 0] == image[0, 1, 2:4, 0:2].max()
    assert np.allclose(A.batch_norm(image, np.ones(3), np.zeros(3), image.mean((0, 2, 3)), image.var((0, 2, 3)), 0).std((0, 2, 3)), 1)
    assert A.embedding(a, np.array([3, 0])).tolist() == a[[3, 0]].tolist() and np.allclose(A.matmul(a, b.T), a @ b.T)


def test_softmax_regression_steps_as_numpy(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(60, 2)) * [3, 0.5] + [1, 2], r.integers(0, 3, 60)
    d = spark.createDataFrame([(*map(float, p), f"c{k}") for p, k in zip(x, y, strict=True)], "u double, v double, c string")
    m = ml.SoftmaxRegression(["u", "v"], steps=5, rate=0.5).fit(d, "c")
    z = np.column_stack([np.ones(60), (x - x.mean(0)) / x.std(0)])
    w, target = np.zeros((3, 3)), np.eye(3)[y]
    for _ in range(5):
        w -= 0.5 * (tensors.Arrays.softmax(z @ w.T) - target).T @ z / 60
    got = d.select(m.probabilities().alias("p")).toPandas()["p"].tolist()
    assert m.classes == ["c0", "c1", "c2"] and np.allclose(got, tensors.Arrays.softmax(z @ w.T))


def test_registry_loader_and_gate(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,y\n1,2.5,0\n3,,1\n")
    assert rows(registry.read(spark, {"tipo": "csv", "arquivo": str(tmp_path / "d.csv")}).select("a", "y")) == [(1, 0), (3, 1)]
    with pytest.raises(registry.UnknownSource):
        registry.read(spark, {"tipo": "s3", "url": "x"})
    with pytest.raises(ValueError):
        registry.read(spark, {"tipo": "csv"})
    pq_path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, None, 2), (None, 4.5, None)], "a int, b double, y int").coalesce(1).write.parquet(pq_path)
    loaded = ml.loader(spark, pq_path, "y")
    assert loaded.attributes == ["a", "b"] and sorted(rows(loaded.df), key=str) == [([0.0, 4.5], 0), ([1.0, 0.0], 2)]
    assert sum(len(y) for _, y in loaded.batches(1)) == 2
    d = spark.createDataFrame([("a", "a"), ("b", "x b"), ("c", None)], "e string, g string")
    assert ml.gated(d, "e", "g", {"exact": 0.3, "contains": 0.6, "judge": 0.9}, judge=lambda e, g: F.lit(1.0)) == pytest.approx({"exact": 1 / 3, "contains": 2 / 3, "judge": 1.0})
    with pytest.raises(ml.BelowThreshold):
        ml.gated(d, "e", "g", {"exact": 0.5})
    assert sql.inlined("SELECT '?' , ?, ? FROM \"t?\"", [None, "o'x"]) == "SELECT '?' , NULL, 'o''x' FROM \"t?\""


def test_text_vectors_and_k_means_by_brute_force(spark):
    from quillon.plans.queries import QUERIES

    at = "/root/testdata/sf0.001"
    q = np.array(vectors.embed_text("license token"), dtype=float)
    scored = []
    for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect():
        v = np.array(vectors.embed_text(r["text"]), dtype=float)
        n = np.linalg.norm(v) * np.linalg.norm(q)
        scored.append((-(v @ q / n if n else 0.0), r["doc_id"]))
    want = sorted(scored)[:5]
    assert [(r["doc_id"], r["score"]) for r in QUERIES["text_vectors"](spark, at).collect()] == [(i, pytest.approx(-s, abs=1e-6)) for s, i in want]
    groups = {}
    balance = {r["s_suppkey"]: r["s_acctbal"] for r in spark.read.parquet(f"{at}/supplier.parquet").collect()}
    for r in QUERIES["k_means"](spark, at).collect():
        groups.setdefault(r["grupo"], []).append(balance[r["s_suppkey"]])
    centres = {g: np.mean(x) for g, x in groups.items()}
    # a fixed point: each row is with the nearest centre
    assert 1 < len(groups) <= 3 and all(min(centres, key=lambda c: abs(centres[c] - v)) == g for g, x in groups.items() for v in x)


def test_auc_over_many_ranges(spark):
    r = np.random.default_rng(7)
    s, y = r.integers(0, 300, 2000), r.integers(0, 2, 2000)
    d = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y, strict=True)], "s int, y int")
    p, n = s[y == 1][:, None], s[y == 0][None]
    assert ml.auc(d, "y", "s").first()[0] == pytest.approx(((p > n) + 0.5 * (p == n)).mean())


def test_z_order_clusters_files(spark, tmp_path):
    """Each file covers a small part of the plane."""
    d = spark.range(0, 4096).select((F.col("id") % 64).alias("x"), (F.col("id") / 64).cast("int").alias("y"))
    zorder.clustered(d, ["x", "y"], 16).write.parquet(str(tmp_path / "z"))
    g = spark.read.parquet(str(tmp_path / "z")).groupBy(F.input_file_name()).agg(((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("area"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in g) == 4096 and sum(r["area"] for r in g) < 3 * 4096
