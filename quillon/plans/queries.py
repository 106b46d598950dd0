"""One query for each operator, over the standard tables, with its SQL where SQL can give it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks, documents, ml, tensors, vectors
from ..operators.table import Table
from ..sources import avro, delta, files, iceberg, registry, sql, zorder
from ..sources.shared import scratch
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty, sum(l_extendedprice) / count(*) AS mean_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag")
def flagship(spark, sf_dir):
    """filter, then group with all five aggregates."""
    return table(spark, sf_dir, "lineitem").filter("linha.l_quantity >= 25").group_by("l_returnflag", {"n": "count", "sum_qty": ("sum", "l_quantity"), "mean_price": ("mean", "l_extendedprice"), "min_disc": ("min", "l_discount"), "max_disc": ("max", "l_discount")}).df


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT')")
def filter_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter('o_totalprice > 100000 e (o_orderstatus == "O" ou o_orderpriority == "1-URGENT")').df


@query("SELECT * FROM part WHERE contains(p_name, 'a') AND NOT contains(p_type, 'STEEL')")
def filter_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").filter('p_name contem "a" e nao (p_type contem "STEEL")').df


@query("SELECT o_orderkey, coalesce(nullif(o_custkey % 7, 3), 0) + 1 AS plus, CASE WHEN coalesce(nullif(o_custkey % 7, 3), 0) = 0 THEN 0.0 ELSE 10 / coalesce(nullif(o_custkey % 7, 3), 0)::DOUBLE END AS ratio, coalesce(nullif(o_custkey % 7, 3), 0) < 2 AS low FROM orders")
def null_arithmetic(spark, sf_dir):
    """null counts as 0; x / 0 is 0."""
    t = table(spark, sf_dir, "orders")
    t = Table(t.df.select("o_orderkey", F.expr("nullif(o_custkey % 7, 3)").alias("x")))
    return t.derive({"plus": "x + 1", "ratio": "10 / x", "low": "x < 2"}).select("o_orderkey", "plus", "ratio", "low").df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_quantity + 0.0 AS l_quantity, CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag AS tag FROM lineitem")
def derive(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").derive({"revenue": "l_extendedprice * (1 - l_discount)", "l_quantity": "l_quantity + 0.0", "tag": 'l_linenumber + ":" + l_returnflag'})
    return t.select("l_orderkey", "l_linenumber", "revenue", "l_quantity", "tag").df


@query("SELECT c_name, c_custkey FROM customer")
def select_columns(spark, sf_dir):
    """Unknown names are dropped."""
    return table(spark, sf_dir, "customer").select("c_name", "nothing", "c_custkey").df


@query("SELECT '' AS grupo, count(*) AS n, sum(o_totalprice) AS total FROM orders")
def group_all(spark, sf_dir):
    return table(spark, sf_dir, "orders").group_by("", {"n": "contar", "total": ("somar", "o_totalprice")}).df


@query("SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def group_by_display(spark, sf_dir):
    """Keys are texts."""
    return table(spark, sf_dir, "nation").agrupar_por("n_regionkey", {"n": "contar"}).df


@query("SELECT coalesce(CAST(nullif(o_custkey % 5, 2) AS VARCHAR), 'nulo') AS k, count(*) AS n, sum(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice END) / count(*) AS mean_price, min(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice END) AS least FROM orders GROUP BY 1")
def group_with_nulls(spark, sf_dir):
    d = table(spark, sf_dir, "orders").df.select(F.expr("nullif(o_custkey % 5, 2)").alias("k"), F.expr("if(o_custkey % 3 = 0, null, o_totalprice)").alias("p"))
    return Table(d).group_by("k", {"n": "count", "mean_price": ("mean", "p"), "least": ("min", "p")}).df


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "supplier").sort("s_acctbal", desc=True).limit(10).select("s_suppkey", "s_acctbal").df


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct().df


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def distinct_by_column(spark, sf_dir):
    """The first row of each value; the table is stored in order of its key."""
    return table(spark, sf_dir, "customer").distinct("c_mktsegment").select("c_custkey", "c_mktsegment").df


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
def join_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").derive({"c_custkey": F.col("o_custkey")})
    return o.join(table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_name").df


@query("SELECT n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def union_tables(spark, sf_dir):
    a = Table(table(spark, sf_dir, "nation").df.select(F.col("n_name").alias("name")))
    b = Table(table(spark, sf_dir, "region").df.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("extra")))
    return a.union(b).df


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, strlen(p_name) AS size, string_split(p_type, ' ')[1] AS first_word FROM part")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").derive({"up": "maiusculas(p_name)", "low": "minusculas(p_brand)", "size": "tamanho(p_name)", "first_word": 'dividir(p_type, " ")[0]'}).select("p_partkey", "up", "low", "size", "first_word").df


@query("SELECT doc_id, i AS part, substr(text, CAST(i * 700 + 1 AS BIGINT), 800) AS chunk FROM documents, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 700.0) AS BIGINT) + 1 END)) AS u(i)")
def text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").df
    return d.select("doc_id", F.posexplode(V.chunks(F.col("text"))).alias("part", "chunk")).withColumn("part", F.col("part").cast("long"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def list_functions(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").derive({"k": "tamanho(embedding) > 0"}).df
    return d.where("k").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS q, CASE WHEN l_linenumber > 3 THEN 'verdadeiro' ELSE 'falso' END AS late FROM lineitem")
def display_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").derive({"q": 'l_quantity + ""', "late": '(l_linenumber > 3) + ""'}).select("l_orderkey", "l_linenumber", "q", "late").df


@query("SELECT 'unique' AS rule, c_nationkey_text AS k, count(*) - 1 AS extra FROM (SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey_text FROM customer) GROUP BY 2 HAVING count(*) > 1")
def quality_unique(spark, sf_dir):
    """Violations of uniqueness by value: every later duplicate counts."""
    t = table(spark, sf_dir, "customer")
    v = checks.violations(t, unique="c_nationkey").withColumn("__ord", F.col("row") - 1)
    return v.join(t._numbered(), "__ord").groupBy("rule", F.col("c_nationkey").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("extra"))


@query("SELECT 'rule' AS rule, row_number() OVER (ORDER BY s_suppkey) AS row FROM supplier QUALIFY s_acctbal <= 0")
def quality_rule(spark, sf_dir):
    return checks.violations(table(spark, sf_dir, "supplier"), not_null=["s_name"], rule="linha.s_acctbal > 0").select("rule", "row")


@query("SELECT event_type, sum(value) AS total, count(*) AS n FROM events WHERE value >= 10 GROUP BY event_type HAVING n > 0")
def document_pipeline(spark, sf_dir):
    d = table(spark, sf_dir, "events").df
    return documents.aggregate(d, [{"$match": {"value": {"$gte": 10}}}, {"$group": {"_id": {"event_type": "$event_type"}, "total": {"$sum": "$value"}, "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 0}}}])


@query("SELECT event_id, (event_id // 100) AS window FROM events WHERE event_id < (SELECT count(*) // 100 * 100 FROM events)")
def count_windows(spark, sf_dir):
    """Only full windows."""
    return windows.numbered_windows(table(spark, sf_dir, "events").df, "event_id", 100).select("event_id", "window")


@query("SELECT w AS window, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events, (SELECT unnest(range(0, (SELECT (count(*) - 100) // 75 + 1 FROM events))) AS w) WHERE event_id >= w * 75 AND event_id < w * 75 + 100 GROUP BY w")
def sliding_windows(spark, sf_dir):
    d = windows.numbered_windows(table(spark, sf_dir, "events").df, "event_id", 100, 25)
    return d.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_time_windows(spark, sf_dir):
    d = windows.event_windows(table(spark, sf_dir, "events").df, "ts", "1 hour")
    return d.groupBy(F.col("window.start").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_id > 10 AND event_id <= 60")
def cursor_batches(spark, sf_dir):
    """Two batches of 25 after a cursor at 10."""
    store = windows.Store()
    store.save("p", windows.State(cursor=10))
    got = []
    w = windows.Window("p", lambda: table(spark, sf_dir, "events").df.select("event_id"), 25, cursor="event_id", store=store)
    while len(got) < 2 and w.tick(lambda t: got.append(t.df)):
        pass
    return got[0].union(got[1])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS channel FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'web' FROM orders WHERE o_orderkey % 2 = 1")
def delta_evolution(spark, sf_dir):
    d = table(spark, sf_dir, "orders").df.select("o_orderkey", "o_orderstatus", "o_totalprice")
    at = scratch(spark)
    delta.write(d.where("o_orderkey % 2 = 0"), at, partition_by="o_orderstatus")
    delta.append(d.where("o_orderkey % 2 = 1").withColumn("channel", F.lit("web")), at)
    return delta.read(spark, at)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def delta_pruned_time_travel(spark, sf_dir):
    d = table(spark, sf_dir, "orders").df.select("o_orderkey", "o_orderstatus")
    at = scratch(spark)
    delta.write(d, at, partition_by="o_orderstatus")
    delta.append(d.limit(10), at)
    delta.optimize(spark, at)
    delta.vacuum(at)
    return delta.read(spark, at, {"o_orderstatus": "F"}, version=0)


@query("SELECT s_suppkey, 'insert' AS _change_type, 1 AS _commit_version FROM supplier WHERE s_suppkey % 3 = 0")
def delta_changes(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").df.select("s_suppkey")
    at = scratch(spark)
    delta.write(d.where("s_suppkey % 3 <> 0"), at)
    delta.append(d.where("s_suppkey % 3 = 0"), at)
    return delta.changes(spark, at, 1).drop("_commit_timestamp")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN 'web' END AS channel FROM orders WHERE o_orderstatus = 'F'")
def iceberg_evolution(spark, sf_dir):
    """Identity and bucket partitions, an appended column, a pruned read."""
    d = table(spark, sf_dir, "orders").df.select("o_orderkey", "o_orderstatus")
    at = scratch(spark)
    iceberg.write(d.where("o_orderkey % 2 = 0"), at, ["o_orderstatus", "bucket[4](o_orderkey)"])
    iceberg.append(d.where("o_orderkey % 2 = 1").withColumn("channel", F.lit("web")), at)
    return iceberg.read(spark, at, {"o_orderstatus": "F"})


@query("SELECT p_partkey, p_size FROM part WHERE p_size <> 7")
def iceberg_delete(spark, sf_dir):
    at = scratch(spark)
    iceberg.write(table(spark, sf_dir, "part").df.select("p_partkey", "p_size"), at)
    iceberg.delete(spark, at, {"p_size": 7})
    iceberg.optimize(spark, at)
    iceberg.vacuum(at)
    return iceberg.read(spark, at)


@query("SELECT r_name, '{\"k\": ' || r_regionkey || ', \"n\": \"' || r_name || '\"}' AS doc FROM region")
def avro_envelope(spark, sf_dir):
    schema = {"type": "record", "name": "r", "fields": [{"name": "k", "type": "long"}, {"name": "n", "type": ["null", "string"]}]}
    rows = [(r["r_name"], avro.encode({"k": r["r_regionkey"], "n": r["r_name"]}, schema, 1)) for r in table(spark, sf_dir, "region").df.collect()]
    d = spark.createDataFrame(rows, "r_name string, payload binary")
    return d.select("r_name", avro.decoded(F.col("payload"), schema).alias("doc"))


@query("SELECT l_orderkey, l_partkey FROM lineitem")
def z_order(spark, sf_dir):
    return zorder.clustered(table(spark, sf_dir, "lineitem").df.select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"], 8)


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    at = scratch(spark) + "/t"
    files.write_csv(table(spark, sf_dir, "customer").df.select("c_custkey", "c_acctbal", "c_mktsegment"), at)
    return files.read_csv(spark, at)


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    at = scratch(spark) + "/t.json"
    files.write_json(table(spark, sf_dir, "region").df, at)
    return files.read_json(spark, at)


@query("SELECT o_orderkey, CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END AS o_orderdate FROM orders")
def parquet_iso_text(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/orders.parquet", iso_text=True).select("o_orderkey", "o_orderdate")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_pushdown(spark, sf_dir):
    url = f"sqlite://{scratch(spark)}/t.db"
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").df.collect()]
    sql.execute(url, "CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
    sql.transaction(url, [{"sql": "INSERT INTO nation VALUES (?, ?, ?)", "params": list(r)} for r in rows])
    q, params = sql.pushed("SELECT * FROM nation", ["n_nationkey", "n_name"], {"n_regionkey": 1})
    return sql.query(spark, url, q, params)


@query()
def text_vectors(spark, sf_dir):
    """The five documents nearest to a text by the offline embedding."""
    d = table(spark, sf_dir, "documents").df.select("doc_id", vectors.embed(F.col("text")).alias("embedding"))
    return vectors.top_k(d, vectors.embed_text("license token"), 5, id_column="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) DESC, vec_id LIMIT 5")
def vector_top_k(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").df
    q = d.where("vec_id = 0").first()["embedding"]
    return vectors.top_k(d, q, 5).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def linear_regression(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").df
    m = ml.LinearRegression(["l_quantity"]).fit(d, "l_extendedprice")
    return spark.createDataFrame([(round(m.weights[1], 4), round(m.weights[0], 2))], "slope double, intercept double")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 9) AS q, (l_returnflag = 'A')::DOUBLE AS a FROM lineitem")
def preparation(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").df.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    p = ml.Preparation.fit(d, one_hot=["l_returnflag"], standardise=["l_quantity"])
    return p.transform(d).select("l_orderkey", "l_linenumber", F.round("l_quantity", 9).alias("q"), F.col("`l_returnflag=A`").alias("a"))


@query("SELECT quality AS real, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return ml.confusion(table(spark, sf_dir, "labels").df, "quality", "toxic")


@query("WITH r AS (SELECT quality, (rank() OVER (ORDER BY doc_id % 97)) + (count(*) OVER (PARTITION BY doc_id % 97) - 1) / 2.0 AS k FROM labels) SELECT round((sum(k) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1)), 9) AS auc FROM r")
def rank_auc(spark, sf_dir):
    d = table(spark, sf_dir, "labels").df.withColumn("s", F.col("doc_id") % 97)
    return ml.auc(d, "quality", "s").select(F.round("auc", 9).alias("auc"))


@query("SELECT count(*) AS n, CAST(sum((quality = toxic)::INT) AS BIGINT) AS passed, avg((quality = toxic)::INT) AS score FROM labels")
def evaluation(spark, sf_dir):
    return ml.evaluate(table(spark, sf_dir, "labels").df, "quality", "toxic")


@query("WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS y, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x FROM supplier), n AS (SELECT q.s_suppkey, t.y, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY abs(q.x - t.x), t.y) AS r FROM s q, s t WHERE q.s_suppkey % 20 = 0), v AS (SELECT s_suppkey, y, count(*) AS c FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT s_suppkey, first(y ORDER BY c DESC, y) AS y FROM v GROUP BY 1")
def nearest_neighbours(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").df.withColumn("y", (F.col("s_acctbal") > 0).cast("string"))
    return ml.knn(d, d.where("s_suppkey % 20 = 0"), ["s_acctbal"], "y", "s_suppkey")


@query()
def k_means(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").df
    m = ml.vector_model("kmeans", ["s_acctbal"], k=3, seed=1).fit(d)
    return m.transform(d).select("s_suppkey", F.col("prediction").alias("grupo"))


@query("SELECT * FROM region WHERE r_regionkey % 2 = 1")
def shards(spark, sf_dir):
    """Every second row, by row number; the table is stored in order of its key."""
    return table(spark, sf_dir, "region").shard(2, 1).df


@query("WITH g AS (SELECT c_mktsegment, count(*) AS n, 100 * count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS e FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY e - floor(e) DESC, c_mktsegment) AS i FROM g) SELECT c_mktsegment, CAST(floor(e) + (i <= 100 - (SELECT sum(floor(e)) FROM g))::INT AS BIGINT) AS n, true AS known FROM r")
def stratified_sample(spark, sf_dir):
    """100 rows, each group by its share: how many of each group, and that all of them are rows of the table."""
    t = table(spark, sf_dir, "customer")
    s = t.sample(100, by="c_mktsegment").df
    known = t.df.select("c_custkey", F.lit(True).alias("k"))
    return s.join(known, "c_custkey", "left").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("n"), F.min(F.coalesce("k", F.lit(False))).alias("known"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL")
def delta_deletion_vector(spark, sf_dir):
    d = table(spark, sf_dir, "orders").df.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    at = scratch(spark)
    delta.write(d, at, partition_by="o_orderstatus")
    delta.delete(spark, at, {"o_orderpriority": "1-URGENT"})
    return delta.read(spark, at).select("o_orderkey", "o_orderpriority")


_ODD = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'a+b' WHEN 2 THEN '50%' WHEN 3 THEN 'x/y' WHEN 4 THEN 'two words' WHEN 5 THEN '%2B' ELSE 'k=v' END"


@query(f"SELECT o_orderkey, {_ODD} AS k FROM orders")
def delta_partition_values(spark, sf_dir):
    """Partition values that folder names escape."""
    at = scratch(spark)
    delta.write(table(spark, sf_dir, "orders").df.select("o_orderkey", F.expr(_ODD).alias("k")), at, partition_by="k")
    return delta.read(spark, at)


@query("SELECT s_suppkey, 'insert' AS _change_type, 1 AS _commit_version FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'delete', 2 FROM supplier WHERE s_nationkey = 3")
def delta_change_feed(spark, sf_dir):
    """Inserted and deleted rows."""
    d = table(spark, sf_dir, "supplier").df.select("s_suppkey", "s_nationkey")
    at = scratch(spark)
    delta.write(d.where("s_suppkey % 3 <> 0"), at)
    delta.append(d.where("s_suppkey % 3 = 0"), at)
    delta.delete(spark, at, {"s_nationkey": 3})
    return delta.changes(spark, at, 1).select("s_suppkey", "_change_type", "_commit_version")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE NOT (p_size = 7 AND p_brand = 'Brand#13') AND p_size <> 9")
def iceberg_equality_delete(spark, sf_dir):
    at = scratch(spark)
    iceberg.write(table(spark, sf_dir, "part").df.select("p_partkey", "p_size", "p_brand"), at, ["truncate[5](p_size)"])
    iceberg.delete(spark, at, {"p_size": 7, "p_brand": "Brand#13"}, "equality")
    iceberg.delete(spark, at, {"p_size": 9}, "equality")
    return iceberg.read(spark, at)


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS head, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(list_avg(embedding::DOUBLE[]), 6) AS mean_, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most FROM embeddings")
def list_reductions(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").derive({"n": "tamanho(embedding)", "head": "embedding[0]", "total": "somar(embedding)", "mean_": "media(embedding)", "least": "min(embedding)", "most": "max(embedding)"}).df
    return d.select("vec_id", "n", F.col("head").cast("double").alias("head"), F.round("total", 6).alias("total"), F.round("mean_", 6).alias("mean_"), "least", "most")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: greatest(x, 0))), 6) AS relu, list_position(embedding, list_max(embedding)) - 1 AS top, round(list_max(list_transform(embedding::DOUBLE[], lambda x: exp(x))) / list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x))), 9) AS chance, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings")
def tensor_columns(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").df.select("vec_id", F.round(tensors.total(tensors.relu(e)), 6).alias("relu"), tensors.argmax(e).alias("top"), F.round(F.array_max(tensors.softmax(e)), 9).alias("chance"), F.round(tensors.dot(e, e), 6).alias("square"))


@query("SELECT 'not_null' AS rule, row_number() OVER (ORDER BY s_suppkey) AS row FROM supplier QUALIFY s_nationkey % 5 = 0 OR s_nationkey IS NULL")
def quality_not_null(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").df.withColumn("x", F.expr("nullif(s_nationkey % 5, 0)"))
    return checks.violations(Table(d), not_null=["x"]).select("rule", "row")


@query("SELECT o_orderkey, round(coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_totalprice END, avg(CASE WHEN o_custkey % 4 > 0 THEN o_totalprice END) OVER ()), 4) AS x FROM orders")
def imputation(spark, sf_dir):
    d = table(spark, sf_dir, "orders").df.select("o_orderkey", F.expr("if(o_custkey % 4 > 0, o_totalprice, null)").alias("x"))
    return ml.Preparation.fit(d, impute=["x"]).transform(d).withColumn("x", F.round("x", 4))


@query("WITH c AS (SELECT quality AS k, count(*) AS support, sum((quality = toxic)::INT) AS hit FROM labels GROUP BY 1), p AS (SELECT toxic AS k, count(*) AS called FROM labels GROUP BY 1) SELECT round(sum(support * CASE WHEN hit > 0 THEN 2.0 * hit / (support + coalesce(called, 0)) ELSE 0 END) / sum(support), 9) AS f1 FROM c LEFT JOIN p USING (k)")
def f1_score(spark, sf_dir):
    return ml.weighted_f1(table(spark, sf_dir, "labels").df, "quality", "toxic").select(F.round("f1", 9).alias("f1"))


@query("SELECT round(sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)), 4) AS rmse, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def regression_errors(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").df.withColumn("guess", 1500 * F.col("l_quantity"))
    return ml.regression_measures(d, "l_extendedprice", "guess").select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("SELECT event_id FROM events WHERE event_id BETWEEN 20 AND 70")
def backfill(spark, sf_dir):
    got = []
    windows.Window("p", lambda: table(spark, sf_dir, "events").df.select("event_id"), 25, cursor="event_id", backfill=(20, 70)).tick(lambda t: got.append(t.df))
    return got[0]


@query("SELECT s_suppkey, s_acctbal > 0 AS good FROM supplier")
def quarantine(spark, sf_dir):
    """Rows that meet a rule, and those that were put aside."""
    at = scratch(spark) + "/bad"
    good = checks.quarantined(table(spark, sf_dir, "supplier"), "linha.s_acctbal > 0", at).df
    bad = spark.read.schema("linha struct<s_suppkey: bigint>").json(at).select(F.col("linha.s_suppkey").alias("s_suppkey"), F.lit(False).alias("good"))
    return good.select("s_suppkey", F.lit(True).alias("good")).unionAll(bad)


@query("SELECT o_orderkey, 1 AS n FROM orders")
def split_and_fold(spark, sf_dir):
    """Each row is in one of the two parts of a split, and in the test part of one of three folds."""
    t = table(spark, sf_dir, "orders").select("o_orderkey")
    a, b = t.split(0.7)
    folds = [t.fold(3, k)[1].df.withColumn("n", F.lit(0)) for k in range(3)]
    d = a.df.withColumn("n", F.lit(1)).unionAll(b.df.withColumn("n", F.lit(1)))
    for f in folds:
        d = d.unionAll(f)
    return d.groupBy("o_orderkey").agg(F.sum("n").cast("int").alias("n"))


@query("SELECT o_orderkey, (o_orderkey_n // 1000) AS window FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS o_orderkey_n FROM orders) WHERE o_orderkey_n < (SELECT count(*) // 1000 * 1000 FROM orders)")
def windows_of_a_sort(spark, sf_dir):
    """Count windows over rows in 64 partitions, in another order than they are stored."""
    d = table(spark, sf_dir, "orders").df.repartition(64, "o_custkey").orderBy("o_totalprice", "o_orderkey").withColumn("k", F.struct("o_totalprice", "o_orderkey"))
    return windows.numbered_windows(d, "k", 1000).select("o_orderkey", "window")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 LIMIT 3")
def source_registry(spark, sf_dir):
    """A declared source: a database, with columns, condition and limit handed to it."""
    at = f"{scratch(spark)}/t.db"
    rows = sorted(tuple(r) for r in table(spark, sf_dir, "nation").df.collect())
    sql.execute(f"sqlite://{at}", "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
    sql.transaction(f"sqlite://{at}", [{"sql": "INSERT INTO nation VALUES (?, ?, ?)", "params": list(r)} for r in rows])
    return registry.read(spark, {"tipo": "sqlite", "caminho": at, "consulta": "SELECT * FROM nation ORDER BY n_nationkey", "pushdown": {"colunas": ["n_nationkey", "n_name"], "onde": {"n_regionkey": 2}, "limite": 3}})


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, sum(l_linenumber) AS labels FROM lineitem")
def training_examples(spark, sf_dir):
    """A file as examples: attributes in one array, the target as integers."""
    at = f"{scratch(spark)}/t.parquet"
    table(spark, sf_dir, "lineitem").df.select("l_quantity", "l_tax", "l_linenumber").write.parquet(at)
    d = ml.loader(spark, at, "l_linenumber").df
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("x", F.lit(0)).cast("double")), 2).alias("total"), F.sum("y").alias("labels"))


@query("SELECT true AS passed, avg((quality = toxic)::INT) AS exact FROM labels")
def evaluation_gate(spark, sf_dir):
    d = table(spark, sf_dir, "labels").df
    score = ml.gated(d, "quality", "toxic", {"exact": 0.0})["exact"]
    try:
        ml.gated(d, "quality", "toxic", {"exact": 1.0})
        passed = False
    except ml.BelowThreshold:
        passed = True
    return spark.createDataFrame([(passed, score)], "passed boolean, exact double")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'low' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'top' END AS real, true AS near FROM supplier")
def softmax_classes(spark, sf_dir):
    """Three classes by one feature: what is guessed is the class, but for rows close to a border."""
    d = table(spark, sf_dir, "supplier").df.select("s_suppkey", "s_acctbal", F.expr("case when s_acctbal < 0 then 'low' when s_acctbal < 5000 then 'mid' else 'top' end").alias("real"))
    d = d.withColumn("square", F.col("s_acctbal") * F.col("s_acctbal"))
    guess = ml.SoftmaxRegression(["s_acctbal", "square"], steps=150, rate=2.0).fit(d, "real").predict()
    border = F.least(F.abs("s_acctbal"), F.abs(F.col("s_acctbal") - 5000)) < 1500
    return d.select("s_suppkey", "real", ((guess == F.col("real")) | border).alias("near"))
