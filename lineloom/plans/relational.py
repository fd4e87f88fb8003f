"""Aggregations, set operations, windows, top-k and sampling on tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineloom.functions import numeric
from lineloom.operators import quantiles
from lineloom.plans.registry import query
from lineloom.plans.text import _table


@query("SELECT label AS cls, count(*) AS n FROM embeddings GROUP BY label")
def group_count_by_class(spark, sf):
    return _table(spark, sf, "embeddings").groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM labels")
def count_where(spark, sf):
    return _table(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return _table(spark, sf, "documents").select("source").distinct()


@query("SELECT l_returnflag AS actual, l_linestatus AS pred, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion_matrix(spark, sf):
    return _table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("actual"), F.col("l_linestatus").alias("pred")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS cls, count(*) AS n, round(avg(p_size), 6) AS mean FROM part GROUP BY p_type")
def class_mean_property(spark, sf):
    return _table(spark, sf, "part").groupBy(F.col("p_type").alias("cls")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean"))


@query("WITH c AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey) SELECT round(avg(c), 6) AS mean, quantile_cont(c, 0.5) AS median, max(c) AS largest, round(sum(c * c) / sum(c), 6) AS expected, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END), 6) AS singles FROM c")
def cluster_coverage(spark, sf):
    c = _table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), F.percentile("c", F.lit(0.5)).alias("median"), F.max("c").alias("largest"), F.round(F.sum(F.col("c") * F.col("c")) / F.sum("c"), 6).alias("expected"), F.round(F.avg((F.col("c") == 1).cast("double")), 6).alias("singles"))


@query("WITH c AS (SELECT o_custkey AS cluster, o_orderpriority AS cls, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cls DESC) AS k FROM c) SELECT cluster, cls, n FROM r WHERE k = 1")
def cluster_majority_class(spark, sf):
    c = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("cls")).agg(F.count("*").alias("n"))
    return c.groupBy("cluster").agg(F.max(F.struct("n", "cls")).alias("m")).select("cluster", "m.cls", "m.n")


@query("SELECT o_orderpriority AS cluster, list_sort(list(DISTINCT o_orderstatus)) AS members FROM orders GROUP BY 1")
def group_into_sets(spark, sf):
    return _table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("cluster")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("members"))


@query(
    "WITH c AS (SELECT r_name, n_name, c_mktsegment AS cls, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, c_mktsegment), (c_mktsegment))), r AS (SELECT *, sum(n) OVER (PARTITION BY r_name, n_name) AS total, row_number() OVER (PARTITION BY r_name, n_name ORDER BY n DESC, cls DESC) AS k FROM c) SELECT r_name, n_name, cls, n, CAST(total AS BIGINT) AS total FROM r WHERE k = 1"
)
def tree_majority_rollup(spark, sf):
    """Class histogram at every node of region > nation, each node the sum of its children; the majority class."""
    small = F.broadcast(_table(spark, sf, "nation").join(F.broadcast(_table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))  # 25 and 5 rows by definition
    leaf = _table(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("cls")).agg(F.count("*").alias("n")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    node = leaf.groupingSets([("r_name", "n_name", "cls"), ("r_name", "cls"), ("cls",)], "r_name", "n_name", "cls").agg(F.sum("n").alias("n"))
    return node.groupBy("r_name", "n_name").agg(F.max(F.struct("n", "cls")).alias("m"), F.sum("n").alias("total")).select("r_name", "n_name", "m.cls", "m.n", "total")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_partkey AS seg0, l_suppkey AS seg1, l_orderkey, l_linenumber, l_extendedprice AS cost FROM r WHERE k = 1")
def best_entry_per_key(spark, sf):
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("seg0"), F.col("l_suppkey").alias("seg1")).agg(F.min(F.struct(F.col("l_extendedprice").alias("cost"), "l_orderkey", "l_linenumber")).alias("m"))
    return rows.select("seg0", "seg1", "m.l_orderkey", "m.l_linenumber", "m.cost")


@query("SELECT c_mktsegment AS grp, min(c_acctbal) AS x0, max(c_acctbal) AS x1, min(c_custkey) AS y0, max(c_custkey) AS y1 FROM customer GROUP BY 1")
def bounding_extent(spark, sf):
    return _table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.min("c_acctbal").alias("x0"), F.max("c_acctbal").alias("x1"), F.min("c_custkey").alias("y0"), F.max("c_custkey").alias("y1"))


@query("SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY event_type")
def percentile_thresholds(spark, sf):
    q = quantiles.exact_quantiles(_table(spark, sf, "events"), ["event_type"], "value", [0.05, 0.9])
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    return q.groupBy("event_type").agg(at(0.05).alias("lo"), at(0.9).alias("hi"))


@query("SELECT event_id, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS v, value > 0.5 * (min(value) OVER w + max(value) OVER w) AS above FROM events WINDOW w AS (PARTITION BY event_type)")
def midrange_normalize(spark, sf):
    """Ends of the range by a partial aggregate and a join; a window would sort every row of a type in one task."""
    e = _table(spark, sf, "events").select("event_id", "event_type", "value")
    ends = e.groupBy(F.col("event_type").alias("t")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return e.join(ends, e["event_type"].eqNullSafe(ends["t"])).select("event_id", ((v - lo) / (hi - lo)).alias("v"), (v > F.lit(0.5) * (lo + hi)).alias("above"))


@query("SELECT lang AS item FROM documents UNION SELECT source FROM documents")
def union_distinct(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select(F.col("lang").alias("item")).union(d.select("source")).distinct()


@query("SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def union_all(spark, sf):
    return _table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).unionByName(_table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf):
    return _table(spark, sf, "documents").select("doc_id").subtract(_table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, sf):
    return _table(spark, sf, "documents").select("doc_id").intersect(_table(spark, sf, "labels").select("doc_id"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_average(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return _table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, k, value AS m FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, s.m * 0.99 + e.value * 0.01 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT user_id, max(k) AS n, round(arg_max(m, k), 6) AS ewma FROM s GROUP BY user_id"
)
def ewma_fold(spark, sf):
    """Exponential moving average of each user's values in time order, as a weighted sum over places from the end.

    Places are made of counts by hour and of places within the hour, so no task gathers a user's whole history.
    """
    e = _table(spark, sf, "events").select("user_id", "ts", "event_id", "value", F.date_trunc("hour", "ts").alias("hour"))
    hours = e.groupBy(F.col("user_id").alias("u"), F.col("hour").alias("h")).agg(F.count("*").alias("k"))
    ahead = Window.partitionBy("u").orderBy(F.desc_nulls_last("h"))
    hours = hours.select("u", "h", (F.sum("k").over(ahead) - F.col("k")).alias("later"), F.sum("k").over(Window.partitionBy("u")).alias("n"))
    place = F.row_number().over(Window.partitionBy("user_id", "hour").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    placed = e.withColumn("place", place).join(hours, F.col("user_id").eqNullSafe(F.col("u")) & F.col("hour").eqNullSafe(F.col("h"))).withColumn("from_end", F.col("place") + F.col("later"))
    weight = F.pow(F.lit(0.99), F.col("from_end")) * F.when(F.col("from_end") == F.col("n") - 1, 1.0).otherwise(0.01)
    return placed.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(weight * F.col("value")), 6).alias("ewma"))


@query("SELECT vec_id, dense_rank() OVER (ORDER BY label) - 1 AS code FROM embeddings")
def dense_renumber(spark, sf):
    """Labels replaced by their rank; ranks are made on the distinct labels only."""
    e = _table(spark, sf, "embeddings").select("vec_id", "label")
    codes = e.select("label").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)
    return e.join(codes, "label").select("vec_id", "code")


@query("SELECT o_custkey, o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chunk, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 30 AS page, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 30 AS place FROM orders")
def chunk_and_page(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(w).alias("chunk"), F.floor((F.row_number().over(w) - 1) / 30).alias("page"), ((F.row_number().over(w) - 1) % 30).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS grp FROM orders")
def candidate_groups(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(0, 3)
    return _table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.collect_list("o_orderkey").over(w).alias("grp"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_by_cost(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("WITH t AS (SELECT quantile_cont(value, 0.99) AS cut FROM events) SELECT event_id, value FROM events, t WHERE value >= cut")
def percentile_cut(spark, sf):
    e = _table(spark, sf, "events")
    cut = quantiles.exact_quantiles(e, [], "value", [0.99]).select(F.col("value").alias("cut"))
    return e.join(F.broadcast(cut), F.col("value") >= F.col("cut")).select("event_id", "value")  # one row


@query("SELECT p_partkey, p_brand FROM part ORDER BY TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) ASC NULLS LAST, p_partkey")
def numeric_aware_sort(spark, sf):
    """All rows by the number that ends the column, those without one last."""
    return _table(spark, sf, "part").orderBy(F.regexp_extract("p_brand", "([0-9]+)$", 1).try_cast("int").asc_nulls_last(), "p_partkey").select("p_partkey", "p_brand")


def numeric_ranks(df, column: str, tie: str):
    """All rows with rank: 1 for the first by the number that ends the column, then by tie; those without a number go last.

    Ranks are made within each number and moved by the count of the rows before; one task orders the distinct numbers only.
    """
    keyed = df.withColumn("number", F.regexp_extract(column, "([0-9]+)$", 1).try_cast("decimal(38,0)"))
    before = keyed.groupBy("number").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy(F.col("number").asc_nulls_last())) - F.col("n"))
    ranked = keyed.withColumn("k", F.row_number().over(Window.partitionBy("number").orderBy(tie))).alias("r")
    joined = ranked.join(before.alias("b"), F.col("r.number").eqNullSafe(F.col("b.number")))
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("before") + F.col("k")).alias("rank")).orderBy("rank")


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS DECIMAL(38,0)) ASC NULLS LAST, p_partkey) AS rank FROM part")
def numeric_aware_rank(spark, sf):
    """The order of numeric_aware_sort over all rows."""
    return numeric_ranks(_table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query(
    "WITH c AS (SELECT p_type AS cls, count(*) AS n FROM part GROUP BY 1), cap AS (SELECT CAST(ceil(quantile_cont(n, 0.5)) AS BIGINT) AS cap FROM c), r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS k FROM part) SELECT p_partkey, p_type AS cls FROM r, cap WHERE k <= cap"
)
def per_class_cap(spark, sf):
    """A sample with no class above the median class size, in the order of a hash."""
    p = _table(spark, sf, "part")
    cap = p.groupBy("p_type").agg(F.count("*").alias("n")).agg(F.ceil(F.percentile("n", F.lit(0.5))).alias("cap"))
    w = Window.partitionBy("p_type").orderBy(F.md5(F.col("p_partkey").cast("string")), "p_partkey")
    return p.withColumn("k", F.row_number().over(w)).join(F.broadcast(cap), F.col("k") <= F.col("cap")).select("p_partkey", F.col("p_type").alias("cls"))


@query("SELECT DISTINCT l_suppkey AS id, ((l_suppkey * 7 % 256) << 16) | ((l_suppkey * 5 % 256) << 8) | (l_suppkey * 3 % 256) AS rgb, l_suppkey * 7 % 256 AS r, l_suppkey * 5 % 256 AS g, l_suppkey * 3 % 256 AS b FROM lineitem")
def rgb_pack(spark, sf):
    c = [F.pmod(F.col("l_suppkey") * k, F.lit(256)) for k in (7, 5, 3)]
    packed = _table(spark, sf, "lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").alias("id"), numeric.pack_rgb(*c).alias("rgb"))
    r, g, b = numeric.unpack_rgb(F.col("rgb"))
    return packed.select("id", "rgb", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-20.0, least(20.0, value - 50)))), 9) AS sigmoid, round(-ln(greatest(value / 1000, 1e-6)), 6) AS cost, round(CASE WHEN abs(value - 50) > 10 THEN greatest(value, 50.0) ELSE ln(exp(value - 50) + 1) + 50 END, 6) AS log_add FROM events")
def numeric_functions(spark, sf):
    v = F.col("value")
    return _table(spark, sf, "events").select("event_id", F.round(numeric.sigmoid(v - 50), 9).alias("sigmoid"), F.round(numeric.character_cost(v / 1000), 6).alias("cost"), F.round(numeric.log_add(v, F.lit(50.0)), 6).alias("log_add"))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size >= 40) p ON l.l_partkey = p.p_partkey")
def optional_sibling_join(spark, sf):
    """Every line with its optional sibling, null where there is none."""
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(_table(spark, sf, "part").where("p_size >= 40"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT r_regionkey AS spec, n_nationkey AS variant, r_name || '/' || n_name AS name FROM region CROSS JOIN nation")
def spec_cross_product(spark, sf):
    return _table(spark, sf, "region").crossJoin(_table(spark, sf, "nation")).select(F.col("r_regionkey").alias("spec"), F.col("n_nationkey").alias("variant"), F.concat_ws("/", "r_name", "n_name").alias("name"))
