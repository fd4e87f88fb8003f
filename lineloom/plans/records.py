"""Queries on records of characters and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions.geometry import Rect
from lineloom.operators import lattice, records
from lineloom.plans.layout import BOXES_SQL, _boxes
from lineloom.plans.models import BRIDGE, _edges
from lineloom.plans.registry import query
from lineloom.plans.text import _table


@query("SELECT p_partkey, regexp_replace(p_brand, '#', '-', 'g') AS p_brand FROM part WHERE regexp_matches(p_brand, '#[1-3]')")
def class_rewrite(spark, sf):
    return records.rewritten(_table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "#[1-3]", "#", "-")


@query("SELECT p_partkey, p_brand, CAST(trunc(abs(sin(p_partkey)) * 1.23456789e6) AS BIGINT) % 10 = 0 AS is_test FROM part WHERE NOT coalesce(regexp_matches(p_brand, '#[1-3]'), false)")
def class_exclude(spark, sf):
    return records.split_off(_table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "#[1-3]", "p_partkey")


@query("SELECT l_orderkey, list(l_returnflag ORDER BY l_extendedprice, l_returnflag) AS outputs, arg_min(l_returnflag, (l_extendedprice, l_returnflag)) AS best, min(l_extendedprice) AS best_cost FROM lineitem GROUP BY l_orderkey")
def best_outputs(spark, sf):
    return records.best_outputs(_table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_extendedprice")


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS label FROM orders), c AS (SELECT o_custkey, label, count(*) AS n FROM o WHERE label IS NOT NULL GROUP BY ALL), m AS (SELECT o_custkey, label AS most, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) AS k FROM c) SELECT o_orderkey, label, coalesce(label, most) AS new_label FROM o LEFT JOIN m ON m.k = 1 AND m.o_custkey = o.o_custkey"
)
def cluster_label_transfer(spark, sf):
    """Two thirds of the orders have a label; the rest get the most frequent one of their cluster."""
    o = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("label"))
    return records.transferred(o, "o_custkey", "label").select("o_orderkey", "label", "new_label")


@query(
    "WITH p AS (SELECT s_nationkey AS page_no, s_suppkey AS line_id, c_custkey AS truth_id, round(levenshtein(s_name, c_name) / greatest(length(s_name), length(c_name), 1), 6) AS cost FROM supplier JOIN customer ON s_nationkey = c_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY page_no, line_id ORDER BY cost, truth_id) AS k FROM p) SELECT page_no, line_id, truth_id, cost FROM r WHERE k = 1"
)
def matched_truth(spark, sf):
    lines = _table(spark, sf, "supplier").select(F.col("s_nationkey").alias("page_no"), F.col("s_suppkey").alias("line_id"), F.col("s_name").alias("text"))
    truths = _table(spark, sf, "customer").select(F.col("c_nationkey").alias("page_no"), F.col("c_custkey").alias("truth_id"), F.col("c_name").alias("text"))
    return records.matched_truth(lines, truths, "page_no")


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY x0, line_id) AS i FROM ({BOXES_SQL})), g AS (SELECT a.page_no, a.i, n, arg_min(b.line_id, b.i) AS first, arg_max(b.line_id, b.i) AS last, min(b.y0) AS y0, min(b.x0) AS x0, max(b.y1) AS y1, max(b.x1) AS x1, count(*) AS c, max(CASE WHEN b.i > a.i THEN b.x0 - p.x1 END) AS gap
FROM o a, (SELECT unnest([1, 2, 3, 4]) AS n) s, o b LEFT JOIN o p ON p.page_no = b.page_no AND p.i = b.i - 1 WHERE b.page_no = a.page_no AND b.i BETWEEN a.i AND a.i + n - 1 GROUP BY a.page_no, a.i, n)
SELECT page_no, first, last, y0, x0, y1, x1 FROM g WHERE c = n AND coalesce(gap, 0) <= 20 AND (y1 - y0) / (x1 - x0) BETWEEN 0.05 AND 3.0"""
)
def candidate_group_filter(spark, sf):
    return records.candidate_groups(_boxes(spark, sf))


@query("SELECT event_id, value <= 50 AS good, round(avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS ratio FROM events")
def cost_gate(spark, sf):
    return records.good_ratio(_table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value"), 50).select("event_id", "good", "ratio")


@query("WITH k AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type HAVING count(*) >= 10) SELECT p_type, n, round(n / (SELECT sum(n) FROM k), 6) AS share FROM k")
def class_mixture(spark, sf):
    return records.class_mixture(_table(spark, sf, "part"), "p_type", 10)


@query("SELECT cut, total FROM (SELECT cut, coalesce(sum(l_quantity) FILTER (WHERE l_discount >= cut), 0) AS total FROM lineitem, (SELECT CAST(unnest([0.02, 0.05, 0.08]) AS DOUBLE) AS cut) GROUP BY cut) ORDER BY total DESC, cut LIMIT 1")
def best_threshold(spark, sf):
    """Of three thresholds the one with the greatest total weight."""
    return records.best_threshold(_table(spark, sf, "lineitem"), "l_discount", "l_quantity", [0.02, 0.05, 0.08])


@query("SELECT doc_id, '<tr><td>' || replace(replace(coalesce(d.source, ''), '&', '&amp;'), '<', '&lt;') || '</td><td>' || replace(replace(coalesce(CAST(l.quality AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS html FROM documents d FULL JOIN labels l USING (doc_id)")
def side_by_side(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("text"))
    return records.side_by_side(d, _table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("text")), ["doc_id"])


@query("SELECT l_shipmode, l_returnflag, l_linestatus, n, rate FROM (SELECT l_linenumber AS l_shipmode, l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus)")
def error_grid(spark, sf):
    """Error rate over a grid of three properties."""
    wrong = F.avg((F.col("l_discount") > 0.05).cast("int"))
    return _table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("l_shipmode"), "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(wrong, 6).alias("rate"))


_LINES = "SELECT l_orderkey AS lattice_id, l_linenumber - 1 AS start, l_linenumber + l_suppkey % 2 AS stop, round(1 + l_discount * 10, 6) AS cost, l_returnflag AS cls FROM lineitem"


@query(f"SELECT lattice_id, start, stop, cost, cls FROM ({_LINES}) UNION ALL SELECT lattice_id, start, start + 1, 10.0, '' FROM (SELECT lattice_id, unnest(range(min(start), max(stop))) AS start FROM ({_LINES}) GROUP BY lattice_id) s WHERE NOT EXISTS (SELECT 1 FROM ({_LINES}) e WHERE e.lattice_id = s.lattice_id AND e.start = s.start AND e.stop = s.start + 1)")
def lattice_round_trip(spark, sf):
    """Lattices written as text lines and read from them again."""
    return lattice.round_trip(_edges(spark, sf), bridge=BRIDGE)


@query(f"SELECT lattice_id, start, count(*) AS n, list(stop ORDER BY stop, cls) AS stops FROM ({_LINES}) GROUP BY lattice_id, start")
def transition_dump(spark, sf):
    """The edges that leave every state."""
    li = _table(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("lattice_id"), (F.col("l_linenumber") - 1).alias("start"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).alias("stop"), F.col("l_returnflag").alias("cls"))
    made = e.groupBy("lattice_id", "start").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("stop", "cls"))).alias("s"))
    return made.select("lattice_id", "start", "n", F.transform("s", lambda x: x["stop"]).alias("stops"))


@query(f"SELECT b.page_no, b.line_id, b.y1 - b.y0 AS height, o.o_orderstatus AS status, l.l_returnflag AS cls FROM ({BOXES_SQL}) b LEFT JOIN orders o ON o.o_orderkey = b.page_no LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) l ON l.l_orderkey = b.page_no AND l.l_linenumber = b.line_id")
def display_columns(spark, sf):
    """Boxes beside what belongs to their page and to themselves."""
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_no"), F.col("o_orderstatus").alias("status"))
    li = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("line_id")).agg(F.min("l_returnflag").alias("cls"))
    b = _boxes(spark, sf).select("page_no", "line_id", Rect.of().height.alias("height"))
    return b.join(o, "page_no", "left").join(li, ["page_no", "line_id"], "left").select("page_no", "line_id", "height", "status", "cls")
