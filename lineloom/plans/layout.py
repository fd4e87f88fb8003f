"""Queries on rectangles, pages and reports. Boxes are made from lineitem: an order is a page, its lines are lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions import geometry
from lineloom.functions.geometry import Rect
from lineloom.operators import layout, sorting
from lineloom.plans.registry import query
from lineloom.plans.text import _table
from lineloom.sources import files

BOXES_SQL = """SELECT l_orderkey AS page_no, l_linenumber AS line_id, y0, x0, y0 + 4 + CAST(trunc(l_quantity) AS BIGINT) % 10 AS y1, x0 + 20 + CAST(trunc(l_quantity) AS BIGINT) AS x1
FROM (SELECT *, l_linenumber * 10 + l_suppkey % 7 AS y0, (l_partkey % 40) * 5 AS x0 FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))"""


def _boxes(spark, sf):
    li = _table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")))
    q = F.col("l_quantity").cast("long")
    b = li.select(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("line_id"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7).alias("y0"), (F.col("l_partkey") % 40 * 5).alias("x0"), q.alias("q"))
    return b.select("page_no", "line_id", "y0", "x0", (F.col("y0") + 4 + F.col("q") % 10).alias("y1"), (F.col("x0") + 20 + F.col("q")).alias("x1"))


@query(f"SELECT page_no, line_id, y1 - y0 AS height, x1 - x0 AS width, (y1 - y0) * (x1 - x0) AS area, round((y1 - y0) / (x1 - x0), 9) AS aspect, (y0 + y1) / 2 AS ycenter, (x0 + x1) / 2 AS xcenter, y0 - 2 AS pad_y0, 1000 - y1 - 1 AS math_y0 FROM ({BOXES_SQL})")
def rect_measures(spark, sf):
    r = Rect.of()
    return _boxes(spark, sf).select("page_no", "line_id", r.height.alias("height"), r.width.alias("width"), r.area.alias("area"), F.round(r.aspect, 9).alias("aspect"), r.ycenter.alias("ycenter"), r.xcenter.alias("xcenter"), r.pad(2).y0.alias("pad_y0"), r.math(1000).y0.alias("math_y0"))


PAIR_SQL = f"WITH b AS ({BOXES_SQL}) SELECT u.page_no, u.line_id AS u, v.line_id AS v, u.y0 AS uy0, u.x0 AS ux0, u.y1 AS uy1, u.x1 AS ux1, v.y0 AS vy0, v.x0 AS vx0, v.y1 AS vy1, v.x1 AS vx1 FROM b u JOIN b v ON u.page_no = v.page_no AND u.line_id < v.line_id"


@query(
    f"SELECT page_no, u, v, ux1 >= vx0 AND vx1 >= ux0 AS xover, greatest(0, least(ux1, vx1) - greatest(ux0, vx0)) AS xo, greatest(0, least(uy1, vy1) - greatest(uy0, vy0)) AS yo, (least(uy1, vy1) > greatest(uy0, vy0) AND least(ux1, vx1) > greatest(ux0, vx0)) AS meets, least(uy0, vy0) AS un_y0, greatest(ux1, vx1) AS un_x1 FROM ({PAIR_SQL})"
)
def rect_overlaps(spark, sf):
    b = _boxes(spark, sf)
    side = lambda p: b.select("page_no", F.col("line_id").alias(p), *Rect.of().columns(p + "_"))
    u, v = Rect.of("u_"), Rect.of("v_")
    inner = u.intersect(v)
    return side("u").join(side("v"), "page_no").where("u < v").select("page_no", "u", "v", u.xoverlaps(v).alias("xover"), u.xoverlap(v).alias("xo"), u.yoverlap(v).alias("yo"), (inner.area > 0).alias("meets"), u.union(v).y0.alias("un_y0"), u.union(v).x1.alias("un_x1"))


@query(
    f"WITH b AS ({BOXES_SQL}), p AS (SELECT u.page_no, u.line_id AS u, v.line_id AS v, u.x0 < v.x1 AND u.x1 > v.x0 AS over, u.y0 AS uy0, v.y0 AS vy0, u.y1 AS uy1, v.y1 AS vy1, u.x0 AS ux0, u.x1 AS ux1, v.x0 AS vx0, v.x1 AS vx1 FROM b u JOIN b v ON u.page_no = v.page_no) SELECT page_no, u, v FROM p WHERE over AND uy0 < vy0 UNION ALL SELECT page_no, u, v FROM p WHERE NOT over AND ux1 < vx0 AND NOT EXISTS (SELECT 1 FROM b w WHERE w.page_no = p.page_no AND w.y1 >= least(uy0, vy0) AND w.y0 <= greatest(uy1, vy1) AND w.x0 < ux1 AND w.x1 > vx0)"
)
def reading_order_pairs(spark, sf):
    return layout.reading_order(_boxes(spark, sf))


@query()
def reading_order_lines(spark, sf):
    """Lines of each page in topological order."""
    return layout.number_lines(layout.in_reading_order(_boxes(spark, sf)))


@query(
    f"WITH b AS (SELECT page_no % 16 AS book, * FROM ({BOXES_SQL})), l AS (SELECT book, page_no, line_id, x0 - lag(x0) OVER w AS dx, y1 - lag(y0) OVER w AS dy FROM b WINDOW w AS (PARTITION BY book ORDER BY page_no, line_id)) SELECT book, page_no, line_id, coalesce(dy <= 0 AND (abs(dy) > 50 OR dx > 20 OR abs(dx) > 100), false) AS par FROM l"
)
def paragraph_breaks(spark, sf):
    b = _boxes(spark, sf).withColumn("book", F.col("page_no") % 16)
    return layout.paragraph_breaks(b, F.lit(10)).select("book", "page_no", "line_id", "par")


@query(f"SELECT page_no, round(quantile_cont(y1 - y0, 0.4), 6) AS mean_height, round(regr_slope((y0 + y1) / 2, (x0 + x1) / 2), 6) AS slope, round(regr_intercept((y0 + y1) / 2, (x0 + x1) / 2), 6) AS \"offset\" FROM ({BOXES_SQL}) GROUP BY page_no HAVING var_pop(x0 + x1) > 0")
def line_geometry_fit(spark, sf):
    spread = _boxes(spark, sf).groupBy("page_no").agg((F.min(F.col("x0") + F.col("x1")) < F.max(F.col("x0") + F.col("x1"))).alias("ok")).where("ok").select("page_no")
    return layout.fit_line(_boxes(spark, sf).join(spread, "page_no", "left_semi"), "page_no")


@query(f"SELECT page_no, line_id, round(((y0 + y1) / 2 - 40) / 8, 6) AS rel_y, round((x1 - x0) / 8, 6) AS rel_w, round(greatest(-1.0, least(1.0, ln((y1 - y0) / 8))), 6) AS geo_h FROM ({BOXES_SQL})")
def relative_char_geometry(spark, sf):
    g = _boxes(spark, sf).select("page_no", "line_id", *geometry.relative_geometry(Rect.of(), F.lit(8), F.lit(0), F.lit(40)))
    return g.select("page_no", "line_id", F.round("rel_y", 6).alias("rel_y"), F.round("rel_w", 6).alias("rel_w"), F.round("geo_h", 6).alias("geo_h"))


@query(f"SELECT page_no, count(*) AS n, count(*) FILTER (WHERE (y1 - y0) >= 8 AND (x1 - x0) >= 16) AS n_lines, count(*) FILTER (WHERE sqrt((y1 - y0) * (x1 - x0)) BETWEEN 4 AND 32) AS n_band FROM ({BOXES_SQL}) GROUP BY page_no")
def box_size_filters(spark, sf):
    r = Rect.of()
    return _boxes(spark, sf).groupBy("page_no").agg(F.count("*").alias("n"), F.count_if((r.height >= 8) & (r.width >= 16)).alias("n_lines"), F.count_if(F.sqrt(r.area).between(4, 32)).alias("n_band"))


_HEAD = "<!DOCTYPE html>\n<html><head><meta charset='utf-8' /><meta name='ocr-capabilities' content='ocr_line ocr_page' /></head><body>\n".replace("'", "''")
_HOCR = f"""WITH l AS (SELECT conv_id % 8 AS book, conv_id AS page_no, turn AS line_id, text, turn * 30 AS y0, turn * 30 + 20 AS y1 FROM conversations),
p AS (SELECT *, coalesce(y1 - lag(y0) OVER w <= 0 AND abs(y1 - lag(y0) OVER w) > 50, false) AS par FROM l WINDOW w AS (PARTITION BY book ORDER BY page_no, line_id)),
s AS (SELECT *, CASE WHEN par THEN '<p />' || chr(10) ELSE '' END || CASE WHEN text IS NULL THEN '' ELSE '<span class=''ocr_line'' title=''bbox 10 ' || y0 || ' 800 ' || y1 || chr(39) || '>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</span><br />' || chr(10) END AS s FROM p),
g AS (SELECT book, page_no, '<div class=''ocr_page'' title=''bbox 0 0 1000 2000''>' || chr(10) || string_agg(s, '' ORDER BY line_id, encode(s)) || '</div>' || chr(10) AS s FROM s GROUP BY book, page_no)
SELECT book, '{_HEAD}' || string_agg(s, '' ORDER BY page_no) || '</body></html>' || chr(10) AS html FROM g GROUP BY book"""


@query(_HOCR)
def hocr_report(spark, sf):
    """One hOCR text for each book: conversations are pages, turns are lines."""
    c = _table(spark, sf, "conversations").select((F.col("conv_id") % 8).alias("book"), F.col("conv_id").alias("page_no"), F.col("turn").alias("line_id"), "text")
    lines = c.withColumns({"y0": F.col("line_id") * 30, "x0": F.lit(10), "y1": F.col("line_id") * 30 + 20, "x1": F.lit(800), "width": F.lit(1000), "height": F.lit(2000)})
    return layout.hocr(layout.paragraph_breaks(lines, F.lit(10)))


@query(
    f"""WITH RECURSIVE s AS (SELECT page_no, line_id, x0 AS start, x1 AS stop, row_number() OVER (PARTITION BY page_no ORDER BY x0 - x1, x0, x1, line_id) AS k FROM ({BOXES_SQL})),
p AS (SELECT page_no, k, CAST(0 AS BIGINT) AS r, [{{'r': CAST(0 AS BIGINT), 'a': start, 'b': stop}}] AS placed FROM s WHERE k = 1 UNION ALL SELECT page_no, k, r, list_append(placed, {{'r': r, 'a': a, 'b': b}}) FROM (SELECT p.page_no, s.k, s.start AS a, s.stop AS b, p.placed,
list_min(list_filter(range(s.k), lambda i: len(list_filter(p.placed, lambda q: q.r = i AND NOT (s.stop <= q.a OR s.start >= q.b))) = 0)) AS r FROM p JOIN s ON s.page_no = p.page_no AND s.k = p.k + 1))
SELECT s.page_no, s.line_id, s.start, s.stop, p.r AS row FROM s JOIN p ON p.page_no = s.page_no AND p.k = s.k"""
)
def interval_packing(spark, sf):
    """Each box of a page in the first row where it overlaps nothing, longest first."""
    return layout.pack_intervals(_boxes(spark, sf).select("page_no", "line_id", F.col("x0").alias("start"), F.col("x1").alias("stop")), "page_no", tie="line_id")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'too small' WHEN p_size > 45 THEN 'too large' WHEN p_retailprice < 905 THEN 'too cheap' END AS reject_reason FROM part")
def validate_rules(spark, sf):
    p = _table(spark, sf, "part")
    return files.validate(p, {"too small": F.col("p_size") >= 5, "too large": F.col("p_size") <= 45, "too cheap": F.col("p_retailprice") >= 905}).select("p_partkey", "reject_reason")


_NAME = "printf('%04d.%010d', CAST(conv_id AS INT), CAST(turn AS INT))"
_NAMED = f"SELECT conv_id, {_NAME} AS name, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"
_TABLES = f"SELECT conv_id, name, text, row_number() OVER (PARTITION BY conv_id ORDER BY name, replace(replace(text, '&', '&amp;'), '<', '&lt;')) - 1 AS table_no FROM ({_NAMED})"


def _correction_pages(spark, sf):
    c = _table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    lines = c.select("conv_id", files.line_name(F.col("conv_id").cast("int"), F.col("turn").cast("int")).alias("name"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("image"), "text")
    return files.correction_html(lines, ["conv_id"])


@query(f"SELECT conv_id, table_no, name, md5(text) AS image, text FROM ({_TABLES})")
def correction_round_trip(spark, sf):
    """Names, images and texts of all lines, written as pages for correction and read from them again."""
    found = files.corrections(_correction_pages(spark, sf), "conv_id")
    return found.select("conv_id", F.col("table_no").cast("long").alias("table_no"), "name", F.lower(F.hex("image")).alias("image"), "text")


@query(f"SELECT conv_id, table_no, unnest([0, 1, 2]) AS row_no, unnest([name, '', trim(replace(replace(text, '&', '&amp;'), '<', '&lt;'))]) AS text FROM ({_TABLES})")
def html_table_rows(spark, sf):
    """Every row of every table of the same pages, without tags."""
    return files.html_cells(_correction_pages(spark, sf), "conv_id")


@query(f"SELECT name, name || chr(9) || text AS value FROM ({_NAMED})")
def correction_lines(spark, sf):
    """The same lines as plain text to be edited."""
    c = _table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    return files.correction_text(c.select(files.line_name(F.col("conv_id").cast("int"), F.col("turn").cast("int")).alias("name"), "text"))


@query("SELECT conv_id, list(substring(text, 1, 100) ORDER BY k) AS lines FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE length(text) >= 20) WHERE k <= 10 GROUP BY conv_id")
def result_gallery(spark, sf):
    """The first ten longer lines of every page, cut at 100 characters: what a gallery shows."""
    return files.gallery(_table(spark, sf, "conversations").withColumnRenamed("turn", "line_id"), "conv_id")


@query(f"WITH b AS (SELECT (y1 - y0) * 0.5 AS v, y1 - y0 AS h FROM ({BOXES_SQL})) SELECT CASE WHEN count(*) FILTER (WHERE h < 8) >= 6 THEN quantile_cont(v, 0.5) FILTER (WHERE h < 8) ELSE 0.5 * quantile_cont(h, 0.5) END AS xheight FROM b")
def median_xheight(spark, sf):
    """Median x-height of the lines that have one."""
    h = _boxes(spark, sf).select((F.col("y1") - F.col("y0")).alias("h"))
    return layout.median_xheight(h.where("h < 8").select((F.col("h") * 0.5).alias("v")), h.select(F.col("h").alias("v")))


@query(f"SELECT page_no, line_id, (y1 - y0) * (x1 - x0) AS area, row_number() OVER (ORDER BY (y1 - y0) * (x1 - x0) DESC, page_no, line_id) AS rank FROM ({BOXES_SQL})")
def boxes_by_area(spark, sf):
    """All boxes in the order of a computed property."""
    r = Rect.of()
    return sorting.ranked(_boxes(spark, sf).select("page_no", "line_id", r.area.alias("area")), F.desc("area"), "page_no", "line_id")
