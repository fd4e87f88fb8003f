"""Queries on images: the 64 values of an embedding are an image of 8 x 8."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lineloom.operators import imaging, segmentation
from lineloom.operators import raster as ra
from lineloom.plans.registry import query
from lineloom.plans.text import _table
from lineloom.sources.files import encode_png


def _px(spark, sf):
    return ra.pixels(_table(spark, sf, "embeddings"), "embedding", 8, "vec_id")


def _bin(spark, sf):
    return ra.binarized(_px(spark, sf))


def _labels(spark, sf, by="(x div 2 + 1) * v"):
    """Stripes two pixels wide where the image is on."""
    return _bin(spark, sf).selectExpr("image_id", "y", "x", f"{by} as label")


PX = "SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"
BIN = f"SELECT image_id, y, x, CAST(v > 0.5 * (min(v) OVER (PARTITION BY image_id) + max(v) OVER (PARTITION BY image_id)) AS INT) AS v FROM ({PX})"
LAB = f"SELECT image_id, y, x, (x // 2 + 1) * v AS label FROM ({BIN})"


@query(f"SELECT * FROM ({BIN})")
def binarize_midrange(spark, sf):
    return _bin(spark, sf)


@query(f"WITH p AS ({PX}), t AS (SELECT image_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.9) AS hi FROM p GROUP BY image_id) SELECT image_id, y, x, round(greatest(0.0, least(1.0, (v - lo) / (hi - lo))), 9) AS v FROM p JOIN t USING (image_id)")
def rescale_percentiles(spark, sf):
    return ra.rescaled(_px(spark, sf)).withColumn("v", F.round("v", 9))


@query(f"WITH n AS (SELECT image_id, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM ({PX}) WINDOW w AS (PARTITION BY image_id)) SELECT image_id, round(avg(CASE WHEN v < 0.05 OR v > 0.95 THEN 1.0 ELSE 0.0 END), 9) AS extreme, avg(CASE WHEN v < 0.05 OR v > 0.95 THEN 1.0 ELSE 0.0 END) > 0.95 AS is_binary FROM n GROUP BY image_id")
def already_binary(spark, sf):
    return ra.is_binary_already(_px(spark, sf))


def _filter_sql(f: str, src: str) -> str:
    row = f"SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM ({src})"
    return f"SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM ({row})"


@query(_filter_sql("max", BIN))
def dilation(spark, sf):
    return ra.dilated(_bin(spark, sf), 3, 3)


@query(_filter_sql("min", BIN))
def erosion(spark, sf):
    return ra.eroded(_bin(spark, sf), 3, 3)


@query(_filter_sql("max", _filter_sql("min", PX)))
def gray_opening(spark, sf):
    return ra.opened(_px(spark, sf), 3, 3)


@query(_filter_sql("min", _filter_sql("max", PX)))
def gray_closing(spark, sf):
    return ra.closed(_px(spark, sf), 3, 3)


@query(f"WITH a AS ({BIN}), b AS ({_filter_sql('min', BIN)}) SELECT a.image_id, a.y, a.x, least(a.v, 1 - b.v) AS v FROM a JOIN b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x")
def mask_and_not(spark, sf):
    return ra.combined(_bin(spark, sf), ra.eroded(_bin(spark, sf), 3, 3), "and not")


@query(f"SELECT image_id, label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS mass FROM ({LAB}) WHERE label <> 0 GROUP BY ALL")
def component_extents(spark, sf):
    return ra.extents(_labels(spark, sf))


@query(f"SELECT image_id, y, round(avg(v), 6) AS mean, round(sum(v), 6) AS sum FROM ({BIN}) GROUP BY ALL")
def row_projection(spark, sf):
    return ra.projection(_bin(spark, sf), "y")


ROWS = f"SELECT image_id, y, x, (y // 2 + 1) * v AS label FROM ({BIN})"


@query(f"SELECT DISTINCT a.image_id, a.label AS label1, b.label AS label2 FROM ({LAB}) a JOIN ({ROWS}) b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x")
def label_correspondences(spark, sf):
    return ra.correspondences(_labels(spark, sf), _labels(spark, sf, "(y div 2 + 1) * v"))


@query(f"WITH c AS (SELECT a.image_id, a.label, max(b.label) AS m, count(DISTINCT b.label) AS n FROM ({LAB}) a JOIN ({ROWS}) b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x WHERE a.label <> 0 AND b.label <> 0 GROUP BY ALL) SELECT r.image_id, y, x, coalesce(CASE WHEN n > 1 THEN 99 ELSE m END, 0) AS label FROM ({LAB}) r LEFT JOIN c ON r.image_id = c.image_id AND r.label = c.label")
def label_propagation(spark, sf):
    return ra.propagated(_labels(spark, sf), _labels(spark, sf, "(y div 2 + 1) * v"), 99)


MARK = f"SELECT image_id, y, x, CASE WHEN y = 0 THEN v ELSE 0 END AS v FROM ({BIN})"


def _marked_sql(which: str) -> str:
    return f"SELECT image_id, y, x, label FROM ({LAB}) r WHERE label <> 0 AND {which} EXISTS (SELECT 1 FROM ({LAB}) l JOIN ({MARK}) m ON l.image_id = m.image_id AND l.y = m.y AND l.x = m.x WHERE m.v <> 0 AND l.label = r.label AND l.image_id = r.image_id)"


@query(_marked_sql(""))
def keep_marked(spark, sf):
    mark = _bin(spark, sf).withColumn("v", F.when(F.col("y") == 0, F.col("v")).otherwise(0))
    return ra.marked(_labels(spark, sf), mark).select("image_id", "y", "x", "label")


@query(_marked_sql("NOT"))
def remove_marked(spark, sf):
    mark = _bin(spark, sf).withColumn("v", F.when(F.col("y") == 0, F.col("v")).otherwise(0))
    return ra.marked(_labels(spark, sf), mark, keep=False).select("image_id", "y", "x", "label")


@query(f"WITH p AS ({LAB}), n AS (SELECT image_id, label, unnest([lead(label) OVER (PARTITION BY image_id, y ORDER BY x), lead(label) OVER (PARTITION BY image_id, x ORDER BY y)]) AS o FROM p) SELECT DISTINCT image_id, least(label, o) AS a, greatest(label, o) AS b FROM n WHERE o IS NOT NULL")
def label_neighbours(spark, sf):
    return ra.neighbours(_labels(spark, sf))


@query(f"WITH e AS (SELECT image_id, label, count(*) AS score FROM ({LAB}) WHERE label <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label DESC) AS rank FROM e WHERE score > 3) SELECT image_id, label, score, rank FROM r WHERE rank <= 2")
def best_regions(spark, sf):
    return ra.best_regions(ra.extents(_labels(spark, sf)), F.col("mass"), 3, 2).select("image_id", "label", "score", "rank")


@query(f"SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY label) - 1 AS label FROM ({LAB})")
def renumber_labels(spark, sf):
    return ra.renumbered(_labels(spark, sf))


@query(f"WITH l AS (SELECT image_id, y, x, (4 - x // 2) * v AS label FROM ({BIN})), e AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY (min(x) + max(x) + 1) / 2, label) AS place FROM l WHERE label <> 0 GROUP BY image_id, label) SELECT l.image_id, y, x, coalesce(place, 0) AS label FROM l LEFT JOIN e ON l.image_id = e.image_id AND l.label = e.label")
def renumber_by_x(spark, sf):
    return ra.renumbered_by_x(_labels(spark, sf, "(4 - x div 2) * v"))


@query(f"WITH l AS ({LAB}), s AS (SELECT * FROM l WHERE label <> 0), b AS (SELECT b.image_id, b.y, b.x, s.label, row_number() OVER (PARTITION BY b.image_id, b.y, b.x ORDER BY (s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x), s.label) AS k FROM l b JOIN s ON s.image_id = b.image_id AND (s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x) < 4 WHERE b.label = 0) SELECT l.image_id, l.y, l.x, CASE WHEN l.label <> 0 THEN l.label ELSE coalesce(b.label, 0) END AS label FROM l LEFT JOIN b ON b.k = 1 AND l.image_id = b.image_id AND l.y = b.y AND l.x = b.x")
def spread_labels(spark, sf):
    return ra.spread(_labels(spark, sf), 2)


_STATS = "SELECT p_partkey, p_size * 250 AS height, CAST(trunc(p_retailprice) * 7 % 12000 AS BIGINT) AS width, p_partkey % 7 AS mean, p_partkey % 5 AS median, p_partkey * 37 % 90000 AS components FROM part"


@query(
    f"SELECT p_partkey, CASE WHEN mean < median THEN 'may be inverted' WHEN height < 600 THEN 'not tall enough' WHEN height > 10000 THEN 'too tall' WHEN width < 600 THEN 'too narrow' WHEN width > 10000 THEN 'too wide' WHEN components < 10 THEN 'too few components' WHEN components > floor(height * width / 900) THEN 'too many components' END AS reject_reason FROM ({_STATS})"
)
def page_validity(spark, sf):
    """Every part's numbers as those of a page; all of the rules have cases."""
    p, k = _table(spark, sf, "part"), F.col("p_partkey")
    stats = p.select(k, (F.col("p_size") * 250).alias("height"), (F.col("p_retailprice").cast("long") * 7 % 12000).alias("width"), (k % 7).alias("mean"), (k % 5).alias("median"), (k * 37 % 90000).alias("components"))
    return ra.page_reject_reason(stats).select("p_partkey", "reject_reason")


_LINE_STATS = "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) * 5 AS height, CAST(trunc(l_extendedprice) AS BIGINT) % 5000 AS width, l_partkey % 9 AS mean, l_suppkey % 4 AS median, l_partkey % 90 AS components FROM lineitem"


@query(
    f"SELECT l_orderkey, l_linenumber, CASE WHEN height < 20 THEN 'not tall enough' WHEN height > 200 THEN 'too tall' WHEN width < 1.5 * height THEN 'too narrow' WHEN width > 4000 THEN 'too wide' WHEN mean < median THEN 'may be inverted' WHEN components < 0.5 * width / height THEN 'too few components' WHEN components > 4 * (width / height) THEN 'too many components' END AS reject_reason FROM ({_LINE_STATS})"
)
def line_validity(spark, sf):
    """The same for lines."""
    li = _table(spark, sf, "lineitem")
    stats = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 5).alias("height"), (F.col("l_extendedprice").cast("long") % 5000).alias("width"), (F.col("l_partkey") % 9).alias("mean"), (F.col("l_suppkey") % 4).alias("median"), (F.col("l_partkey") % 90).alias("components"))
    return ra.line_reject_reason(stats).select("l_orderkey", "l_linenumber", "reject_reason")


@query(
    """WITH RECURSIVE px AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings) WHERE v > 0.5 * (lo + hi)),
r AS (SELECT vec_id, i, i AS j FROM px UNION SELECT r.vec_id, r.i, b.i FROM r JOIN px a ON a.vec_id = r.vec_id AND a.i = r.j JOIN px b ON b.vec_id = a.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
c AS (SELECT vec_id, i, min(j) AS root FROM r GROUP BY vec_id, i)
SELECT vec_id, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label, min(i // 8) AS y0, min(i % 8) AS x0, max(i // 8) + 1 AS y1, max(i % 8) + 1 AS x1, CAST(NULL AS VARCHAR) AS error FROM c GROUP BY vec_id, root"""
)
def connected_components(spark, sf):
    """Boxes of the connected components of every binarised image."""
    f = lambda a: [tuple(int(v) for v in row) for row in imaging.boxes(imaging.label(a > 0.5 * (a.min() + a.max())))]
    return imaging.each_image(_table(spark, sf, "embeddings"), f, "label long, y0 long, x0 long, y1 long, x1 long", "embedding", 8, "vec_id")


@query()
def page_binarize(spark, sf):
    """Local white level, percentile scaling and threshold of every image; share of white and skew."""

    def f(a):
        b = imaging.binarize(a, window=4)
        return [(float(b.mean()), imaging.skew(1.0 - b), float(imaging.sauvola(a, 3).mean()))]

    return imaging.each_image(_table(spark, sf, "embeddings"), f, "white double, skew double, sauvola double", "embedding", 8, "vec_id")


#: Planted pages, one a supplier: 3 to 6 lines in each of one or two columns, of boxes 14 high and 11 wide.
PLANTED_SQL = """SELECT page_id, n, c, j, 40 + 30 * j AS y0, 40 + 420 * c AS x0, 18 + (page_id * 7 + j * 5 + c * 3) % 8 AS m
FROM (SELECT page_id, n, c, unnest(range(n)) AS j FROM (SELECT s_suppkey AS page_id, 3 + s_suppkey % 4 AS n, unnest(range(1 + s_suppkey % 2)) AS c FROM supplier))"""
LINES_SQL = f"SELECT page_id, 65536 + c * n + j + 1 AS label, y0, x0, y0 + 14 AS y1, x0 + 14 * (m - 1) + 8 * ((m - 1) // 5) + 11 AS x1, m FROM ({PLANTED_SQL})"


def _planted_pages(spark, sf):
    def page(k: int) -> bytes:
        n, columns = 3 + k % 4, 1 + k % 2
        a = np.ones((80 + 30 * n, 60 + 420 * columns))
        for c in range(columns):
            for j in range(n):
                for i in range(18 + (k * 7 + j * 5 + c * 3) % 8):
                    y, x = 40 + 30 * j, 40 + 420 * c + 14 * i + 8 * (i // 5)
                    a[y : y + 14, x : x + 11] = 0
        return encode_png(a)

    def draw(parts):
        for part in parts:
            yield pd.DataFrame({"page_id": part["page_id"], "content": [page(int(k)) for k in part["page_id"]]})

    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id")).repartition(max(16, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(draw, "page_id long, content binary")


@query(f"SELECT page_id, label, y0, x0, y1, x1 FROM ({LINES_SQL})")
def text_line_segmentation(spark, sf):
    """Text lines of planted pages of one and two columns, numbered in reading order."""
    found = segmentation.segment_pages(_planted_pages(spark, sf)).select("page_id", F.explode("lines").alias("l"))
    return found.select("page_id", "l.label", "l.y0", "l.x0", "l.y1", "l.x1")


@query(f"SELECT page_id, label, CAST(m * 154 AS BIGINT) AS n FROM ({LINES_SQL}) UNION ALL SELECT page_id, 16777215, CAST((80 + 30 * max(n)) * (60 + 420 * (max(c) + 1)) - sum(m) * 154 AS BIGINT) FROM ({PLANTED_SQL}) GROUP BY page_id")
def segmentation_written(spark, sf):
    """Pixels of every label in the label maps as they are written: background white, lines by label."""

    def count(a):
        return [(int(v), int(n)) for v, n in zip(*np.unique(a, return_counts=True), strict=True)]

    return imaging.each_png(segmentation.segment_pages(_planted_pages(spark, sf)), count, "label long, n long", "segmentation", "page_id").drop("error")


@query(f"SELECT page_id, label, 20 AS height, x1 - x0 + 6 AS width, CAST(m * 154 AS BIGINT) AS ink FROM ({LINES_SQL})")
def line_crops(spark, sf):
    """Size and ink of every cropped line."""
    lines = segmentation.segment_pages(_planted_pages(spark, sf)).select("page_id", F.explode("lines").alias("l")).select((F.col("page_id") * 100000 + F.col("l.label")).alias("key"), F.col("l.image").alias("image"))
    found = imaging.each_png(lines, lambda a: [(*a.shape, int((a < 0.5).sum()))], "height long, width long, ink long", "image", "key")
    return found.select(((F.col("key") - F.col("key") % 100000) / 100000).cast("long").alias("page_id"), (F.col("key") % 100000).alias("label"), "height", "width", "ink")


@query()
def line_normalization(spark, sf):
    """Height, width and ink of each image straightened and scaled as a line."""

    def f(a):
        n = imaging.normalized_line((a - a.min()) / max(a.max() - a.min(), 1e-9), 16)
        return [(n.shape[0], n.shape[1], round(float(n.sum()), 6))]

    return imaging.each_image(_table(spark, sf, "embeddings"), f, "height long, width long, ink double", "embedding", 8, "vec_id")
