"""Rectangles on pages: reading order, paragraphs, line numbers, hOCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions import text
from lineloom.functions.geometry import Rect
from lineloom.operators import quantiles
from lineloom.operators.grouping import per_group


def reading_order(boxes: DataFrame, page: str = "page_no", key: str = "line_id") -> DataFrame:
    """(page, u, v): line u is read before line v.

    u precedes v if their columns overlap and u is higher, or if u is left of v and no line of the page separates them.
    A page's boxes are gathered in one row, so the table is read and shuffled once; the pairs are made within the row.
    """
    gathered = boxes.groupBy(page).agg(F.collect_list(F.struct(F.col(key).alias("k"), "y0", "x0", "y1", "x1")).alias("b"))

    def first(u: Column, v: Column) -> Column:
        over = (u["x0"] < v["x1"]) & (u["x1"] > v["x0"])
        between = lambda w: (w["y1"] >= F.least(u["y0"], v["y0"])) & (w["y0"] <= F.greatest(u["y1"], v["y1"])) & (w["x0"] < u["x1"]) & (w["x1"] > v["x0"])
        return F.when(over, u["y0"] < v["y0"]).otherwise((u["x1"] < v["x0"]) & ~F.exists("b", between))

    pairs = F.flatten(F.transform("b", lambda u: F.transform(F.filter("b", lambda v: first(u, v)), lambda v: F.struct(u["k"].alias("u"), v["k"].alias("v")))))
    return gathered.select(page, F.explode(pairs).alias("p")).select(page, "p.u", "p.v")


def topological_order(nodes: list[int], before: dict[int, list[int]]) -> list[int]:
    """Depth first over predecessors in ascending order; a cycle is cut where it closes."""
    seen, out = set(), []
    for start in nodes:
        stack = [(start, iter(()))] if start not in seen else []
        if stack:
            seen.add(start)
            stack = [(start, iter(before.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                out.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(before.get(nxt, ()))))
    return out


def in_reading_order(boxes: DataFrame, page: str = "page_no", key: str = "line_id") -> DataFrame:
    """(page, key, position) with the lines of each page in topological order of reading_order."""
    rows = boxes.select(page, F.col(key).cast("long").alias("k"), F.lit(None).cast("long").alias("u")).unionByName(reading_order(boxes, page, key).select(page, F.col("v").cast("long").alias("k"), F.col("u").cast("long").alias("u")))

    def order(group: list[tuple]) -> list[tuple]:
        before: dict[int, set[int]] = {}
        for k, u in group:
            before.setdefault(k, set()).update(() if u is None else (u,))
        return [(k, i) for i, k in enumerate(topological_order(sorted(before), {k: sorted(us) for k, us in before.items()}))]

    return per_group(rows, page, ["k", "u"], order, f"{key} long, position long")


def number_lines(ordered: DataFrame, page: str = "page_no", by: str = "position") -> DataFrame:
    """ordered with the label a segmentation gives to each line: 0x010000 plus its place, from 1."""
    return ordered.withColumn("label", (F.lit(0x010000) + F.row_number().over(Window.partitionBy(page).orderBy(by))).cast("long"))


def paragraph_breaks(boxes: DataFrame, xheight: Column, book: str = "book", y_up: bool = False) -> DataFrame:
    """boxes with par: whether a paragraph begins before the line.

    The line before is the last one in (page_no, line_id) order, also across pages of the book. In coordinates that grow
    downwards, as here, only a move upwards can break (a step down never does); y_up tests the other direction.
    """
    w = Window.partitionBy(book).orderBy("page_no", "line_id")
    dx, dy = F.col("x0") - F.lag("x0").over(w), F.col("y1") - F.lag("y0").over(w)
    dy = -dy if y_up else dy
    new = (dy <= 0) & ((F.abs(dy) > 5 * xheight) | (dx > 2 * xheight) | (F.abs(dx) > 10 * xheight))
    return boxes.withColumn("par", F.coalesce(new, F.lit(False)))


def median_xheight(measured: DataFrame, heights: DataFrame, least: int = 6) -> DataFrame:
    """(xheight): the median of the measured x-heights if there are `least` of them, else half the median line height.

    All lines count; both tables have one column, v.
    """
    median = lambda df, name: df.agg(F.count("v").alias(f"{name}_n")).join(quantiles.exact_quantiles(df, [], "v", [0.5]).select(F.col("value").alias(name)), how="left")
    both = median(measured, "own").join(median(heights, "line"))  # one row each
    return both.select(F.when(F.col("own_n") >= least, F.col("own")).otherwise(F.col("line") * 0.5).alias("xheight"))


def font_percent(xheight: Column, median: Column) -> Column:
    """Font size of a line in tens of percent of the median, 30 to 300."""
    p = F.greatest(F.lit(30.0), F.least(F.lit(300.0), xheight * 100.0 / median)).cast("long")
    return (F.lit(10) * F.floor((p + 5) / 10)).cast("long")


def hocr(lines: DataFrame, book: str = "book") -> DataFrame:
    """(book, html): one hOCR text for each book from lines (page_no, line_id, box, text, par, width, height).

    Lines without text have no span, though their break stays.
    """
    box = F.concat_ws(" ", "x0", "y0", "x1", "y1")
    span = F.when(F.col("text").isNotNull(), F.concat(F.lit("<span class='ocr_line' title='bbox "), box, F.lit("'>"), text.escape_html(F.col("text")), F.lit("</span><br />\n"))).otherwise("")
    line = F.concat(F.when(F.col("par"), "<p />\n").otherwise(""), span)
    pages = lines.select(book, "page_no", "width", "height", F.struct("line_id", line.alias("s")).alias("l")).groupBy(book, "page_no", "width", "height").agg(F.array_sort(F.collect_list("l")).alias("l"))
    page = F.concat(F.lit("<div class='ocr_page' title='bbox 0 0 "), F.col("width"), F.lit(" "), F.col("height"), F.lit("'>\n"), F.array_join(F.transform("l", lambda x: x["s"]), ""), F.lit("</div>\n"))
    books = pages.select(book, F.struct("page_no", page.alias("s")).alias("p")).groupBy(book).agg(F.array_sort(F.collect_list("p")).alias("p"))
    head, tail = "<!DOCTYPE html>\n<html><head><meta charset='utf-8' /><meta name='ocr-capabilities' content='ocr_line ocr_page' /></head><body>\n", "</body></html>\n"
    return books.select(book, F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["s"]), ""), F.lit(tail)).alias("html"))


def pack_intervals(segments: DataFrame, group: str, start: str = "start", stop: str = "stop", tie: str | None = None) -> DataFrame:
    """(group, tie, start, stop, row): longest first (of equal ones by start, stop and tie), each in the first row where it overlaps nothing."""
    tie = tie or start

    def pack(group: list[tuple]) -> list[tuple]:
        placed: list[list[tuple[int, int]]] = []
        out = []
        for _, a, b, t in sorted((a - b, a, b, t) for a, b, t in group):
            k = next((i for i, r in enumerate(placed) if all(b <= s or a >= e for s, e in r)), len(placed))
            if k == len(placed):
                placed.append([])
            placed[k].append((a, b))
            out.append((a, b, t, k))
        return out

    rows = segments.select(group, *(F.col(c).cast("long").alias(n) for n, c in (("a", start), ("b", stop), ("t", tie))))
    found = per_group(rows, group, ["a", "b", "t"], pack, "a long, b long, t long, row long")
    return found.select(group, *([F.col("t").alias(tie)] if tie != start else []), F.col("a").alias(start), F.col("b").alias(stop), "row")


def fit_line(boxes: DataFrame, by: str) -> DataFrame:
    """(by, mean_height, slope, offset): 40th percentile of the heights and the least squares line of the centres."""
    r = Rect.of()
    return boxes.groupBy(by).agg(
        F.round(F.percentile(r.height, F.lit(0.4)), 6).alias("mean_height"), F.round(F.regr_slope(r.ycenter, r.xcenter), 6).alias("slope"), F.round(F.regr_intercept(r.ycenter, r.xcenter), 6).alias("offset")
    )
