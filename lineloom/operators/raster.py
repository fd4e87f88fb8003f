"""Images and label maps in long form (image_id, y, x, v): what SQL can do on pixels without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE, PIXEL = "image_id", ["image_id", "y", "x"]


def pixels(images: DataFrame, array: str, width: int, image_id: str) -> DataFrame:
    """Long form of images stored as one row-major array."""
    cell = images.select(F.col(image_id).alias(IMAGE), F.posexplode(array).alias("i", "v"))
    return cell.select(IMAGE, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def normalized(px: DataFrame) -> DataFrame:
    """Each image stretched to 0..1; constant images to 0."""
    w = Window.partitionBy(IMAGE)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return px.withColumn("v", F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)))


def binarized(px: DataFrame, frac: float = 0.5) -> DataFrame:
    """1 where v is above the middle of the image's range."""
    w = Window.partitionBy(IMAGE)
    return px.withColumn("v", (F.col("v") > F.lit(frac) * (F.min("v").over(w) + F.max("v").over(w))).cast("int"))


def percentile_range(px: DataFrame, lo: float = 0.05, hi: float = 0.9) -> DataFrame:
    """(image_id, lo, hi) with linear interpolation."""
    return px.groupBy(IMAGE).agg(F.percentile("v", F.lit(lo)).alias("lo"), F.percentile("v", F.lit(hi)).alias("hi"))


def rescaled(px: DataFrame, lo: float = 0.05, hi: float = 0.9) -> DataFrame:
    """v moved so that the two percentiles are 0 and 1, and clipped."""
    p = percentile_range(px, lo, hi)
    x = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return px.join(p, IMAGE).select(*PIXEL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("v"))


def is_binary_already(px: DataFrame, extreme: float = 0.05, share: float = 0.95) -> DataFrame:
    """(image_id, extreme, is_binary): share of pixels near either end of the normalised range."""
    v = F.col("v")
    return normalized(px).groupBy(IMAGE).agg(F.round(F.avg(((v < extreme) | (v > 1 - extreme)).cast("double")), 9).alias("extreme")).withColumn("is_binary", F.col("extreme") > share)


def box_filter(px: DataFrame, height: int, width: int, how: str = "max", edge: float | None = None) -> DataFrame:
    """Greatest or least value in a box around each pixel, first along rows and then along columns.

    edge=None: beyond the border there is nothing; else the border is surrounded by that constant. The box reaches
    size // 2 back and size - 1 - size // 2 ahead.
    """
    f = F.max if how == "max" else F.min
    pick = F.greatest if how == "max" else F.least
    out = px
    for size, along, across in ((width, "x", "y"), (height, "y", "x")):
        back, ahead = size // 2, size - 1 - size // 2
        w = Window.partitionBy(IMAGE, across).orderBy(along)
        v = f("v").over(w.rowsBetween(-back, ahead))
        if edge is not None:
            full = F.count("v").over(w.rowsBetween(-back, ahead)) == size
            v = F.when(full, v).otherwise(pick(v, F.lit(edge).cast(px.schema["v"].dataType)))
        out = out.withColumn("v", v)
    return out


def dilated(px: DataFrame, height: int, width: int) -> DataFrame:
    return box_filter(px, height, width, "max")


def eroded(px: DataFrame, height: int, width: int) -> DataFrame:
    return box_filter(px, height, width, "min")


def opened(px: DataFrame, height: int, width: int) -> DataFrame:
    return dilated(eroded(px, height, width), height, width)


def closed(px: DataFrame, height: int, width: int) -> DataFrame:
    return eroded(dilated(px, height, width), height, width)


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Pixel-wise "and" (least), "or" (greatest) or "and not" of two aligned images."""
    v = {"and": F.least("v", "v2"), "or": F.greatest("v", "v2"), "and not": F.least(F.col("v"), 1 - F.col("v2"))}[how]
    return a.join(b.withColumnRenamed("v", "v2"), PIXEL).select(*PIXEL, v.alias("v"))


def extents(labels: DataFrame) -> DataFrame:
    """(image_id, label, box, mass) of every label but 0."""
    return labels.where("label <> 0").groupBy(IMAGE, "label").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.count("*").alias("mass"))


def projection(px: DataFrame, axis: str) -> DataFrame:
    """Mean and sum of each row ("y") or column ("x")."""
    return px.groupBy(IMAGE, axis).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.sum("v"), 6).alias("sum"))


def correspondences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, label1, label2): the labels that lie on one another."""
    return a.withColumnRenamed("label", "label1").join(b.withColumnRenamed("label", "label2"), PIXEL).select(IMAGE, "label1", "label2").distinct()


def propagated(regions: DataFrame, labels: DataFrame, conflict: int | None = None) -> DataFrame:
    """Regions with the label that overlaps them; of several the greatest, or `conflict` if given. No label: 0."""
    c = correspondences(regions, labels).where("label1 <> 0 and label2 <> 0").groupBy(IMAGE, F.col("label1").alias("label")).agg(F.max("label2").alias("m"), F.count("*").alias("n"))
    new = F.col("m") if conflict is None else F.when(F.col("n") > 1, F.lit(conflict)).otherwise(F.col("m"))
    return regions.join(c, [IMAGE, "label"], "left").select(*PIXEL, F.coalesce(new, F.lit(0)).alias("label"))


def marked(regions: DataFrame, markers: DataFrame, keep: bool = True) -> DataFrame:
    """The pixels of the regions that a marker touches (or, keep=False, of the others)."""
    hit = regions.where("label <> 0").join(markers.where("v <> 0").select(*PIXEL), PIXEL, "left_semi").select(IMAGE, "label").distinct()
    return regions.where("label <> 0").join(hit, [IMAGE, "label"], "left_semi" if keep else "left_anti")


def neighbours(labels: DataFrame) -> DataFrame:
    """(image_id, a <= b): labels of pixels that touch sideways or up and down."""
    w = lambda along, across: Window.partitionBy(IMAGE, across).orderBy(along)
    pairs = labels.select(IMAGE, "label", F.lead("label").over(w("x", "y")).alias("r"), F.lead("label").over(w("y", "x")).alias("d"))
    each = pairs.select(IMAGE, "label", F.explode(F.array("r", "d")).alias("o")).where("o is not null")
    return each.select(IMAGE, F.least("label", "o").alias("a"), F.greatest("label", "o").alias("b")).distinct()


def best_regions(regions: DataFrame, score: Column, least: float = 0, nbest: int = 100000) -> DataFrame:
    """Boxes (from extents) whose score is above `least`, the nbest greatest of each image; ties to the greater label."""
    w = Window.partitionBy(IMAGE).orderBy(F.desc("score"), F.desc("label"))
    return regions.withColumn("score", score).where(F.col("score") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nbest)


def renumbered(labels: DataFrame) -> DataFrame:
    """Labels replaced by their rank among the image's labels, from 0."""
    return labels.withColumn("label", F.dense_rank().over(Window.partitionBy(IMAGE).orderBy("label")) - 1)


def renumbered_by_x(labels: DataFrame) -> DataFrame:
    """Labels from 1 in the order of the middle of their boxes, left to right; 0 stays."""
    w = Window.partitionBy(IMAGE).orderBy((F.col("x0") + F.col("x1")) / 2, "label")
    order = extents(labels).select(IMAGE, "label", F.row_number().over(w).alias("place"))
    return labels.join(order, [IMAGE, "label"], "left").select(*PIXEL, F.coalesce("place", F.lit(0)).alias("label"))


def ordered_by_x(labels: DataFrame) -> DataFrame:
    """(image_id, ordered): whether ascending labels run from left to right."""
    w = Window.partitionBy(IMAGE).orderBy("label")
    e = extents(labels).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    return e.withColumn("back", F.lag("c").over(w) > F.col("c")).groupBy(IMAGE).agg((~F.bool_or(F.coalesce("back", F.lit(False)))).alias("ordered"))


def spread(labels: DataFrame, maxdist: float) -> DataFrame:
    """Background pixels take the label of the nearest labelled pixel closer than maxdist; ties to the least label.

    A range join: only pixels within maxdist along both axes meet.
    """
    seed = labels.where("label <> 0").select(IMAGE, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("label").alias("sl"))
    bare = labels.where("label = 0").select(*PIXEL)
    d = F.pow(F.col("sy") - F.col("y"), F.lit(2)) + F.pow(F.col("sx") - F.col("x"), F.lit(2))
    found = bare.join(seed.withColumnRenamed(IMAGE, "sid"), (F.col(IMAGE) == F.col("sid")) & F.col("sy").between(F.col("y") - maxdist, F.col("y") + maxdist) & F.col("sx").between(F.col("x") - maxdist, F.col("x") + maxdist))
    best = found.withColumn("d", d).where(F.col("d") < maxdist * maxdist).groupBy(*PIXEL).agg(F.min(F.struct("d", "sl")).alias("m")).select(*PIXEL, F.col("m.sl").alias("new"))
    return labels.join(best, PIXEL, "left").select(*PIXEL, F.when(F.col("label") != 0, F.col("label")).otherwise(F.coalesce("new", F.lit(0))).alias("label"))


def page_reject_reason(stats: DataFrame) -> DataFrame:
    """stats (height, width, mean, median, components) with reject_reason: why it can't be a page, or null."""
    h, w, n = F.col("height"), F.col("width"), F.col("components")
    why = (
        F.when(F.col("mean") < F.col("median"), "may be inverted").when(h < 600, "not tall enough").when(h > 10000, "too tall").when(w < 600, "too narrow").when(w > 10000, "too wide")
        .when(n < 10, "too few components").when(n > F.floor(h * w / 900), "too many components")
    )
    return stats.withColumn("reject_reason", why)


def line_reject_reason(stats: DataFrame, ratio: float = 1.0) -> DataFrame:
    """The same for a text line."""
    h, w, n = F.col("height"), F.col("width"), F.col("components")
    slots = w * 1.0 / h
    why = (
        F.when(h < 20, "not tall enough").when(h > 200, "too tall").when(w < 1.5 * h, "too narrow").when(w > 4000, "too wide").when(F.col("mean") < F.col("median"), "may be inverted")
        .when(n < 0.5 * slots, "too few components").when(n > 4 * slots * ratio, "too many components")
    )
    return stats.withColumn("reject_reason", why)
