"""Rectangles as four columns y0, x0, y1, x1 (half open) and what is computed from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    """Columns of a rectangle; a prefix tells two rectangles of a row apart."""

    y0: Column
    x0: Column
    y1: Column
    x1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Rect:
        return cls(*(F.col(prefix + c) for c in ("y0", "x0", "y1", "x1")))

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def area(self) -> Column:
        return F.greatest(self.height, F.lit(0)) * F.greatest(self.width, F.lit(0))

    @property
    def empty(self) -> Column:
        return self.area == 0

    @property
    def aspect(self) -> Column:
        return F.try_divide(self.height.cast("double"), self.width)

    @property
    def ycenter(self) -> Column:
        return (self.y0 + self.y1) / 2

    @property
    def xcenter(self) -> Column:
        return (self.x0 + self.x1) / 2

    def shift(self, dy, dx, scale=1) -> Rect:
        return Rect(self.y0 + dy * scale, self.x0 + dx * scale, self.y1 + dy * scale, self.x1 + dx * scale)

    def pad(self, d) -> Rect:
        return Rect(self.y0 - d, self.x0 - d, self.y1 + d, self.x1 + d)

    def union(self, o: Rect) -> Rect:
        """Smallest rectangle around both; null coordinates are those of nothing."""
        return Rect(F.least(self.y0, o.y0), F.least(self.x0, o.x0), F.greatest(self.y1, o.y1), F.greatest(self.x1, o.x1))

    def intersect(self, o: Rect) -> Rect:
        return Rect(F.greatest(self.y0, o.y0), F.greatest(self.x0, o.x0), F.least(self.y1, o.y1), F.least(self.x1, o.x1))

    def xoverlap(self, o: Rect) -> Column:
        return F.greatest(F.lit(0), F.least(self.x1, o.x1) - F.greatest(self.x0, o.x0))

    def yoverlap(self, o: Rect) -> Column:
        return F.greatest(F.lit(0), F.least(self.y1, o.y1) - F.greatest(self.y0, o.y0))

    def xoverlap_rel(self, o: Rect) -> Column:
        return self.xoverlap(o) / F.greatest(F.lit(1), self.width, o.width)

    def yoverlap_rel(self, o: Rect) -> Column:
        return self.yoverlap(o) / F.greatest(F.lit(1), self.height, o.height)

    def xoverlaps(self, o: Rect) -> Column:
        """Closed: touching counts."""
        return (self.x1 >= o.x0) & (o.x1 >= self.x0)

    def yoverlaps(self, o: Rect) -> Column:
        return (self.y1 >= o.y0) & (o.y1 >= self.y0)

    def center_in(self, o: Rect) -> Column:
        return (self.ycenter >= o.y0) & (self.ycenter <= o.y1) & (self.xcenter >= o.x0) & (self.xcenter <= o.x1)

    def math(self, h) -> Rect:
        """With y upwards in an image of height h."""
        return Rect(h - self.y1 - 1, self.x0, h - self.y0 - 1, self.x1)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in ((self.y0, "y0"), (self.x0, "x0"), (self.y1, "y1"), (self.x1, "x1"))]


def relative_geometry(box: Rect, mean_height: Column, slope: Column, offset: Column) -> list[Column]:
    """Place and size of a character relative to its line y = slope * x + offset, and the same squeezed to -1..1."""
    ry = (box.ycenter - (slope * box.xcenter + offset)) / mean_height
    rw, rh = box.width / mean_height, box.height / mean_height
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return [ry.alias("rel_y"), rw.alias("rel_w"), rh.alias("rel_h"), clip(2 * ry).alias("geo_y"), clip(F.log(rw)).alias("geo_w"), clip(F.log(rh)).alias("geo_h")]
