"""Pages to text lines: rules removed, columns parted, seeds between the tops and bottoms of lines, labels spread over the ink."""

from __future__ import annotations

from dataclasses import dataclass

import zlib
from struct import error as StructError

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.errors import BadInput
from lineloom.operators.imaging import box, boxes, gaussian, label, scale_of, spread
from lineloom.operators.layout import topological_order
from lineloom.sources.files import decode_png, encode_png


@dataclass(frozen=True)
class Settings:
    """threshold of the tops and bottoms, stretch of the filters, column separators white and black (in units of scale)."""

    threshold: float = 0.2
    vscale: float = 1.0
    hscale: float = 1.0
    gauss: bool = False
    white_columns: int = 3
    column_height: float = 10
    black_columns: int = 0
    widen: int = 10
    least_scale: float = 12.0
    most_lines: int = 300


def of_labels(lab: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where the label is one of those, none of them 0."""
    if not len(which):
        return np.zeros(lab.shape, bool)
    own = np.zeros(int(lab.max()) + 1, bool)
    own[which] = True
    return own[lab]


def select_regions(mask: np.ndarray, score, least: float, most: int) -> np.ndarray:
    """The `most` components of highest score above `least`; score gets heights and widths."""
    lab = label(mask)
    b = boxes(lab)
    s = score(b[:, 3] - b[:, 1], b[:, 4] - b[:, 2]) if len(b) else np.zeros(0)
    best = [i for i in np.argsort(-s, kind="stable")[: max(0, most)] if s[i] > least]
    return of_labels(lab, b[best, 0])


def without_rules(ink: np.ndarray, scale: float, longest: float = 10) -> np.ndarray:
    """ink without components wider than longest times the scale: horizontal rules."""
    lab = label(ink)
    b = boxes(lab)
    return ink * ~of_labels(lab, b[b[:, 4] - b[:, 2] > longest * scale, 0])


def box_map(ink: np.ndarray, scale: float, least: float = 0.5, most: float = 4.0) -> np.ndarray:
    """1 on the boxes of the components that have the size of characters."""
    out = np.zeros(ink.shape, np.int8)
    for _, y0, x0, y1, x1 in boxes(label(ink)).tolist():
        if least * scale <= np.sqrt((y1 - y0) * (x1 - x0)) <= most * scale:
            out[y0:y1, x0:x1] = 1
    return out


def white_separators(ink: np.ndarray, scale: float, set_: Settings) -> np.ndarray:
    """Tall white space beside the left edges of columns."""
    down = gaussian(ink.astype(float), (scale, 0))
    blur = box(gaussian(down, (0, scale * 0.5)), (5 * scale, 1), np.mean)
    white = blur < blur.max() * 0.1
    edge = box(gaussian(down, (0, scale * 0.5), (0, 1)), (10 * scale, 1), np.mean)
    edge = edge > 0.5 * edge.max()
    both = np.minimum(white, box(edge, (scale, 5 * scale)))
    return select_regions(box(both, (2 * scale, 1)), lambda h, w: h, set_.column_height * scale, set_.white_columns)


def black_separators(ink: np.ndarray, scale: float, set_: Settings) -> np.ndarray:
    """Tall thin black rules."""
    thick = (int(max(5, scale / 4)), int(max(5, scale)) + set_.widen)
    x = box(ink, thick, np.max, 0)
    x = box(box(x, (10 * scale, 1), np.min, 0), (10 * scale, 1), np.max, 0)
    x = box(x, (thick[0] // 2, set_.widen), np.min, 0)
    x = select_regions(x, lambda h, w: w, 3, 2 * set_.black_columns)
    return select_regions(x, lambda h, w: h, 20 * scale, set_.black_columns)


def morphological_separators(ink: np.ndarray, scale: float, set_: Settings, aspect: float = 1.1) -> np.ndarray:
    """White space between blocks of character boxes, by closing."""
    close = lambda m, size: box(box(m, size, np.max, 0), size, np.min, 1)
    gaps = 1 - close(box_map(ink, scale), (20 * scale, scale))
    gaps = select_regions(gaps, lambda h, w: h / np.maximum(w, 1), aspect, 1 << 30)
    gaps = select_regions(gaps, lambda h, w: h, set_.column_height * scale, set_.white_columns)
    return box(box(gaps, (0.5 + scale, 1), np.min, 0), (0.5 + scale, 1), np.max, 0)


def separators(ink: np.ndarray, scale: float, set_: Settings, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(separators, ink without black ones); mask: what a reader has marked to be left out."""
    seps = white_separators(ink, scale, set_)
    if set_.black_columns > 0:
        black = black_separators(ink, scale, set_)
        seps, ink = np.maximum(seps, black), ink * ~black
    if mask is not None:
        seps = np.maximum(seps, mask.astype(bool))
        ink = ink * ~seps
    return seps, ink


def gradients(ink: np.ndarray, scale: float, set_: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bottoms, tops, boxes): how much the ink of character-sized components ends or begins, each 1 at most."""
    area = box_map(ink, scale)
    clean = (area * ink).astype(float)
    if set_.gauss:
        g = gaussian(clean, (set_.vscale * 0.3 * scale, set_.hscale * 6 * scale), (1, 0))
    else:
        g = gaussian(clean, (max(4, set_.vscale * 0.3 * scale), set_.hscale * scale), (1, 0))
        g = box(g, (set_.vscale, set_.hscale * 6 * scale), np.mean)
    unit = lambda x: x / x.max() if x.max() > 0 else x
    return unit(np.maximum(-g, 0)), unit(np.maximum(g, 0)), area


def line_seeds(bottom: np.ndarray, top: np.ndarray, seps: np.ndarray, scale: float, set_: Settings) -> np.ndarray:
    """Labels of the bands between a marked bottom and the top above it, column by column."""
    reach, t, white = int(set_.vscale * scale), set_.threshold, ~seps.astype(bool)
    low = box(bottom == box(bottom, (reach, 0)), (2, 2)) & (bottom > t * bottom.max() * t) & white
    high = box(box(top == box(top, (reach, 0)), (2, 2)) & (top > t * top.max() * t / 2) & white, (1, 20))
    delta, h = max(3, int(scale / 2)), len(low)
    rise = np.zeros((h + 1, low.shape[1]), np.int32)  # +1 where a band begins, -1 where it ends
    y, x = np.nonzero(low)
    np.add.at(rise, (np.maximum(y - delta, 0), x), 1)
    np.add.at(rise, (y, x), -1)
    rows, none = np.arange(h, dtype=np.int32)[:, None], np.full((1, low.shape[1]), -1, np.int32)
    above = lambda m: np.vstack([none, np.maximum.accumulate(np.where(m, rows, np.int32(-1)), 0)[:-1]])[y, x]
    last_low, last_high = above(low), above(high)  # the nearest marks strictly above; -1 if there is none
    y1 = np.maximum(last_high, 0)
    paired = ~high[y, x] & ((last_high > last_low) | ((last_high < 0) & (last_low < 0))) & (y - y1 < 5 * scale)
    np.add.at(rise, (y1[paired], x[paired]), 1)
    np.add.at(rise, (y[paired], x[paired]), -1)
    bands = np.cumsum(rise, 0, np.int32)[:-1] > 0
    return label(box(bands, (1, int(1 + scale))) & white)


def propagated(areas: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Each component of areas with the label of the seeds on it; 0 where several or none are."""
    lab = label(areas)
    both = np.flatnonzero(seeds)
    parts, own = lab.ravel()[both], seeds.ravel()[both]
    n, m = int(lab.max()) + 1, int(seeds.max()) + 1
    if n * m <= 16 * lab.size:
        there = np.zeros(n * m, bool)
        there[parts * m + own] = True
        pairs = np.flatnonzero(there)
    else:
        pairs = np.unique(parts * m + own)
    part, own = np.divmod(pairs[pairs >= m], m)
    one, first, times = np.unique(part, return_index=True, return_counts=True)
    out = np.zeros(n, int)
    out[one[times == 1]] = own[first[times == 1]]
    return out[lab]


def line_labels(ink: np.ndarray, scale: float | None = None, set_: Settings = Settings(), mask: np.ndarray | None = None) -> np.ndarray:  # noqa: B008
    """Label map of the text lines of a page (1 = ink), numbered as they were found; zeros if it has no scale."""
    ink = (np.asarray(ink) != 0).astype(np.int8)
    scale = scale or scale_of(ink)
    if not np.isfinite(scale):
        return np.zeros(ink.shape, int)
    ink = without_rules(ink, scale)
    seps, ink = separators(ink, scale, set_, mask)
    bottom, top, area = gradients(ink, scale, set_)
    seeds = line_seeds(bottom, top, seps, scale, set_)
    own = propagated(area, seeds) * ink
    y, x = np.nonzero((own == 0) & (ink != 0))
    if len(y):  # ink without a label of its own; what is nearer than the scale lies within this margin
        r = int(scale) + 1
        near = np.s_[max(y.min() - r, 0) : y.max() + r + 1, max(x.min() - r, 0) : x.max() + r + 1]
        own[near] = np.where(own[near] > 0, own[near], spread(seeds[near], scale) * ink[near])
    return own


def order_lines(b: np.ndarray) -> list[int]:
    """Rows of boxes (label, y0, x0, y1, x1) in reading order: by columns where they overlap, else from left to right."""
    y0, x0, y1, x1 = b[:, 1:].T
    over = (x0[:, None] < x1[None]) & (x1[:, None] > x0[None])
    first = over & (y0[:, None] < y0[None])
    beside = ~over & (x1[:, None] < x0[None])
    for u, v in np.argwhere(beside).tolist():
        between = (y1 >= min(y0[u], y0[v])) & (y0 <= max(y1[u], y1[v])) & (x0 < x1[u]) & (x1 > x0[v])
        first[u, v] = not between.any()
    return topological_order(list(range(len(b))), {v: np.flatnonzero(first[:, v]).tolist() for v in range(len(b))})


def segment_page(ink: np.ndarray, scale: float | None = None, set_: Settings = Settings(), mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(label map with 0x010000 + place in reading order from 1, boxes with those labels).

    Lines less than twice the scale wide or less than it high are no lines. A page whose scale is below least_scale or
    not a number, or that has more than most_lines lines, is an error.
    """
    ink = (np.asarray(ink) != 0).astype(np.int8)
    scale = scale or scale_of(ink)
    if not np.isfinite(scale) or scale < set_.least_scale or scale > 1000:
        raise ValueError(f"scale {scale:.4g} is out of range")
    lab = line_labels(ink, scale, set_, mask)
    b = boxes(lab)
    b = b[(b[:, 4] - b[:, 2] >= 2 * scale) & (b[:, 3] - b[:, 1] >= scale)] if len(b) else b
    if len(b) > set_.most_lines:
        raise ValueError(f"{len(b)} lines are too many")
    b = b[order_lines(b)] if len(b) else b
    number = np.zeros(int(lab.max()) + 1, int)
    number[b[:, 0]] = 0x010000 + np.arange(1, len(b) + 1)
    b[:, 0] = number[b[:, 0]]
    return number[lab], b


def crop(image: np.ndarray, lab: np.ndarray, line: np.ndarray, pad: int = 3, grow: int = 4, white: float = 1.0) -> np.ndarray:
    """A line's part of a gray page: its box padded, what doesn't belong to the line (grown a little) made white."""
    k, y0, x0, y1, x1 = line.tolist()
    y0, x0, y1, x1 = max(y0 - pad, 0), max(x0 - pad, 0), min(y1 + pad, image.shape[0]), min(x1 + pad, image.shape[1])
    own = box(lab[y0:y1, x0:x1] == k, (grow, grow))
    return np.where(own, image[y0:y1, x0:x1], white)


PAGE = "segmentation binary, lines array<struct<label long, y0 long, x0 long, y1 long, x1 long, image binary>>, error string"


def segment_pages(pages: DataFrame, key: str = "page_id", content: str = "content", mask: str | None = None, set_: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(key, segmentation, lines, error) of PNG pages with dark ink: the label map as PNG, and of every line in reading
    order its label, box and cropped image. mask names a PNG column with what is to be left out, null for nothing.

    A page is segmented in its task; one that can't be read or has no scale has an error only.
    """

    def one(raw: bytes, left_out: bytes | None) -> tuple[bytes, list[dict]]:
        gray = decode_png(bytes(raw)).astype(float)
        ink = gray <= 0.5 * (gray.min() + gray.max()) if gray.min() < gray.max() else np.zeros(gray.shape, bool)
        lab, b = segment_page(ink, None, set_, None if left_out is None else decode_png(bytes(left_out)) > 0.5)
        lines = [dict(zip(("label", "y0", "x0", "y1", "x1"), row.tolist(), strict=True)) | {"image": encode_png(crop(gray, lab, row))} for row in b]
        return encode_png(np.where(lab == 0, 0xFFFFFF, lab)), lines

    def run(parts):
        for part in parts:
            out = []
            for k, raw, m in zip(part[key], part[content], part["_mask"], strict=True):
                try:
                    out.append((k, *one(raw, m), None))
                except (BadInput, ValueError, TypeError, zlib.error, StructError) as e:
                    out.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "segmentation", "lines", "error"])

    rows = pages.select(F.col(key).cast("long").alias(key), content, (F.col(mask) if mask else F.lit(None).cast("binary")).alias("_mask"))
    return rows.mapInPandas(run, f"{key} long, {PAGE}")


def dark_as_background(lab: np.ndarray) -> np.ndarray:
    """A label map read from a file, where white is the background."""
    return np.where(lab == 0xFFFFFF, 0, lab)
