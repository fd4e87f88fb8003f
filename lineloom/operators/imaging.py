"""Images as arrays in Python tasks: what needs filters, labelling and geometry; one image is one row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(a: np.ndarray, sigma, order=0) -> np.ndarray:
    """Gaussian filter, sigma one number or one for each axis; order 1 gives the derivative. Mirrored edges, cut off at 4 sigma."""
    for axis, (s, d) in enumerate(zip(np.broadcast_to(sigma, (a.ndim,)), np.broadcast_to(order, (a.ndim,)), strict=True)):
        if s > 0:
            r = int(4 * s + 0.5)
            u = np.arange(-r, r + 1)
            k = np.exp(-0.5 * (u / s) ** 2)
            k /= k.sum()
            k = -u / (s * s) * k if d else k
            n = a.shape[axis]
            at = np.arange(-r, n + r) % (2 * n)
            x = np.moveaxis(np.take(a, np.where(at < n, at, 2 * n - 1 - at), axis), axis, 0)
            shape, x = x.shape[1:], x.reshape(len(x), -1).astype(float, copy=False)
            step = min(n, 2 * r + 1)  # rows at a time, by one product with the kernel at each of them
            band = np.zeros((step, step + 2 * r))
            for j in range(step):
                band[j, j : j + 2 * r + 1] = k[::-1]
            out = np.empty((n, x.shape[1]))
            for j in range(0, n, step):
                m = min(step, n - j)
                out[j : j + m] = band[:m, : m + 2 * r] @ x[j : j + m + 2 * r]
            a = np.moveaxis(out.reshape(n, *shape), 0, axis)
    return a


def _run_extreme(x: np.ndarray, s: int, pick) -> np.ndarray:
    """Extreme of every s neighbours along the first axis, by doubling."""
    n, have = len(x) - s + 1, 1
    while 2 * have <= s:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[:n], x[s - have : s - have + n])


def box(a: np.ndarray, size: tuple[int, int], how=np.max, edge: float | None = None) -> np.ndarray:
    """Greatest, least or mean value in a box around each pixel, or another function's; edges mirrored, or a constant.

    The first three take a time that doesn't grow with the box, or with its logarithm.
    """
    for axis, s in enumerate(map(int, size)):
        if s > 1:
            pad = [(0, 0)] * a.ndim
            pad[axis] = (s // 2, s - 1 - s // 2)
            x = np.moveaxis(np.pad(a, pad, "symmetric") if edge is None else np.pad(a, pad, constant_values=edge), axis, 0)
            if how in (np.max, np.min):
                x = _run_extreme(x, s, np.maximum if how is np.max else np.minimum)
            elif how is np.mean:
                total = np.zeros((len(x) + 1, *x.shape[1:]))
                np.cumsum(x, 0, out=total[1:])
                x = total[s:] - total[:-s]
                x /= s
            else:
                x = how(np.lib.stride_tricks.sliding_window_view(x, s, 0), axis=-1)
            a = np.moveaxis(x, 0, axis)
    return a


def percentile_box(a: np.ndarray, q: float, size: tuple[int, int], strip: int = 1 << 22) -> np.ndarray:
    """The q-th percentile in a box around each pixel, in strips of rows whose windows have about strip values."""
    x = np.pad(a, [(s // 2, s - 1 - s // 2) for s in size], "symmetric")
    w = np.lib.stride_tricks.sliding_window_view(x, size)
    n = size[0] * size[1]
    k, rows, out = min(n - 1, int(q / 100 * n)), max(1, strip // max(1, n * a.shape[1])), np.empty(a.shape)
    for y in range(0, a.shape[0], rows):
        out[y : y + rows] = np.partition(w[y : y + rows].reshape(-1, n), k, -1)[:, k].reshape(-1, a.shape[1])
    return out


def label(a: np.ndarray) -> np.ndarray:
    """Connected components (4 neighbours) of what isn't 0, numbered from 1 in reading order of their first pixel."""
    h, w = a.shape
    on = np.zeros((h, w + 2), bool)
    on[:, 1:-1] = a != 0
    turn = np.flatnonzero(on[:, 1:] != on[:, :-1])  # in every row a start and a stop by turns
    row, start = np.divmod(turn[::2], w + 1)
    stop = turn[1::2] - row * (w + 1)
    if not len(row):
        return np.zeros(a.shape, int)
    wide = w + 1
    lo = np.searchsorted(row * wide + stop, (row - 1) * wide + start, side="right")
    hi = np.searchsorted(row * wide + start, (row - 1) * wide + stop, side="left")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = np.arange(len(row))
    while True:  # hook the roots of touching runs to the lesser one, then point every run at its root
        u, v = root[below], root[above]
        if (u == v).all():
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    number = np.cumsum(root == np.arange(len(row)))[root]
    at, value = np.zeros(2 * len(row) + 2, int), np.zeros(2 * len(row) + 1, int)
    at[1:-1:2], at[2:-1:2], at[-1], value[1::2] = row * w + start, row * w + stop, h * w, number
    return np.repeat(value, np.diff(at)).reshape(h, w)


def boxes(lab: np.ndarray) -> np.ndarray:
    """Rows (label, y0, x0, y1, x1) of the labels but 0."""
    h, w = lab.shape
    wide = np.zeros((h, w + 2), lab.dtype)
    wide[:, 1:-1] = lab
    turn = np.flatnonzero(wide[:, 1:] != wide[:, :-1])  # runs of one label, some of 0, lie between two turns of a row
    y, x = np.divmod(turn, w + 1)
    v = wide[y, x + 1]
    on = np.flatnonzero(v)
    y, x0, x1, v = y[on], x[on], x[np.minimum(on + 1, len(x) - 1)], v[on]
    ids, inv = np.unique(v, return_inverse=True)
    out = np.stack([ids, np.full(len(ids), 1 << 30), np.full(len(ids), 1 << 30), np.zeros(len(ids), int), np.zeros(len(ids), int)], 1)
    for col, f, val in ((1, np.minimum, y), (2, np.minimum, x0), (3, np.maximum, y + 1), (4, np.maximum, x1)):
        f.at(out[:, col], inv, val)
    return out


def spread(lab: np.ndarray, maxdist: float = np.inf) -> np.ndarray:
    """Background takes the nearest label closer than maxdist; ties to the least label.

    Exact distances in two passes: the nearest label in each column, then over the columns at growing distance for as long
    as one could still be nearer. No table of pixels by labels is made.
    """
    h, w = lab.shape
    if not lab.any():
        return lab
    far, none = np.int64(h + w) ** 2 * 4, np.iinfo(np.int64).max
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(lab != 0, rows, -1), 0)
    below = np.minimum.accumulate(np.where(lab != 0, rows, h)[::-1], 0)[::-1]
    column = np.arange(w)[None]
    da, db = np.where(above >= 0, (rows - above) ** 2, far), np.where(below < h, (below - rows) ** 2, far)
    la, lb = np.where(above >= 0, lab[np.maximum(above, 0), column], none), np.where(below < h, lab[np.minimum(below, h - 1), column], none)
    d1, l1 = np.minimum(da, db), np.where(da < db, la, np.where(db < da, lb, np.minimum(la, lb)))
    best, owner = d1.copy(), l1.copy()
    for dx in range(1, w):
        if dx * dx >= min(maxdist**2, best.max() + 1):
            break
        for to, of in ((np.s_[:, dx:], np.s_[:, :-dx]), (np.s_[:, :-dx], np.s_[:, dx:])):
            d, k = d1[of] + dx * dx, l1[of]
            nearer = (d < best[to]) | ((d == best[to]) & (k < owner[to]))
            best[to] = np.where(nearer, d, best[to])
            owner[to] = np.where(nearer, k, owner[to])
    return np.where(lab != 0, lab, np.where((best < maxdist**2) & (best < far), owner, 0)).astype(lab.dtype)


def zoom(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resampling to a shape, corners on corners."""
    ys, xs = (np.linspace(0, n - 1, m) for n, m in zip(a.shape, shape, strict=True))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    return (a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx) * (1 - fy) + (a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx) * fy


def rotated(a: np.ndarray, degrees: float, fill: float | None = None) -> np.ndarray:
    """Turned about its middle, nearest pixel; beyond the edges they are repeated, or fill."""
    r = np.deg2rad(degrees)
    cy, cx = (np.array(a.shape) - 1) / 2
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    sy = np.cos(r) * (y - cy) + np.sin(r) * (x - cx) + cy
    sx = -np.sin(r) * (y - cy) + np.cos(r) * (x - cx) + cx
    sy, sx = np.rint(sy).astype(int), np.rint(sx).astype(int)
    out = a[np.clip(sy, 0, a.shape[0] - 1), np.clip(sx, 0, a.shape[1] - 1)]
    return out if fill is None else np.where((sy >= 0) & (sy < a.shape[0]) & (sx >= 0) & (sx < a.shape[1]), out, fill)


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None = None) -> np.ndarray:
    """Values at fractional places, bilinear; beyond the image fill, or the nearest edge."""
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0

    def at(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        v = a[np.clip(j, 0, a.shape[0] - 1), np.clip(i, 0, a.shape[1] - 1)]
        return v if fill is None else np.where((j >= 0) & (j < a.shape[0]) & (i >= 0) & (i < a.shape[1]), v, fill)

    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def jittered(a: np.ndarray, seed: int, eps: float = 0.03, shift: float = 0.3) -> np.ndarray:
    """A small random affine change about the middle, beyond the edges the first pixel's value; the same seed, the same change."""
    rng = np.random.default_rng(seed)
    m = np.array([[1 + eps * rng.normal(), 0.0], [eps * rng.normal(), 1 + eps * rng.normal()]])
    c = np.array(a.shape) / 2
    d = c - m @ c + rng.normal(size=2) * shift
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return sampled(a, m[0, 0] * y + m[0, 1] * x + d[0], m[1, 0] * y + m[1, 1] * x + d[1], a.flat[0])


def distorted(a: np.ndarray, seed: int, most: float = 3.0, sigma: float = 10.0, fill: float = 0.0) -> np.ndarray:
    """Pixels moved by smooth random fields of at most `most`."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    for place in (y, x):
        field = gaussian(rng.normal(size=a.shape), sigma)
        place += field * most / max(np.abs(field).max(), 1e-9)
    return sampled(a, y, x, fill)


def degraded(a: np.ndarray, seed: int, noise: float = 0.2, blur: float = 1.0, threshold: float = 0.5) -> np.ndarray:
    """Noise added, blurred and thresholded: a line (0 ink, 1 paper) as a bad copy shows it."""
    rng = np.random.default_rng(seed)
    return (gaussian(a + rng.normal(size=a.shape) * noise, blur) > threshold).astype(float)


def cut_box(a: np.ndarray, y0: int, x0: int, y1: int, x1: int, margin: int = 0, background: float = 0.0) -> np.ndarray:
    """A box of the image with a margin; what lies beyond the image is background."""
    y0, x0, y1, x1 = y0 - margin, x0 - margin, y1 + margin, x1 + margin
    out = np.full((max(0, y1 - y0), max(0, x1 - x0)), background, float)
    a0, b0, a1, b1 = max(y0, 0), max(x0, 0), min(y1, a.shape[0]), min(x1, a.shape[1])
    if a0 < a1 and b0 < b1:
        out[a0 - y0 : a1 - y0, b0 - x0 : b1 - x0] = a[a0:a1, b0:b1]
    return out


def cut_paths(line: np.ndarray, step: int = 8, ink: float = 10.0, bend: float = 1.0) -> list[np.ndarray]:
    """Ways from top to bottom between characters (1 = ink), x by row, one from about every step-th column, duplicates left out.

    Each is the cheapest by dynamic programming: ink costs, and so does each step aside.
    """
    h, w = line.shape
    cost, back = line[0] * ink, np.zeros((h, w), int)
    for y in range(1, h):
        side = np.pad(cost, 1, constant_values=np.inf)
        ways = np.stack([side[:-2] + bend, side[1:-1], side[2:] + bend])
        back[y] = ways.argmin(0) - 1
        cost = ways.min(0) + line[y] * ink
    out, seen = [], set()
    for x0 in range(0, w, step):
        window = cost[x0 : x0 + step]
        x = x0 + int(window.argmin())
        path = np.empty(h, int)
        for y in range(h - 1, -1, -1):
            path[y] = x
            x += back[y, x]
        if cost[path[-1]] < ink and tuple(path) not in seen:
            seen.add(tuple(path))
            out.append(path)
    return out


def skew(a: np.ndarray, most: float = 2.0, steps: int = 8) -> float:
    """The angle at which the means of the rows vary most; of equals the least turn."""
    angles = np.linspace(-most, most, int(2 * most * steps) + 1)
    angles = angles[np.argsort(np.abs(angles), kind="stable")]
    return float(angles[np.argmax([rotated(a, t).mean(1).var() for t in angles])])


def white_level(x: np.ndarray, window: int = 20, perc: float = 80, factor: float = 0.5) -> np.ndarray:
    """x with its local white level, a percentile of a smaller copy, lifted to 1."""
    small = zoom(x, tuple(max(1, round(n * factor)) for n in x.shape))
    white = percentile_box(percentile_box(small, perc, (min(window, small.shape[0]), 2)), perc, (2, min(window, small.shape[1])))
    return np.clip(x - zoom(white, x.shape) + 1, 0, 1)


def inner(a: np.ndarray, border: float = 0.1) -> np.ndarray:
    """The image without a share of its border."""
    oy, ox = (int(border * n) for n in a.shape)
    return a[oy : a.shape[0] - oy, ox : a.shape[1] - ox]


def ink_range(flat: np.ndarray, lo: float = 5, hi: float = 90, border: float = 0.1, scale: float = 1.0) -> tuple[float, float]:
    """Percentiles for black and white within the border, where values vary by 0.3 of the greatest deviation at least."""
    own = inner(flat, border)
    if scale > 0 and own.size:
        dev = np.sqrt(np.maximum(gaussian((own - gaussian(own, scale * 20.0)) ** 2, scale * 20.0), 0))
        size = int(scale * 50)
        some = box(box(dev > 0.3 * dev.max(), (size, 1), np.max, 0), (1, size), np.max, 0)
        own = own[some.astype(bool)] if some.any() else own
    low, high = np.percentile(own if own.size else flat, [lo, hi])
    return float(low), float(high)


@dataclass(frozen=True)
class Page:
    """A page as 0 (ink) and 1, its gray normalised, and how it was turned and scaled."""

    binary: np.ndarray
    gray: np.ndarray
    angle: float
    lo: float
    hi: float
    flattened: bool


def normalize_page(a: np.ndarray, threshold: float = 0.5, lo: float = 5, hi: float = 90, window: int = 20, perc: float = 80, border: float = 0.1, most_skew: float = 2.0, skew_steps: int = 8, scale: float = 1.0) -> Page:
    """Gray page: white level flattened unless it is nearly binary already, turned upright, scaled between two percentiles.

    A page of one value is white.
    """
    span = a.max() - a.min() if a.size else 0
    if span == 0:
        return Page(np.ones(a.shape, np.uint8), np.ones(a.shape), 0.0, 0.0, 1.0, False)
    x = (a - a.min()) / span
    plain = ((x < 0.05) | (x > 0.95)).mean() > 0.95
    flat, angle = x if plain else white_level(x, window, perc), 0.0
    if most_skew > 0:
        ink = flat.max() - flat
        angle = skew(inner(ink, border), most_skew, skew_steps)
        flat = flat.max() - rotated(ink, angle, 0.0) if angle else flat
    low, high = ink_range(flat, lo, hi, border, scale)
    gray = np.clip((flat - low) / max(high - low, 1e-9), 0, 1)
    return Page((gray > threshold).astype(np.uint8), gray, angle, low, high, not plain)


def binarize(a: np.ndarray, threshold: float = 0.5, lo: float = 5, hi: float = 90, window: int = 20, perc: float = 80) -> np.ndarray:
    """Page to 0 (ink) and 1 as it stands: local white level removed, then scaled between two percentiles."""
    return normalize_page(a, threshold, lo, hi, window, perc, most_skew=0).binary


def sauvola(a: np.ndarray, size: int = 15, k: float = 0.2) -> np.ndarray:
    """Local threshold from mean and deviation."""
    mean, square = box(a, (size, size), np.mean), box(a * a, (size, size), np.mean)
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return (a > mean * (1 + k * (dev / max(dev.max(), 1e-9) - 1))).astype(np.uint8)


def scale_of(ink: np.ndarray) -> float:
    """Typical character size: median of the boxes' root areas over the pixels they cover, smallest boxes first."""
    b = boxes(label(ink))
    side = np.sqrt((b[:, 3] - b[:, 1]) * (b[:, 4] - b[:, 2]))
    paint = np.zeros(ink.shape)
    for i in np.argsort(side, kind="stable"):
        part = paint[b[i, 1] : b[i, 3], b[i, 2] : b[i, 4]]
        part[part == 0] = side[i]
    some = paint[(paint > 3) & (paint < 100)]
    return float(np.median(some)) if len(some) else float("nan")


def normalized_line(a: np.ndarray, height: int = 48, spread_by: float = 1.0) -> np.ndarray:
    """A line's image (1 = ink) straightened along its smoothed centre and brought to one height."""
    h, w = a.shape
    s = gaussian(a, (h * 0.5, h * spread_by)) + 0.001 * np.ones(a.shape)
    centre = np.clip(gaussian(s.argmax(0).astype(float)[None], (0, h * 0.3))[0], 0, h - 1)
    dy = np.abs(np.arange(h)[:, None] - centre[None])
    r = int(max(2, 1 + 4 * (dy * a).sum() / max(a.sum(), 1e-9)))
    pad = np.pad(a, ((r, r), (0, 0)))
    out = np.stack([pad[int(c) : int(c) + 2 * r, i] for i, c in enumerate(centre)], 1)
    return zoom(out, (height, max(1, round(w * height / (2 * r)))))


def each_image(images: DataFrame, f, schema: str, array: str, width: int, key: str) -> DataFrame:
    """(key, columns of schema): f gets each row's array as an image and returns rows; a row on which it fails has only `error`."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts):
        for part in parts:
            out = []
            for k, v in zip(part[key], part[array], strict=True):
                try:
                    out += [(k, *row, None) for row in f(np.asarray(v, float).reshape(-1, width))]
                except (ValueError, TypeError, FloatingPointError) as e:
                    out.append((k, *[None] * len(columns), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, *columns, "error"])

    return images.select(F.col(key).cast("long").alias(key), array).mapInPandas(run, f"{key} long, {schema}, error string")


def each_png(images: DataFrame, f, schema: str, content: str, key: str) -> DataFrame:
    """each_image for PNG files: f gets what decode_png gives."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts):
        from lineloom.sources.files import decode_png

        for part in parts:
            out = []
            for k, raw in zip(part[key], part[content], strict=True):
                try:
                    out += [(k, *row, None) for row in f(decode_png(bytes(raw)))]
                except (ValueError, TypeError, FloatingPointError) as e:
                    out.append((k, *[None] * len(columns), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, *columns, "error"])

    return images.select(F.col(key).cast("long").alias(key), content).mapInPandas(run, f"{key} long, {schema}, error string")
