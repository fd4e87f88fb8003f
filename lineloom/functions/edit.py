"""Edit distance with the differing passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONFUSIONS = "struct<cost int, confusions array<struct<pred string, gt string>>>"


def aligned(pred: str, gt: str) -> tuple[int, str, str]:
    """(distance, prediction, truth) with "_" for gaps; ties: a gap in the prediction, then in the truth, then a match.

    Characters before the first one that both sides consume have no place in the alignment, only in the distance.
    """
    n, m = len(pred), len(gt)
    row = list(range(n + 1))
    step = [bytearray(n + 1)]  # 1: truth only, 2: prediction only, 3: both
    for i in range(1, m + 1):
        last, row, how, g = row, [i] + [0] * n, bytearray(n + 1), gt[i - 1]
        left = i
        for j in range(1, n + 1):
            best, via = last[j] + 1, 1
            if left + 1 < best:
                best, via = left + 1, 2
            other = last[j - 1] + (pred[j - 1] != g)
            if other < best:
                best, via = other, 3
            row[j] = left = best
            how[j] = via
        step.append(how)
    a, b = [], []
    i, j = m, n
    while i > 0 and j > 0:
        via = step[i][j]
        a.append(pred[j - 1] if via > 1 else "_")
        b.append(gt[i - 1] if via != 2 else "_")
        i, j = i - (via != 2), j - (via > 1)
    return row[n], "".join(reversed(a)), "".join(reversed(b))


def xlevenshtein(pred: str, gt: str, context: int = 1) -> tuple[int, list[tuple[str, str]]]:
    """(distance, differing passages with `context` characters around them); the truth must not be empty."""
    if not gt:
        raise ValueError("the truth is empty")
    if pred == gt:
        return 0, []
    cost, a, b = aligned(pred, gt)
    a, b = (" " * context + x + " " * context for x in (a, b))
    size = len(a)
    near = bytearray(size)
    for k in range(size):
        if a[k] != b[k]:
            near[max(0, k - context) : k + context + 1] = b"\1" * (min(size, k + context + 1) - max(0, k - context))
    runs = [m.span() for m in re.finditer(b"\1+", bytes(near))]
    return cost, [(a[s:e], b[s:e]) for s, e in runs]


def confusions(pred: Column, gt: Column, context: int = 1) -> Column:
    """struct(cost, confusions) of prediction and truth; an empty truth counts the prediction as one confusion."""

    @F.pandas_udf(CONFUSIONS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ps, gs in parts:
            rows = [xlevenshtein(p, g, context) if g else (len(p), [(p, "_" * len(p))] if p else []) for p, g in zip(ps.fillna(""), gs.fillna(""), strict=True)]
            yield pd.DataFrame({"cost": [r[0] for r in rows], "confusions": [[{"pred": x, "gt": y} for x, y in r[1]] for r in rows]})

    return run(pred, gt)
