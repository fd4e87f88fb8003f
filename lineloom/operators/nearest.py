"""The text of least edit distance in a table of texts, exactly, by a trie that is walked for one text at a time."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np


@lru_cache(1 << 16)
def rounded(d: int, size: int) -> float:
    """d / size to six places as Spark rounds them."""
    return float(Decimal(repr(d / size)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


class Trie:
    """Different texts with ids, sorted; a node of depth k is a range of rows with the same first k characters."""

    def __init__(self, texts: list[str], ids: list[int]):
        by = sorted(range(len(texts)), key=texts.__getitem__)
        self.ids = np.array([ids[k] for k in by], np.int64)
        self.size = np.array([len(texts[k]) for k in by])
        depth = int(self.size.max(initial=0))
        self.chars = np.zeros((len(by), depth), np.uint32)
        flat = np.frombuffer("".join(texts[k] for k in by).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars[np.arange(depth) < self.size[:, None]] = flat
        same = np.zeros(len(by), int)  # characters shared with the row before
        if len(by) > 1:
            differ = (self.chars[1:] != self.chars[:-1]) | (np.arange(depth) >= np.minimum(self.size[1:], self.size[:-1])[:, None])
            same[1:] = np.where(differ.any(1), differ.argmax(1), depth)
        self.level = [self._nodes(k, same) for k in range(depth)]

    def _nodes(self, k: int, same: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes of depth k + 1: (first row, row after the last, character, least id, shortest, longest)."""
        own = self.size > k
        start = np.flatnonzero(own & ((same <= k) | ~np.concatenate(([False], own[:-1]))))
        edge = np.flatnonzero(~own | (same <= k))  # where a node may end
        nxt = np.searchsorted(edge, start, side="right")
        stop = np.where(nxt < len(edge), edge[np.minimum(nxt, len(edge) - 1)], len(own))
        both = np.stack([start, stop], 1).ravel()
        pad = lambda a, fill: np.append(a, fill)
        least = np.minimum.reduceat(pad(self.ids, 0), both)[::2]
        return start, stop, self.chars[start, k], least, np.minimum.reduceat(pad(self.size, 0), both)[::2], np.maximum.reduceat(pad(self.size, 0), both)[::2]

    def nearest(self, text: str, beam: int = 32) -> tuple[float, int]:
        """(cost, id): least distance a character of the longer text; of equal costs the least id.

        A first walk keeps few nodes a level and gives a bound, the second one leaves out only what the bound excludes.
        """
        best = self._walk(text, (float("inf"), 0, float("inf")), beam)
        return self._walk(text, best, None)[:2]

    def _walk(self, text: str, best: tuple[float, int, float], beam: int | None) -> tuple[float, int, float]:
        a, m = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(text)
        j = np.arange(m + 1, dtype=np.int32)
        lo, hi, rows = np.array([0]), np.array([len(self.ids)]), j[None]
        for k in range(len(self.level) + 1):
            end = np.flatnonzero(self.size[lo] == k)  # a text that ends here is the node's first
            for d, i in zip(rows[end, m].tolist(), self.ids[lo[end]].tolist(), strict=True):
                size = max(m, k, 1)
                best = min(best, (rounded(d, size), i, d / size))
            if k == len(self.level) or not len(lo):
                break
            start, stop, char, least, short, long = self.level[k]
            first, last = np.searchsorted(start, lo), np.searchsorted(start, hi)
            n = last - first
            parent = np.repeat(np.arange(len(lo)), n)
            node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            above = rows[parent]
            step = np.empty_like(above)
            step[:, 0] = k + 1
            step[:, 1:] = np.minimum(above[:, 1:] + 1, above[:, :-1] + (a[None] != char[node][:, None]))
            rows = np.minimum.accumulate(step - j, axis=1) + j
            left = m - j
            more = np.maximum(left - (long[node] - k - 1)[:, None], (short[node] - k - 1)[:, None] - left)
            bound = (rows + np.maximum(more, 0)).min(1) / np.maximum(np.maximum(m, long[node]), 1)
            keep = (bound <= best[2] + 1e-6) & ((bound < best[2]) | (least[node] < best[1]))
            if beam and keep.sum() > beam:
                keep &= bound <= np.partition(bound[keep], beam - 1)[beam - 1]
                keep &= np.cumsum(keep) <= 4 * beam
            node, rows = node[keep], rows[keep]
            lo, hi = start[node], stop[node]
        return best
