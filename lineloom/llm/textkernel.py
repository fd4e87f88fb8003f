"""Vectorised hashing of words and shingles over Arrow text columns.

Words are the maximal runs of [a-z0-9] and non-ASCII characters of the lower-cased text. All work is done on the
UTF-8 bytes of a batch with numpy, without a Python object for any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element, wrapping at 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every machine."""
    return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE = constants(1, 256)
ORDER = constants(2, 64)
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed in pieces of about this many bytes; tables of powers for more are made for the occasion.
PIECE = 1 << 20
_powers: list[np.ndarray] = []

WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[ord("0") : ord("9") + 1] = WORD_BYTE[128:] = 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below n; those for one piece are kept, longer tables aren't."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        full = np.full(max(n, PIECE + 2), base & _M, np.uint64)
        full[0] = 1
        made.append(np.multiply.accumulate(full))
    if n <= PIECE + 2:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null counts as the empty text."""
    arr = pc.fill_null(column, "")
    arr = pc.utf8_lower(arr) if lower else arr
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - off[0]


def slices(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first byte, end byte, offsets of each row's words) of the rows that off delimits in b."""
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    w = WORD_BYTE[b]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.empty_like(w)
    before[0] = 0
    before[1:] = w[:-1]
    before[edge] = 0
    s = np.flatnonzero(w & (before ^ 1))
    after = np.empty_like(w)
    after[-1] = 0
    after[:-1] = w[1:]
    after[edge - 1] = 0
    e = np.flatnonzero(w & (after ^ 1)) + 1
    p, q = _power_tables(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[b] * w * p[:n], out=h[1:])
    return splitmix((h[e] - h[s]) * q[s]), s, e, np.searchsorted(s, off)


def _cuts(b: np.ndarray, size: int) -> list[int]:
    """Places in one text, about size bytes apart, where no word is cut; a word longer than size stays whole."""
    at, out = 0, [0]
    while len(b) - at > size:
        gap = np.flatnonzero(WORD_BYTE[b[at + size // 2 : at + size]] == 0)
        if len(gap):
            at += size // 2 + int(gap[-1])
        else:
            stop = at + size
            while stop < len(b) and not len(gap := np.flatnonzero(WORD_BYTE[b[stop : stop + size]] == 0)):
                stop += size
            if stop >= len(b):
                break
            at = stop + int(gap[0])
        out.append(at)
    return [*out, len(b)]


def word_rows(data: np.ndarray, off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, word hashes, offsets of each row's words) of row ranges of about size bytes.

    A longer text is read in pieces of that size, so beside its bytes only its word hashes are held, 8 bytes each.
    """
    for i, j in slices(off, size):
        if j - i > 1 or off[j] - off[i] <= size:
            word, _, _, at = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield i, j, word, at
            continue
        text = data[off[i] : off[j]]
        cut = _cuts(text, size)
        word = np.concatenate([words(text[a:b], np.array([0, b - a]))[0] for a, b in zip(cut, cut[1:], strict=False)])
        yield i, j, word, np.array([0, len(word)])


def shingles(word: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of each row and the rows' offsets.

    A row of fewer than n words, but one at least, has one shingle made of all its words; a row without words has none.
    """
    count = np.diff(off)
    shingle_count = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(shingle_count)))
    first = np.repeat(off[:-1] - out[:-1], shingle_count) + np.arange(out[-1])
    short = np.repeat(count < n, shingle_count)
    end = np.repeat(off[1:], shingle_count)
    padded = np.concatenate((word, np.zeros(n, np.uint64)))
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        x = padded[first + k]
        if k and short.any():
            x = np.where(short & (first + k >= end), np.uint64(0), x)
        h += x * ORDER[k]
    return splitmix(h), out
