"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text answers "how far does the text at hand run on in that language's
text". A document is parsed into phrases, each the longest match found in the training text; the number of phrases
times log2(training length) over the length estimates the cross entropy in bits per character, and the language with
the least wins. A document nearest to no language, or without a letter, is rejected: one of more than MAX_BITS that also
has more phrases than language text of its length. Those are counted in each half of the training text, parsed by the
other half in pieces of LENGTHS letters; a text may have MARGIN times what all but 5 % of its language's pieces have, and
two phrases more, lengths between and beyond in proportion. A short text so isn't rejected for the bits of its few phrases;
of a few letters nearly any text is kept.

Texts are lower-cased, tokens of ASCII letters and digits that have a digit (numbers, codes, keys) are left out, and every
run of non-letters becomes one space. They are parsed whole. So that numpy can step through thousands of places at once, a
text is parsed in pieces of WINDOW characters; each piece but the first is then parsed again from where the one before it
ended, until both parses are in the same state, so the phrases are those of a parse from front to back. Very long texts are
encoded in pieces; a task holds their letters, one to four bytes each.

Training reads a bounded sample of labelled rows: per language at most TRAIN_DOCS documents, the first in the order of
a hash of doc_id among those of under TRAIN_CHARS characters, and of these whole documents of up to TRAIN_CHARS characters
together; a language with longer ones only is trained on the beginning of one. All documents are classified. Every letter
of the training texts is a symbol of its own; tables of over DENSE entries (large alphabets) are kept as hash tables. The
tables are made once, on the driver, and sent to the tasks.

Null or empty text, or one without letters: language null, bits null, rejected. Rows with a null lang take no part in
training. Repeated rows are classified one by one. Ties go to the first language by name. No labelled row at all: every
document is rejected. Other columns pass through the stage unchanged.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

TRAIN_DOCS, TRAIN_CHARS, WINDOW, MAX_BITS = 60, 40_000, 1024, 4.5
SLICE = 2 << 20
LENGTHS, MARGIN = tuple(1 << k for k in range(10)), 1.3
DENSE = 8 << 20
_SPACE, _OTHER, _BEGINS = 0, 1, 1 << 31  # bit 31: a phrase begins here
_STATE = np.uint32(_BEGINS - 1)
_LETTER = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
_DIGIT, _TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True
_TOKEN[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


class SuffixAutomaton:
    """Suffix automaton of a sequence of small integers; transitions as one dict per state, state 0 the root."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[cur] = twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
            last = cur


def letters(texts: dict[str, str]) -> np.ndarray:
    """Code of every code point: 0 no letter, 1 a letter that no training text has, else its own."""
    known = sorted({ord(c) for t in texts.values() for c in t.lower() if _LETTER[ord(c)]})
    code = _LETTER.astype(np.uint8 if len(known) < 255 else np.uint16 if len(known) < 65535 else np.uint32)
    code[known] = np.arange(2, len(known) + 2)
    return code


def without_codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """UTF-8 rows with the tokens of ASCII letters and digits that have a digit made spaces."""
    digit = np.flatnonzero(_DIGIT[data])
    if not len(digit):
        return data
    solid = _TOKEN[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge], end[edge - 1] = solid[edge], solid[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    token = np.unique(np.searchsorted(s, digit, side="right") - 1)
    step = np.zeros(len(data) + 1, np.int8)
    step[s[token]] += 1
    step[e[token]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, np.uint8(32), data)


def held_out(symbols: list[int]) -> np.ndarray:
    """Phrases that all but 5 % of the pieces of LENGTHS symbols have at most, each half parsed by the other."""
    half, counts = len(symbols) // 2, [[1] for _ in LENGTHS]
    for known, rest in ((symbols[:half], symbols[half:]), (symbols[half:], symbols[:half])):
        auto = SuffixAutomaton(known).next
        for size, count in zip(LENGTHS, counts, strict=True):
            for at in range(0, len(rest) - size + 1, size):
                state, n = 0, 0
                for c in rest[at : at + size]:
                    to = auto[state].get(c) if state else None
                    if to is None:
                        to, n = auto[0].get(c, 0), n + 1
                    state = to
                count.append(n)
    return np.maximum.accumulate([np.quantile(count, 0.95, method="higher") for count in counts])


def encode(data: np.ndarray, off: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of lower-cased UTF-8 rows, runs of non-letters made one space and none leading; the rows' offsets."""
    data = without_codes(data, off)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[off]
    c = code[points]
    before = np.empty_like(c)
    before[:1] = _SPACE
    before[1:] = c[:-1]
    before[at[:-1][at[:-1] < len(c)]] = _SPACE
    keep = (c != _SPACE) | (before != _SPACE)
    return c[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def encoded(data: np.ndarray, off: np.ndarray, code: np.ndarray, piece: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """encode, a text longer than piece by pieces that end after a space, or where a letter begins if it has none."""
    if len(off) != 2 or off[1] - off[0] <= piece:
        return encode(data, off, code)
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + piece)
        if stop < len(data):
            space = np.flatnonzero(data[at:stop] == 32)
            stop = at + int(space[-1]) + 1 if len(space) else stop
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
        own = encode(data[at:stop], np.array([0, stop - at]), code)[0]
        out.append(own[1:] if out and len(own) and own[0] == _SPACE and (not len(out[-1]) or out[-1][-1] == _SPACE) else own)
        at = stop
    symbols = np.concatenate(out)
    return symbols, np.array([0, len(symbols)])


class Dense:
    """A language's transitions as a table of states by letters."""

    def __init__(self, auto: list[dict[int, int]], width: int):
        table = np.full((len(auto), width), -1, np.int64)
        for s, to in enumerate(auto):
            for c, t in to.items():
                table[s, c] = t * width
        restart = np.where(table[0] >= 0, table[0], 0) | _BEGINS
        table = np.where(table >= 0, table, restart[None, :])
        table[0] = restart
        self.table = table.astype(np.uint32).reshape(-1)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after these letters, with _BEGINS where a phrase begins."""
        return self.table[state + c]


class Sparse:
    """The same for a large alphabet: a hash table of the transitions there are, with linear probing."""

    def __init__(self, auto: list[dict[int, int]], width: int):
        rows = [(s * width + c, t) for s, to in enumerate(auto) if s for c, t in to.items()]
        key, to = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(rows)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.key, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        at, left = self._at(key), np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = key[free]  # of several at one place the last stays
            own = self.key[at[left]] == key[left]
            self.to[at[left[own]]] = to[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & self.mask
        self.restart = np.full(width, _BEGINS, np.int64)
        for c, t in auto[0].items():
            self.restart[c] |= t
        self.width = width

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + c
        at, out = self._at(key), self.restart[c]
        left = np.flatnonzero(state)  # the root begins a phrase anyway
        while len(left):
            found = self.key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return out.astype(np.uint32)


class Model:
    """Cross-parsing tables of every language, each over the letters of its own training text."""

    def __init__(self, texts: dict[str, str], window: int = WINDOW, dense: int = DENSE):
        self.langs, self.window, self.code = sorted(texts), window, letters(texts)
        self.bits, self.tables, self.usual, self.own = [], [], [], []
        for lang in self.langs:
            raw = np.frombuffer(texts[lang].lower().encode(), np.uint8)
            symbols = encode(raw, np.array([0, len(raw)]), self.code)[0].tolist()
            own = np.ones(int(self.code.max()) + 1, self.code.dtype)  # codes within the language; its unknown letters are 1
            used = np.unique(np.array([_SPACE, _OTHER, *symbols]))
            own[used] = np.arange(len(used))
            symbols = own[symbols].tolist()
            auto = SuffixAutomaton(symbols).next
            self.own.append(own)
            self.tables.append((Dense if len(auto) * len(used) <= dense else Sparse)(auto, len(used)))
            self.bits.append(math.log2(max(2, len(symbols))))
            self.usual.append(held_out(symbols))

    def phrases(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(languages, rows): phrases of each row in each language's parse."""
        size = np.diff(off)
        pieces = -(-size // self.window)
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = off[:-1][row] + nth * self.window
        length = np.minimum(self.window, off[1:][row] - start)
        by = np.argsort(-length, kind="stable")
        lane = np.empty_like(by)
        lane[by] = np.arange(len(by))
        after = np.where(np.append(nth[1:], 0) > 0, np.append(lane[1:], 0), -1)[by]  # the lane of the piece that follows
        row, start, length = row[by], start[by], length[by]
        lanes = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right") if len(length) else []
        state = [np.zeros(len(row), np.uint32) for _ in self.langs]
        count = [np.zeros(len(row), np.int32) for _ in self.langs]
        for t, a in enumerate(lanes):
            c = symbols[start[:a] + t]
            for s, n, table, own in zip(state, count, self.tables, self.own, strict=True):
                v = table.step(s[:a], own[c].astype(np.uint32))
                n[:a] += (v >> np.uint32(31)).view(np.int32)
                s[:a] = v & _STATE
        for s, n, table, own in zip(state, count, self.tables, self.own, strict=True):
            n += self._carried(symbols, start, length, after, s, table, own)
        return np.stack([np.bincount(row, weights=n, minlength=len(size)) for n in count]) if self.langs else np.zeros((0, len(size)))

    @staticmethod
    def _carried(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, after: np.ndarray, state: np.ndarray, table, own: np.ndarray) -> np.ndarray:
        """What each piece's phrases change by when it goes on from the state at the end of the piece before; state is updated."""
        change, alone_end = np.zeros(len(state), np.int32), state.copy()
        ended = np.flatnonzero(after >= 0)
        while len(ended):
            at = after[ended]  # pieces to parse from both starts, side by side
            alone, true, diff, end = np.zeros(len(at), np.uint32), state[ended], np.zeros(len(at), np.int32), alone_end[at]
            live, t = np.arange(len(at)), 0
            while len(live):
                over = length[at[live]] <= t
                end[live[over]] = true[live[over]]
                live = live[~over & (alone[live] != true[live])]
                if not len(live):
                    break
                c = own[symbols[start[at[live]] + t]].astype(np.uint32)
                u, v = table.step(alone[live], c), table.step(true[live], c)
                diff[live] += (v >> np.uint32(31)).view(np.int32) - (u >> np.uint32(31)).view(np.int32)
                alone[live], true[live] = u & _STATE, v & _STATE
                t += 1
            change[at] = diff
            other = state[at] != end  # a piece that ends otherwise now: the one after it once more
            state[at] = end
            ended = at[other & (after[at] >= 0)]
        return change

    def limit(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits per character that text of these sizes has at most in the language at hand."""
        out = np.zeros(len(size))
        for k, (bits, usual) in enumerate(zip(self.bits, self.usual, strict=True)):
            own = (best == k) & (size > 0)
            phrases = np.interp(size[own], LENGTHS, usual) * np.maximum(1, size[own] / LENGTHS[-1])
            out[own] = (MARGIN * phrases + 2) * bits / size[own]
        return out

    def classify(self, column: pa.Array, max_bits: float = MAX_BITS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(language or null, bits per character or nan, accepted) of each text."""
        data, off = textkernel.utf8(column)
        best, bits, most = np.zeros(len(off) - 1, np.int64), np.full(len(off) - 1, np.nan), np.full(len(off) - 1, max_bits)
        for i, j in textkernel.slices(off, SLICE):
            symbols, at = encoded(data[off[i] : off[j]], off[i : j + 1] - off[i], self.code)
            size = np.diff(at)
            if self.langs and len(symbols):
                rate = self.phrases(symbols, at) * np.array(self.bits)[:, None] / np.maximum(size, 1)
                best[i:j] = rate.argmin(0)
                bits[i:j] = np.where(size > 0, rate.min(0), np.nan)
                most[i:j] = np.maximum(max_bits, self.limit(best[i:j], size) + 1e-9)
        none = np.isnan(bits)
        names = pa.array(self.langs, pa.string()).take(pa.array(best, mask=none)) if self.langs else pa.nulls(len(best), pa.string())
        return names, bits, ~none & (np.nan_to_num(bits, nan=np.inf) <= most)


def training_texts(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Bounded labelled text by language, of whole documents."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null").withColumn("long", F.length("text") >= chars)
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    chosen = shared.cut(labelled.select("lang", "doc_id", "long").withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang))
    rows = labelled.select("lang", "doc_id", "long", F.substring("text", 1, chars).alias("text")).join(F.broadcast(chosen), ["lang", "doc_id", "long"]).orderBy("lang", "k", "text").collect()
    texts: dict[str, str] = {}
    for r in rows:
        have = texts.get(r["lang"], "")
        if len(have) + len(r["text"]) < chars:
            texts[r["lang"]] = have + r["text"] + "\n"
        elif not any(_LETTER[ord(c)] for c in have):
            texts[r["lang"]] = r["text"]
    return texts


def identify(docs: DataFrame, texts: dict[str, str], max_bits: float = MAX_BITS, window: int = WINDOW) -> DataFrame:
    """(doc_id, lang_found, bits_per_char, rejected) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(Model(texts, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, bits, ok = model.classify(batch.column("text"), max_bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array(np.round(bits, 9), mask=np.isnan(bits)), pa.array(~ok)], ["doc_id", "lang_found", "bits_per_char", "rejected"])

    return shared.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(shared.lean(run), "doc_id long, lang_found string, bits_per_char double, rejected boolean")


def identified(docs: DataFrame, texts: dict[str, str], max_bits: float = MAX_BITS, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in one of the languages."""
    sent, at = docs.sparkSession.sparkContext.broadcast(Model(texts, window)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array(model.classify(batch.column(at), max_bits)[2]))

    return shared.small_batches(docs).mapInArrow(shared.lean(run), docs.schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, training_texts(docs))
