"""Benchmark decontamination by prefix-filtered set join.

A benchmark item is the set of its word 5-grams (shingles). A document is contaminated by it when some window of the
document, as many shingle positions long as the item, holds at least THRESHOLD of the item's distinct shingles. Then it
holds one of the item's n - ceil(t*n) + 1 rarest shingles, whatever the order; rarest is by the count over all documents,
so only these prefixes are looked up. Length and position bounds discard places where too few shingles remain before and
after; the windows around the others are counted exactly.

The item side is broadcast, after a check of its size, and the documents then need no shuffle at all; beyond ITEM_BYTES
both sides are joined by shingle instead. What is shuffled then are the shingles that a bitmap of BITS bits, made of the
items' and of that size whatever they are, doesn't rule out; it is written once and used three times. Both ways give the
same rows.

Null ids or texts on either side, and texts without a word, match nothing. Items of fewer than 5 words have one shingle,
all their words, that only an equally short document can hold. Very long texts are hashed in pieces; a task holds their
shingles, 8 bytes a word. Ties: shingles of the same count are ordered by hash, which changes what is looked up first and
not what is found; a document that holds several items has a row for each. Repeated rows count once. No documents or no
items: an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

N, THRESHOLD, ITEM_BYTES = 5, 0.8, 32 << 20
BITS, PAGE = 1 << 28, 1 << 16

ORACLE = """
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT doc_id, p, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM dw WHERE len(w) > 0)),
iss AS (SELECT item_id, m, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT item_id, w, greatest(len(w) - 4, 1) AS m, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
its AS (SELECT item_id, m, s, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT DISTINCT item_id, m, s FROM iss)),
hit AS (SELECT d.doc_id, i.item_id, i.m, i.n, d.p, d.s FROM ds d JOIN its i ON d.s = i.s),
win AS (SELECT a.doc_id, a.item_id, a.n, a.p, count(DISTINCT b.s) AS c FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.m - 1 GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(c) AS BIGINT) AS matched, CAST(n AS BIGINT) AS n_shingles, round(max(c) / n, 9) AS containment
FROM win GROUP BY doc_id, item_id, n HAVING max(c) >= ceil(round(0.8 * n, 9))
"""


def _need(distinct: np.ndarray | int, threshold: float):
    return np.ceil(np.round(threshold * distinct, 9)).astype(np.int64)


def _bit(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(BITS - 1)).astype(np.int64)


def bitmap(shingles: DataFrame) -> np.ndarray:
    """BITS bits, set where a shingle of column shingle falls; gathered as pages of PAGE bits, so BITS / 8 bytes at most."""

    def page(table: pa.Table) -> pa.Table:
        bits = np.zeros(PAGE, bool)
        bits[_bit(table.column("shingle").to_numpy().view(np.uint64)) % PAGE] = True
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = shingles.select("shingle", F.shiftright(F.col("shingle").bitwiseAND(BITS - 1), PAGE.bit_length() - 1).alias("page"), F.col("shingle").bitwiseAND(BITS - 1).alias("bit"))
    rows = rows.dropDuplicates(["page", "bit"]).drop("bit").groupBy("page").applyInArrow(page, "page long, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["page"] * (PAGE // 8) : (r["page"] + 1) * (PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _shingle_rows(id_name: str, n: int, able=None):
    """(id, number of shingle positions, position, shingle) rows of every text; able: a broadcast bitmap that they must be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, gram, at in _grams(batch, n):
                count = np.diff(at)
                row = np.repeat(np.arange(i, j), count)
                pos = np.arange(len(gram)) - np.repeat(at[:-1], count)
                size = np.repeat(count, count)
                if able is not None:
                    bit = _bit(gram)
                    some = np.flatnonzero(able.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                    gram, row, pos, size = gram[some], row[some], pos[some], size[some]
                yield pa.RecordBatch.from_arrays([batch.column(id_name).take(pa.array(row)), pa.array(size, pa.int64()), pa.array(pos, pa.int64()), pa.array(gram.view(np.int64))], [id_name, "m", "pos", "shingle"])

    return shared.lean(run)


def _grams(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, shingles of rows i to j, their offsets by row) of a batch."""
    data, off = textkernel.utf8(batch.column("text"))
    for i, j, word, word_off in textkernel.word_rows(data, off):
        yield i, j, *textkernel.shingles(word, word_off, n)


class Items:
    """The item side as arrays: sorted distinct shingles, and by shingle the items that have it."""

    def __init__(self, rows: list, threshold: float):
        ids = np.array([r[0] for r in rows], np.int64)
        self.ids, item = np.unique(ids, return_inverse=True)
        shingle = np.array([r[2] for r in rows], np.int64).view(np.uint64)
        self.window = np.zeros(len(self.ids), np.int64)
        np.maximum.at(self.window, item, np.array([r[1] for r in rows], np.int64))
        self.distinct = np.bincount(item, minlength=len(self.ids))
        self.need = _need(self.distinct, threshold)
        by = np.argsort(shingle, kind="stable")
        self.shingle, first = np.unique(shingle[by], return_index=True)
        self.item_of, self.first = item[by], np.append(first, len(by))
        self.prefix: set[tuple[int, int]] | None = None
        self.lookup = self.shingle

    def order(self, counts: dict[int, int]) -> None:
        """Rarest first by the documents' counts: sets what of each item is looked up."""
        freq = np.array([counts.get(int(x), 0) for x in self.shingle.view(np.int64)], np.int64)
        of = np.repeat(np.arange(len(self.shingle)), np.diff(self.first))
        rank = np.lexsort((self.shingle[of], freq[of], self.item_of))
        item = self.item_of[rank]
        nth = np.arange(len(rank)) - np.searchsorted(item, item)
        pick = nth < (self.distinct - self.need + 1)[item]
        self.prefix = {(int(i), int(s)) for i, s in zip(item[pick], of[rank][pick], strict=True)}
        self.lookup = self.shingle[np.unique(of[rank][pick])]

    def places(self, gram: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Positions of gram whose shingle is in the sorted table."""
        at = np.searchsorted(table, gram)
        at[at == len(table)] = 0
        return np.flatnonzero(table[at] == gram) if len(table) else np.zeros(0, np.int64)

    def verify(self, gram: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, most distinct shingles of it in any window) of the items that one document's shingles hold."""
        size, candidates = len(gram), {}
        for p in self.places(gram, self.lookup).tolist():
            s = int(np.searchsorted(self.shingle, gram[p]))
            for item in self.item_of[self.first[s] : self.first[s + 1]].tolist():
                if (item, s) in self.prefix:
                    lo, hi = max(0, p - int(self.window[item]) + 1), min(size, p + int(self.window[item]))
                    if hi - lo >= self.need[item]:  # length and position bound: enough shingles around the match
                        candidates.setdefault(item, []).append((lo, hi))
        if not candidates:
            return
        hits = self.places(gram, self.shingle)
        number = np.searchsorted(self.shingle, gram[hits])
        for item, spans in candidates.items():
            own = np.fromiter((item in self.item_of[self.first[s] : self.first[s + 1]] for s in number), bool, len(number))
            near = np.zeros(len(hits), bool)
            for lo, hi in spans:
                near[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] = True
            best = most_in_window(hits[own & near].tolist(), number[own & near].tolist(), int(self.window[item]))
            if best >= self.need[item]:
                yield item, best


def most_in_window(pos: list[int], shingle: list[int], window: int) -> int:
    """Most distinct shingles at positions that lie within one window of so many positions."""
    best, left, held = 0, 0, {}
    for p, s in zip(pos, shingle, strict=True):
        held[s] = held.get(s, 0) + 1
        while p - pos[left] >= window:
            held[shingle[left]] -= 1
            if not held[shingle[left]]:
                del held[shingle[left]]
            left += 1
        best = max(best, len(held))
    return best


def _by_broadcast(docs: DataFrame, items: Items, n: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own.shingle) + 1, np.int64)
        for batch in batches:
            for _, _, gram, _ in _grams(batch, n):
                total += np.bincount(np.searchsorted(own.shingle, gram[own.places(gram, own.shingle)]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.shingle[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    counts = docs.mapInArrow(shared.lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    items.order({r[0]: r[1] for r in counts})
    ordered = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ordered.value
        for batch in batches:
            rows, item, matched = [], [], []
            for i, _, gram, at in _grams(batch, n):
                places = own.places(gram, own.lookup)
                for k in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
                    for which, best in own.verify(gram[at[k] : at[k + 1]]):
                        rows.append(i + k)
                        item.append(which)
                        matched.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(own.ids[item] if item else [], pa.int64()), pa.array(matched, pa.int64()), pa.array(own.distinct[item] if item else [], pa.int64())], ["doc_id", "item_id", "matched", "n_shingles"])

    return docs.mapInArrow(shared.lean(find), "doc_id long, item_id long, matched long, n_shingles long")


def _by_shuffle(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """The same join for an item side too large to broadcast."""
    able = docs.sparkSession.sparkContext.broadcast(bitmap(items.select("shingle")))
    shingle = docs.mapInArrow(_shingle_rows("doc_id", n, able), "doc_id long, m long, pos long, shingle long").withColumnRenamed("m", "doc_m")
    shingle = shared.cut(shingle.join(items.select("shingle").distinct(), "shingle", "left_semi"))
    df = shingle.groupBy("shingle").agg(F.count("*").alias("df"))
    need = F.ceil(F.round(F.lit(threshold) * F.col("n"), 9))
    ranked = items.join(df, "shingle", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "shingle")))
    ranked = ranked.withColumn("need", need).withColumn("prefix", F.col("rank") <= F.col("n") - need + 1)
    hit = shingle.join(ranked.where(F.col("prefix")), "shingle").where(F.least("doc_m", F.col("pos") + F.col("m")) - F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1) >= F.col("need")).select("doc_id", "item_id").distinct()
    of_hit = shingle.join(hit, "doc_id").join(items, ["item_id", "shingle"])

    def verify(table: pa.Table) -> pa.Table:
        pos, sh = table.column("pos").to_numpy(), table.column("shingle").to_numpy()
        by = np.argsort(pos, kind="stable")
        best = most_in_window(pos[by].tolist(), sh[by].tolist(), table.column("m")[0].as_py())
        keep = table.slice(0, int(best >= _need(table.column("n")[0].as_py(), threshold)))
        return pa.table({"doc_id": keep.column("doc_id"), "item_id": keep.column("item_id"), "matched": pa.array([best] * len(keep), pa.int64()), "n_shingles": keep.column("n")})

    return of_hit.select("doc_id", "item_id", "pos", "shingle", "m", "n").groupBy("doc_id", "item_id").applyInArrow(verify, "doc_id long, item_id long, matched long, n_shingles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, matched, n_shingles, containment) of every document that holds a passage of an item."""
    docs = shared.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.mapInArrow(_shingle_rows("item_id", n), "item_id long, m long, pos long, shingle long").groupBy("item_id", "shingle").agg(F.max("m").alias("m"))
    items = shared.cut(items.withColumn("n", F.count("*").over(Window.partitionBy("item_id"))).withColumn("m", F.max("m").over(Window.partitionBy("item_id"))))
    if items.count() * 40 <= item_bytes:
        found = _by_broadcast(docs, Items(items.select("item_id", "m", "shingle").collect(), threshold), n)
    else:
        found = _by_shuffle(docs, items, n, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("n_shingles").alias("n_shingles")).withColumn("containment", F.round(F.col("matched") / F.col("n_shingles"), 9))


def contaminated_removed(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs, columns as they are, without the contaminated documents. Null texts and ids stay."""
    return shared.drop_ids(docs, shared.cut(contaminated(docs, benchmark, n, threshold).select("doc_id").distinct()), "doc_id")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
