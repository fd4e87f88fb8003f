"""Exact deduplication by recipes of content-defined chunks.

A text is cut where a hash of the last WINDOW bytes has its low bits zero (chunks of about 1 KB, LEAST to MOST bytes);
its recipe is the ordered list of its chunks' hashes, a hundredth of the text, and recipes are what is shuffled and
grouped. Equal texts have equal recipes, so only documents whose recipe occurs again can be duplicates. For these alone
chunks move, each distinct chunk once a map task: grouped by content they show whether a hash stands for one content
only. Such a hash is a verified identifier, and equal lists of verified identifiers are equal texts, byte for byte. Where
a hash has several contents, each content gets an identifier of its own and the lists concerned are compared by those.
No unverified hash decides a result.

Hot groups: recipes and chunks are aggregated before they are shuffled, to the least doc_id or to nothing but the
content, so a chunk or text that a third of all rows have is one row a task, and no list of documents is ever built.

Null text or doc_id: never a duplicate. Empty texts are duplicates of one another. Rows with the same doc_id are one
document and never duplicates of each other; of several texts of one doc_id each counts. Very long texts are cut in pieces
of PIECE bytes, so a task holds the text and its recipe only. Ties: the least doc_id is the original. Other columns,
whatever their names, are ignored. No rows: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

WINDOW, MASK, LEAST, MOST, PIECE = 16, (1 << 10) - 1, 256, 8192, 1 << 19
HASH_BITS = 64

ORACLE = """
SELECT doc_id, duplicate_of, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> duplicate_of
"""


def chunk_ends(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, hash) of each chunk of the rows that off delimits in b, and the chunks' offsets by row."""
    n = len(b)
    p, q = textkernel._power_tables(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(textkernel.BYTE[b] * p[:n], out=h[1:])
    if n >= WINDOW:
        roll = textkernel.splitmix((h[WINDOW:] - h[:-WINDOW]) * q[: n + 1 - WINDOW])
        places = np.flatnonzero((roll & np.uint64(MASK)) == 0) + WINDOW
    else:
        places = np.zeros(0, np.int64)
    ends, row_off = [], [0]
    at = np.searchsorted(places, off)
    for k in range(len(off) - 1):
        start, stop = int(off[k]), int(off[k + 1])
        for x in places[at[k] : at[k + 1]].tolist():
            while x - start > MOST:
                start += MOST
                ends.append(start)
            if x - start >= LEAST and x < stop:
                ends.append(x)
                start = x
        while stop - start > MOST:
            start += MOST
            ends.append(start)
        ends.append(stop)  # an empty text has one empty chunk
        row_off.append(len(ends))
    end, row_off = np.array(ends, np.int64), np.array(row_off, np.int64)
    begin = np.empty_like(end)
    begin[1:] = end[:-1]
    begin[row_off[:-1]] = off[:-1]
    length = end - begin
    return end, length, textkernel.splitmix((h[end] - h[begin]) * q[begin] + length.astype(np.uint64)), row_off


def cut_rows(data: np.ndarray, off: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, ends in data, lengths, hashes, offsets by row) of row ranges; a text longer than piece is cut piece by piece.

    A cut depends on nothing before the chunk that it ends, so each piece goes on at the last cut of the one before.
    """
    for i, j in textkernel.slices(off, piece):
        if j - i > 1 or off[j] - off[i] <= piece:
            end, length, hashed, at = chunk_ends(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield i, j, end + off[i], length, hashed, at
            continue
        start, stop, parts = int(off[i]), int(off[j]), []
        while True:
            upto = min(stop, start + piece)
            end, length, hashed, _ = chunk_ends(data[start:upto], np.array([0, upto - start]))
            keep = len(end) if upto == stop else int(np.searchsorted(end, upto - start - MOST))  # later cuts may need what follows
            parts.append((end[:keep] + start, length[:keep], hashed[:keep]))
            if upto == stop:
                break
            start = int(parts[-1][0][-1])
        end, length, hashed = (np.concatenate([p[k] for p in parts]) for k in range(3))
        yield i, j, end, length, hashed, np.array([0, len(end)])


def _short(hashed: np.ndarray, bits: int) -> np.ndarray:
    return hashed >> np.uint64(64 - bits)


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textkernel.utf8(batch.column("text"), lower=False)
            recipe = []
            for _, _, _, _, hashed, at in cut_rows(data, off):
                raw, cuts = _short(hashed, bits).astype("<u8").tobytes(), (at * 8).tolist()
                recipe += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(recipe, pa.binary())], ["doc_id", "n_bytes", "recipe"])

    return shared.lean(run)


def _chunks(bits: int):
    """Distinct (hash, chunk) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textkernel.utf8(batch.column("text"), lower=False)
            for _, _, end, length, hashed, _ in cut_rows(data, off):
                found = {(h, data[e - n : e].tobytes()) for h, e, n in zip(_short(hashed, bits).view(np.int64).tolist(), end.tolist(), length.tolist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["hash", "chunk"])

    return shared.lean(run)


def _numbered(bits: int):
    """(row, doc_id, n_bytes, recipe, seq, hash, chunk) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textkernel.utf8(batch.column("text"), lower=False)
            size = pa.array(np.diff(off), pa.int64())
            for i, j, end, length, hashed, at in cut_rows(data, off):
                own, cuts = _short(hashed, bits), (at * 8).tolist()
                recipe = [own.astype("<u8").tobytes()[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                row, seq = np.repeat(np.arange(i, j), np.diff(at)), np.arange(len(end)) - np.repeat(at[:-1], np.diff(at))
                chunk = pa.array([data[e - n : e].tobytes() for e, n in zip(end.tolist(), length.tolist(), strict=True)], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("doc_id").take(take), size.take(take), pa.array(recipe, pa.binary()).take(pa.array(row - i)), pa.array(seq, pa.int64()), pa.array(own.view(np.int64)), chunk], ["row", "doc_id", "n_bytes", "recipe", "seq", "hash", "chunk"])

    return shared.lean(run)


def _told_apart(texts: DataFrame, contents: DataFrame, doubtful: DataFrame, bits: int) -> DataFrame:
    """exact_duplicates where some hashes have several contents: each content is numbered, the lists have the numbers."""
    rows = shared.cut(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    number = contents.join(doubtful, "hash", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    chunks = rows.mapInArrow(_numbered(bits), "row long, doc_id long, n_bytes long, recipe binary, seq long, hash long, chunk binary")
    listed = chunks.join(number, ["hash", "chunk"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "k"))).alias("ids"))
    lists = chunks.where("seq = 0").select("row", "doc_id", "n_bytes", "recipe").join(listed, "row", "left").drop("row").withColumn("ids", F.coalesce("ids", F.array().cast("array<struct<seq:bigint,k:int>>")))
    lists = shared.cut(lists.distinct())
    first = lists.groupBy("n_bytes", "recipe", "ids").agg(F.min("doc_id").alias("duplicate_of"))
    return lists.join(first, ["n_bytes", "recipe", "ids"]).where("doc_id <> duplicate_of")


def exact_duplicates(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """(doc_id, duplicate_of, n_bytes): every document whose text is that of another of lesser doc_id, the least one.

    bits: how many bits of the chunks' hashes are used, for tests of what happens where different chunks share one.
    """
    docs = shared.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    recipes = shared.cut(docs.mapInArrow(_recipes(bits), "doc_id long, n_bytes long, recipe binary"))
    same = ["n_bytes", "recipe"]
    again = shared.cut(recipes.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    small = shared.small_enough(again.count()) and shared.small_enough(again.agg(F.sum(F.octet_length("recipe"))).first()[0] or 0, 1)
    suspect = shared.cut(recipes.join(F.broadcast(again) if small else again, same))
    ids = suspect.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if shared.small_enough(suspect.count(), 16) else ids, "doc_id", "left_semi")
    contents = texts.mapInArrow(_chunks(bits), "hash long, chunk binary").distinct()
    doubtful = shared.cut(contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    if doubtful.isEmpty():
        found = suspect.where("doc_id <> least").withColumnRenamed("least", "duplicate_of")
    else:
        found = _told_apart(texts, contents, doubtful, bits)
    return found.select("doc_id", "duplicate_of", "n_bytes").distinct()


def exact_duplicates_removed(docs: DataFrame) -> DataFrame:
    """docs, columns as they are, without the documents that exact_duplicates finds. Null texts and ids stay."""
    return shared.drop_ids(docs, shared.cut(exact_duplicates(docs).select("doc_id").distinct()), "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
