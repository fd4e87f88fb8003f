"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Each document is the set of its word 3-grams. A pair (a, b) with Jaccard similarity >= threshold shares at least
T = ceil(2t/(1+t) * |a|) n-grams when |a| <= |b|, so b must occur in T of the inverted lists of a's n-grams. The search
merges the short lists with a heap, probes the long ones by binary search, and keeps the documents that reach the
overlap; overlaps are exact (n-grams are told apart by 48 bits of hash: two of a pair's are confused once in 10^9 pairs).

Distribution: documents with equal sets are one class of copies with one representative. An inverted index of everything
can't be in one task, so the search runs in buckets: the representatives that agree in one of BUCKET_KEYS min-hash keys.
Each leaves out its most frequent key, which loses no pair that agrees in two. A pair is searched in the rarest bucket that
it shares and nowhere else, and only if it agrees in MATCHED of PRINTS further min-hashes; a pass over these alone finds the
sets that have such a partner, and no other n-grams move. Together these miss a pair at similarity 0.5 with a probability
below 2 in a million, 0.55 below 2 in ten million. Buckets of any size are searched whole: one of more than BLOCK sets or
BLOCK_GRAMS n-grams is divided into blocks, and every two blocks are a task of their own, so tasks stay small and no pair is
left out; the work within a bucket grows with the square of the different sets in it.

Links are counted where they are found, so a dense group gives a row a document, not all its pairs.

Null doc_id or null text, and texts without a word, take no part. Repeated rows (same doc_id and set) count once; a
document is never its own partner; one with several texts is one document, whose links are added up text by text. Texts of
fewer than 3 words have one n-gram, all their words. A very long text is hashed in pieces; its task holds its n-grams,
about 1.5 times the text. Ties: a class is named by its least doc_id. Other columns, whatever their names, are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

N, THRESHOLD = 3, 0.5
BUCKET_KEYS, PRINTS, MATCHED = 24, 64, 13
BLOCK, BLOCK_GRAMS = 2048, 400_000
MU, FAN, SMALL = 0.0085, 16, 24
MANY, SPARSE = 8, 4
_A = textkernel.constants(11, PRINTS)

ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 3 * c >= x.n + y.n),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT k.doc_id, class_id, CAST(l.n AS BIGINT) AS n_links FROM k JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = k.doc_id
"""


def _flat_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, sorted distinct n-gram hashes of 48 bits one row after the other, their offsets); rows with a word only."""
    data, off = textkernel.utf8(batch.column("text"))
    for i, _, word, word_off in textkernel.word_rows(data, off):
        gram, at = textkernel.shingles(word, word_off, n)
        gram >>= np.uint64(16)
        own, rows = [], np.flatnonzero(np.diff(at))
        for k in rows.tolist():
            x = np.sort(gram[at[k] : at[k + 1]])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            own.append(x[keep])
        if own:
            yield rows + i, np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its set) of every row that has a word."""
    for rows, flat, at in _flat_sets(batch, n):
        for k, i in enumerate(rows.tolist()):
            yield i, flat[at[k] : at[k + 1]]


def packed(own: np.ndarray) -> bytes:
    """A set's hashes, six bytes each."""
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw) -> np.ndarray:
    """The inverse of packed."""
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8")


def _identities(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set."""
    return np.add.reduceat(textkernel.splitmix(flat), at[:-1]).view(np.int64), np.bitwise_xor.reduceat(flat * _A[0], at[:-1]).view(np.int64)


_SKETCH = "doc_id long, size int, h1 long, h2 long, keys array<long>, prints binary"


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.uint64(31)
        for batch in batches:
            for rows, flat, at in _flat_sets(batch, n):
                low = np.empty((len(rows), PRINTS), np.uint64)
                for k, a in enumerate(_A):
                    low[:, k] = np.minimum.reduceat(flat * a, at[:-1])
                keys = ((low[:, :BUCKET_KEYS] & ~slot) | np.arange(BUCKET_KEYS, dtype=np.uint64)).view(np.int64)
                prints = (low >> np.uint64(24)).astype("<u2").tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BUCKET_KEYS), pa.array(keys.reshape(-1)))
                blobs = pa.array([prints[k : k + 2 * PRINTS] for k in range(0, len(prints), 2 * PRINTS)], pa.binary())
                h1, h2 = _identities(flat, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(np.diff(at), pa.int32()), pa.array(h1), pa.array(h2), lists, blobs], ["doc_id", "size", "h1", "h2", "keys", "prints"])

    return shared.lean(run)


def _gram_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, at in _flat_sets(batch, n):
                raw, cuts = packed(flat), (at * 6).tolist()
                h1, h2 = _identities(flat, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(h1), pa.array(h2), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "h1", "h2", "grams"])

    return shared.lean(run)


def merge_lists(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that occur in at least `least` of the sorted lists, with their counts: heap merge that skips ahead.

    While fewer than `least` lists stand at the smallest id, least - 1 heads are popped and all of them jump, by binary
    search, to the next head, for no id before it can still reach the count.
    """
    found: dict[int, int] = {}
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found[top] = len(popped)
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            to = max(heap[0][0], top + 1)
        for _, k, at in popped:
            at = bisect_left(lists[k], to, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def merge_arrays(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """merge_lists for arrays: a heap gives the FAN shortest lists, whose merge goes back with the ids' counts."""
    heap = [(len(x), k, x, np.ones(len(x), np.int64)) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    k = len(lists)
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(min(FAN, len(heap)))]
        x, w = np.concatenate([s[2] for s in some]), np.concatenate([s[3] for s in some])
        by = np.argsort(x, kind="stable")
        x, w = x[by], w[by]
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        k += 1
        heapq.heappush(heap, (len(first), k, x[first], np.add.reduceat(w, first)))
    if not heap:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, _, x, w = heap[0]
    return x[w >= least], w[w >= least]


def divide_skip(lists: list[np.ndarray], need: int, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the ids in at least `need` of the sorted lists, counts exact: DivideSkip over short and long lists.

    The short lists are merged with a heap, head by head where all lists are short and list by list else; what the merge
    leaves is looked up in the long lists by binary search for as long as it can still reach the count.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = len(lists[-1])
    long = min(need - 1, int(need / (mu * math.log2(max(2, most)) + 1)))
    short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
    if most <= SMALL:
        out = {}
        rest = [x.tolist() for x in rest]
        for x, count in merge_lists([x.tolist() for x in short], need - long).items():
            for left, other in zip(range(len(rest), 0, -1), rest, strict=True):
                if count + left < need:
                    break
                at = bisect_left(other, x)
                count += at < len(other) and other[at] == x
            if count >= need:
                out[x] = count
        return np.array(list(out), np.int64), np.array(list(out.values()), np.int64)
    ids, count = merge_arrays(short, need - long)
    for left, other in zip(range(len(rest), 0, -1), rest, strict=True):
        able = count + left >= need
        if not able.all():
            ids, count = ids[able], count[able]
        if not len(ids):
            break
        at = np.minimum(np.searchsorted(other, ids), len(other) - 1)
        count += other[at] == ids
    return ids[count >= need], count[count >= need]


def _masks(member: np.ndarray, number: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(words, n): which of the buckets with MANY members here each member is in, a bit a bucket."""
    big = np.flatnonzero(count >= MANY)
    place = np.full(len(count), -1)
    place[big] = np.arange(len(big))
    out = np.zeros((-(-len(big) // 64), n), np.uint64)
    bit = place[number]
    some = bit >= 0
    np.bitwise_or.at(out, (bit[some] >> 6, member[some]), np.uint64(1) << (bit[some] & 63).astype(np.uint64))
    return out


def rivals(prints: np.ndarray, flat: np.ndarray, off: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(member, later members) that can be similar and belong to no rarer bucket together, so each pair comes up once.

    Similar sets agree in MATCHED of the prints at least. flat and off hold every member's rarer buckets. Pairs of the
    same block are left out.
    """
    prints, n = np.ascontiguousarray(prints.T), len(off) - 1
    member = np.repeat(np.arange(n), np.diff(off))
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    masks = _masks(member, number, count, n)
    few = (count[number] > 1) & (count[number] < MANY)
    member, number = member[few], number[few]
    by = np.argsort(number, kind="stable")
    ends, start = np.searchsorted(number[by], np.arange(len(count) + 1)), np.searchsorted(member, np.arange(n + 1))
    with_bucket = member[by]
    for q in range(n - 1):
        ok = block[q + 1 :] != block[q]
        for m in masks:
            if m[q]:
                ok &= (m[q + 1 :] & m[q]) == 0
        for k in number[start[q] : start[q + 1]].tolist():
            others = with_bucket[ends[k] : ends[k + 1]]
            ok[others[others > q] - q - 1] = False
        later = np.flatnonzero(ok) + q + 1
        if not len(later):
            continue
        rest = prints[:, q + 1 :] if len(later) == n - q - 1 else prints[:, later]
        later = later[np.add.reduce(rest == prints[:, q : q + 1], 0, np.uint8) >= MATCHED]
        if len(later):
            yield q, later


def _every(n: int) -> Iterator[tuple[int, np.ndarray]]:
    return ((q, np.arange(q + 1, n)) for q in range(n - 1))


def join_sets(ids: np.ndarray, sets: list[np.ndarray], threshold: float, among=None) -> Iterator[tuple[int, int, int, float]]:
    """(i, j, overlap, jaccard), i and j being positions in sets, of all pairs at or above the threshold.

    among, if given, gets the positions in the order of size and gives the pairs to search, as rivals does.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.lexsort((ids, size))
    size = size[order]
    grams = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), size)
    by = np.argsort(grams, kind="stable")
    grams, owner = grams[by], owner[by]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    length = np.diff(np.append(first, len(grams)))
    owner = owner[np.repeat(length > 1, length)]
    length = length[length > 1]
    need = np.ceil(np.round(2 * threshold / (1 + threshold) * size, 9)).astype(np.int64)
    able = np.bincount(owner, minlength=len(order)) >= np.ceil(np.round(threshold * size, 9))
    end = np.repeat(np.cumsum(length), length)
    place = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[place], np.arange(len(order) + 1))
    wanted = np.zeros(len(order), bool)
    for q, others in among(order) if among else _every(len(order)):
        own = place[starts[q] : starts[q + 1]]
        others = others[able[others] & (size[others] <= size[q] / threshold + 1e-9)] if able[q] and len(own) >= need[q] else others[:0]
        if not len(others):
            continue
        wanted[others] = True
        n = end[own] - own - 1
        to = np.cumsum(n)
        x = owner[np.repeat(own + 1 - to + n, n) + np.arange(to[-1])]
        ok = wanted[x]
        wanted[others] = False
        x, to = x[ok], np.concatenate(([0], np.cumsum(ok)))[to].tolist()
        for c, overlap in zip(*map(np.ndarray.tolist, divide_skip([x[i:j] for i, j in zip([0, *to], to, strict=False) if i < j], int(need[q]))), strict=True):
            jaccard = overlap / float(size[q] + size[c] - overlap)
            if jaccard >= threshold:
                yield int(order[q]), int(order[c]), overlap, jaccard


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the rows' offsets in them."""
    parts = [c.flatten().to_numpy() for c in column.chunks]
    size = np.concatenate([c.value_lengths().to_numpy() for c in column.chunks])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(size)))


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prints, rarer buckets, their offsets, block) of the rows; where a task has one block only, each row counts as its own."""
    prints = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for c in table.column("prints").chunks for x in c), "<u2").reshape(-1, PRINTS)
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    return prints, *_flat(table.column("rarer")), np.where(lo != hi, table.column("block").to_numpy(), -1 - np.arange(len(table)))


_PROMISING = "doc_id long, h1 long, h2 long, bucket long, lo int, hi int"


def _promising(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """The members of each task that may have a partner in it."""
    keep, size = np.zeros(len(table), bool), np.diff(starts)
    prints, rarer, off, block = _members(table)
    two = starts[:-1][size == 2]
    like = two[(prints[two] == prints[two + 1]).sum(1) >= MATCHED]
    for q in like.tolist():
        keep[q] = keep[q + 1] = block[q] != block[q + 1] and not set(rarer[off[q] : off[q + 1]].tolist()).intersection(rarer[off[q + 1] : off[q + 2]].tolist())
    for a, b in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
        for q, others in rivals(prints[a:b], rarer[off[a] : off[b]], off[a : b + 1] - off[a], block[a:b]):
            keep[a + q] = keep[a + others] = True
    return table.select(["doc_id", "h1", "h2", "bucket", "lo", "hi"]).filter(pa.array(keep))


_LINKS = "doc_id long, h1 long, links long, partner long"


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets, the shorter one first, are similar: its n-grams are looked up in the other by binary search."""
    if len(x) < threshold * len(y) - 1e-9:
        return False
    overlap = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return overlap / (len(x) + len(y) - overlap) >= threshold


def _search(threshold: float):
    def group(doc, copies, prints, rarer, off, block, sets) -> tuple[np.ndarray, list[int]]:
        """(links of each member, each member's root in this task)."""
        order = np.lexsort((doc, [len(x) for x in sets]))
        size = np.diff(off)[order]
        to = np.concatenate(([0], np.cumsum(size)))
        pairs = list(rivals(prints[order], rarer[np.repeat(off[order] - to[:-1], size) + np.arange(to[-1])], to, block[order]))
        if sum(len(x) for _, x in pairs) <= SPARSE * len(doc):  # no lists worth making: each pair's n-grams are probed
            found = ((order[q], order[c]) for q, later in pairs for c in later.tolist() if _similar(sets[order[q]], sets[order[c]], threshold))
        else:
            found = ((i, j) for i, j, _, _ in join_sets(doc, sets, threshold, lambda _: iter(pairs)))
        links, root = np.zeros(len(doc), np.int64), list(range(len(doc)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in found:
            if doc[i] != doc[j]:
                links[i] += copies[j]
                links[j] += copies[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        return links, [top(i) for i in range(len(doc))]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        doc, mark, copies = (table.column(c).to_numpy() for c in ("doc_id", "h1", "copies"))
        prints, rarer, off, block = _members(table)
        grams = [x for c in table.column("grams").chunks for x in c]
        links, partner = np.zeros(len(doc), np.int64), doc.copy()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                links[a:b], root = group(doc[a:b], copies[a:b], prints[a:b], rarer[off[a] : off[b]], off[a : b + 1] - off[a], block[a:b], [unpacked(x.as_buffer()) for x in grams[a:b]])
                partner[a:b] = doc[a:b][root]
        some = np.flatnonzero((links > 0) | (partner != doc))
        return pa.table({k: pa.array(v[some], pa.int64()) for k, v in (("doc_id", doc), ("h1", mark), ("links", links), ("partner", partner))})

    return run


def _buckets(sets: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, bucket, rarer, blocks): the buckets of each set that may have a partner, and those rarer than each."""
    rec = ["doc_id", "h1", "h2"]
    key = sets.select(*rec, "size", F.explode("keys").alias("key"))
    many = key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = key.join(many, "key").groupBy(*rec, "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("s")).where(F.size("s") > 1)
    key = shared.cut(own.select(*rec, "size", F.explode(F.slice("s", F.lit(1), F.size("s") - 1)["key"]).alias("bucket")))
    who = F.xxhash64(*rec)
    content = key.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(who).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), *rec)).alias("y"), F.sum("size").alias("grams")).where("n > 1")
    # buckets with the same members are one
    content = content.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    kept = key.join(content.select("bucket", "n", blocks.alias("blocks")), "bucket")
    each = kept.groupBy(*rec).agg(F.array_sort(F.collect_list(F.struct("n", "bucket", "blocks"))).alias("s")).select(*rec, "s", F.posexplode("s").alias("i", "b"))
    return each.select(*rec, F.col("b.bucket").alias("bucket"), F.slice("s", F.lit(1), F.col("i"))["bucket"].alias("rarer"), F.col("b.blocks").alias("blocks"))


def _tasks(member: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks of its bucket that its own block is in; the blocks are block and other."""
    own = F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.col("blocks")).cast("int")
    each = member.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def _links(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, h1, copies) of every document's set, and (rep, h1, links, partner) of the sets similar to others.

    rep is the least doc_id that has the set, links are the documents linked to a document with it, but for its copies,
    and partner ties the sets of a task together.
    """
    docs = shared.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rec, same = ["doc_id", "h1", "h2"], ["h1", "h2", "size"]
    sketch = shared.cut(docs.mapInArrow(_sketch(n), _SKETCH))
    member = sketch.select("doc_id", *same).distinct()
    member = shared.cut(member.join(member.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), same))
    alone = shared.cut(sketch.join(member.where("doc_id = rep").select(*rec, "copies"), rec).dropDuplicates(rec))
    bucket = shared.cut(_tasks(_buckets(alone)))
    task = ["bucket", "lo", "hi"]
    sent = shared.cut(shared.by_group(bucket.join(alone.select(*rec, "prints"), rec).select(*rec, *task, "block", "rarer", "prints"), task, _promising, _PROMISING))
    wanted = shared.cut(sent.select("doc_id").distinct())
    grams = shared.keep_ids(docs, wanted, "doc_id").mapInArrow(_gram_rows(n), "doc_id long, h1 long, h2 long, grams binary").dropDuplicates(rec)
    filled = sent.join(bucket, [*rec, *task]).join(grams.join(alone.select(*rec, "prints", "copies"), rec), rec)
    found = shared.by_group(filled.select("doc_id", "h1", *task, "block", "rarer", "prints", "copies", "grams"), task, _search(threshold), _LINKS)
    return member.select("doc_id", "rep", "h1", "copies"), shared.cut(found.select(F.col("doc_id").alias("rep"), "h1", "links", "partner"))


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that is similar to another.

    n_links counts the other documents at the threshold or above, copies among them; class_id is the least doc_id of the
    documents that links tie together, directly or through others. A document without a link is a class of its own and
    has no row. See the module's text for nulls, short and long texts and repeated rows.
    """
    member, found = _links(docs, n, threshold)
    links = found.groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    each = member.join(links, ["rep", "h1"], "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    ties = member.join(several, "doc_id", "left_semi").select("doc_id", "rep") if not several.isEmpty() else None
    edges = found.select("rep", "partner")
    root = shared.components(edges.union(ties) if ties else edges, "rep", "partner").withColumnRenamed("node", "rep")
    out = each.where("links > 0").join(F.broadcast(root) if shared.small_enough(root.count()) else root, "rep", "left")
    return out.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"), F.sum("links").cast("long").alias("n_links"))


def near_duplicates_removed(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near duplicates: of each class of similar documents the least doc_id stays.

    Columns stay as they are. Rows with a null doc_id or text are kept.
    """
    gone = similar_documents(docs, n, threshold).where("doc_id <> class_id").select("doc_id")
    return shared.drop_ids(docs, shared.cut(gone), "doc_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
