"""Line deduplication by overlapping windows of three lines.

Every three consecutive non-blank lines (trimmed) are hashed, repeated windows are found over all documents, and the
lines covered by any occurrence but the first (least doc_id, then position) are removed, overlapping windows merging into
one span. Where a window overlaps its own first occurrence in the same document, the lines of the first stay.

Windows are compared by 128 bits of hash. Only hashes and positions are shuffled; the texts move only if the table of
removals is too large to broadcast.

Documents of fewer than three non-blank lines have no window and stay as they are, as do rows with a null doc_id or text
and empty texts. Rows with the same doc_id are one document: they do not repeat each other, and the lines found are removed
from all of them. Ties: of occurrences at the same doc_id the earlier one is the first. A document all of whose lines go
has the empty text. A very long text is one row of windows, held by its task as hashes. Other columns, whatever their names,
are ignored. No rows: an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared

ORACLE = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, i, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM raw WHERE trim(line) <> ''),
w AS (SELECT * FROM (SELECT doc_id, p, [i, lead(i, 1) OVER d, lead(i, 2) OVER d] AS ix, [t, lead(t, 1) OVER d, lead(t, 2) OVER d] AS k, lead(i, 2) OVER d AS third FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)) WHERE third IS NOT NULL),
r AS (SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp FROM w WINDOW o AS (PARTITION BY k ORDER BY doc_id, p)),
gone AS (SELECT DISTINCT doc_id, unnest(CASE WHEN fd = doc_id AND p < fp + 3 THEN list_slice(ix, fp + 3 - p + 1, 3) ELSE ix END) AS i FROM r WHERE n > 1),
kept AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.i) AS text FROM raw ANTI JOIN gone ON raw.doc_id = gone.doc_id AND raw.i = gone.i GROUP BY raw.doc_id),
num AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(num.c, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN num ON d.doc_id = num.doc_id
"""


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, at, h1, h2): every window's place among the non-blank lines, its line numbers and hashes."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t"))), lambda s: s["t"] != "")
    lines = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["t"]).alias("a"), F.xxhash64(F.lit(1), s["t"]).alias("b")))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("l")).where(F.size("l") >= 3)
    three = lambda name, p: [F.get("l", p + k)[name] for k in range(3)]
    each = F.transform(F.sequence(F.lit(0), F.size("l") - 3), lambda p: F.struct(p.alias("pos"), F.array(*three("i", p)).alias("at"), F.xxhash64(*three("a", p)).alias("h1"), F.xxhash64(*three("b", p)).alias("h2")))
    return docs.select("doc_id", F.explode(each).alias("w")).select("doc_id", "w.*")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): sorted line numbers that occurrences other than the first cover."""
    window = windows(docs)
    again = window.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = shared.cut(again)
    again = F.broadcast(again) if shared.small_enough(again.count()) else again
    later = window.join(again, ["h1", "h2"]).where(F.struct("doc_id", "pos") != F.col("first"))
    own = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("pos") < F.col("first.pos") + 3)
    skip = F.when(own, F.col("first.pos") + 3 - F.col("pos")).otherwise(0)
    later = later.select("doc_id", F.slice("at", skip + 1, F.lit(3)).alias("at")).where(F.size("at") > 0)
    return later.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"))


def lines_deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed) of every row: the text without the lines that an earlier window has."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = shared.cut(covered_lines(docs))
    lines = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    side = F.broadcast(gone) if shared.small_enough(gone.count()) and shared.small_enough(lines, 4) else gone
    raw = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(raw, i)), "\n"))
    return docs.join(side, "doc_id", "left").select("doc_id", text.alias("text"), F.when(F.col("text").isNotNull() & F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
