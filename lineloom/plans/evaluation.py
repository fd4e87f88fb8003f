"""Queries that compare output with truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.operators import evaluation as ev
from lineloom.plans.registry import query
from lineloom.plans.text import _table


WORD = r"\p{L}+"


def _word_pairs(spark, sf):
    """Each word of a document against the one before it: a truth and an output with the alignment known."""
    w = F.col("w")
    rest = F.greatest(F.size(w) - 1, F.lit(0))  # a filter on the size would look for the words a second time
    docs = _table(spark, sf, "documents").where("text is not null").select("doc_id", "lang", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    pairs = docs.select("doc_id", "lang", F.explode(F.arrays_zip(F.slice(w, F.lit(1), rest).alias("gt"), F.slice(w, F.lit(2), rest).alias("pred"))).alias("x"))
    return pairs.select("doc_id", "lang", F.col("x.gt").alias("gt"), F.col("x.pred").alias("pred"))


#: DuckDB's distance counts bytes, so the SQL writes each accented letter as a sign that no word holds.
ACCENTED, SIGNS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü", "0123456789!#$%&()*+,-"
PAIRS_SQL = "SELECT doc_id, lang, w[i] AS gt, w[i+1] AS pred FROM (SELECT doc_id, lang, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '\\p{L}+') AS w FROM documents))"
_SIGNS = lambda x: f"translate({x}, '{ACCENTED}', '{SIGNS}')"
SIGNED_SQL = f"SELECT doc_id, lang, {_SIGNS('gt')} AS gt, {_SIGNS('pred')} AS pred, {_SIGNS('lower(gt)')} AS lower_gt, {_SIGNS('lower(pred)')} AS lower_pred FROM ({PAIRS_SQL})"


@query(f"SELECT lang, CAST(sum(levenshtein(pred, gt)) AS BIGINT) AS err, CAST(sum(length(gt)) AS BIGINT) AS total, round(sum(levenshtein(pred, gt)) / sum(length(gt)), 6) AS error_rate FROM ({SIGNED_SQL}) GROUP BY lang")
def char_error_rate_by_lang(spark, sf):
    """Flagship: character error rate of each word against the one before it, by language."""
    p = _word_pairs(spark, sf).withColumn("missing", F.lit(0)).withColumn("err", F.levenshtein("pred", "gt")).withColumn("total", F.length("gt"))
    return ev.error_rates(p, ["lang"]).select("lang", "err", "total", "error_rate")


PARTS_SQL = "SELECT p_partkey AS file, p_brand AS brand, p_name AS gt, replace(coalesce(s_name, ''), '#', '') AS pred, CASE WHEN s_name IS NULL THEN length(p_name) ELSE 0 END AS missing FROM part LEFT JOIN supplier ON p_partkey = s_suppkey"


def _parts(spark, sf):
    gt = _table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("brand"), F.col("p_name").alias("text"))
    out = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_name").alias("text"))
    return ev.pair_up(gt, out, ["file"])


@query(
    f"WITH m AS (SELECT brand, missing, levenshtein(pred, gt) AS err, length(gt) AS total FROM ({PARTS_SQL})) SELECT brand, CAST(sum(err) AS BIGINT) AS err, CAST(sum(total) AS BIGINT) AS total, CAST(sum(missing) AS BIGINT) AS missing, round(sum(err) / nullif(sum(total), 0), 6) AS error_rate, round((sum(err) - sum(missing)) / nullif(sum(total) - sum(missing), 0), 6) AS rate_without_missing FROM m GROUP BY brand"
)
def error_rate_with_missing(spark, sf):
    """Truth left-joined with output: what has no output counts as empty."""
    return ev.error_rates(ev.distances(_parts(spark, sf)), ["brand"])


@query(f"SELECT file, brand, gt, pred, CAST(missing AS BIGINT) AS missing, CAST(levenshtein(pred, gt) AS BIGINT) AS err, CAST(length(gt) AS BIGINT) AS total FROM ({PARTS_SQL})")
def error_per_file(spark, sf):
    return ev.distances(_parts(spark, sf))


@query(
    f"SELECT count(*) AS lines, CAST(sum(length(gt)) AS BIGINT) AS chars, round(sum(levenshtein(pred, gt)) / sum(length(gt)), 6) AS strict_rate, round(sum(levenshtein(lower_pred, lower_gt)) / sum(length(gt)), 6) AS lenient_rate FROM ({SIGNED_SQL})"
)
def strict_and_lenient_rate(spark, sf):
    return ev.strict_and_lenient(_word_pairs(spark, sf)).withColumn("chars", F.col("chars").cast("long"))


@query()
def confusion_list(spark, sf):
    """Every differing passage of every truth and output, with the pair's cost."""
    return ev.confusion_rows(_parts(spark, sf).drop("brand", "missing"))


@query()
def confusion_counts(spark, sf):
    return ev.merge_counts(ev.confusion_rows(_parts(spark, sf)), "pred_part", "gt_part")


@query()
def top_confusions(spark, sf):
    """The ten most frequent confusions."""
    return ev.top_counts(ev.merge_counts(ev.confusion_rows(_parts(spark, sf)), "pred_part", "gt_part"), 10, "pred_part", "gt_part")


@query(f"WITH c AS (SELECT lang, gt, pred, count(*) AS n FROM ({PAIRS_SQL}) WHERE gt <> pred GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gt, pred) AS rank FROM c) SELECT lang, gt, pred, n, rank FROM r WHERE rank <= 20")
def top_word_confusions_per_lang(spark, sf):
    return ev.top_pairs_per(_word_pairs(spark, sf).where("gt <> pred"), "lang", "gt", "pred", 20)


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS in_both, count(*) FILTER (WHERE l.doc_id IS NULL) AS gt_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS out_only FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def presence_check(spark, sf):
    return ev.presence(_table(spark, sf, "documents"), _table(spark, sf, "labels"), "doc_id")


@query("SELECT a.doc_id AS gt_id, b.doc_id AS out_id FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id")
def inner_join_on_hash(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    return d.withColumnRenamed("doc_id", "gt_id").join(d.withColumnRenamed("doc_id", "out_id"), "hash").where("gt_id < out_id").select("gt_id", "out_id")


@query("SELECT doc_id, text FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def write_only_new(spark, sf):
    """What a sink that never overwrites may append."""
    return ev.write_only_new(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels"), "doc_id")
