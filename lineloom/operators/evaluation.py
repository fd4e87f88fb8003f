"""Comparing output with ground truth: error rates, confusions, presence."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions import edit, text

RATIO = lambda a, b: F.round(F.try_divide(a, b), 6)


#: First members of a group whose pairs are counted first, and the most groups for which that is done.
FREQUENT, MOST_GROUPS = 500, 1000


def pair_up(gt: DataFrame, out: DataFrame, on: list[str]) -> DataFrame:
    """gt with the output's text beside it: its columns, gt, pred and missing; no output counts as the empty text."""
    joined = gt.withColumnRenamed("text", "gt").join(out.withColumnRenamed("text", "pred"), on, "left")
    missing = F.when(F.col("pred").isNull(), F.length("gt")).otherwise(0)
    return joined.select(*[c for c in joined.columns if c not in ("gt", "pred")], "gt", F.coalesce("pred", F.lit("")).alias("pred"), missing.cast("long").alias("missing"))


def distances(pairs: DataFrame, kind: str = "exact", compose: bool = True) -> DataFrame:
    """pairs with both sides projected and their edit distance err; equal texts never reach the distance."""
    p = pairs.withColumn("gt", text.project_text(F.col("gt"), kind, compose)).withColumn("pred", text.project_text(F.col("pred"), kind, compose))
    return p.withColumn("err", F.when(F.col("gt") == F.col("pred"), 0).otherwise(F.levenshtein("pred", "gt")).cast("long")).withColumn("total", F.length("gt").cast("long"))


def error_rates(measured: DataFrame, by: list[str] | None = None) -> DataFrame:
    """err, total, missing, and the rates with and without what is missing; a rate over nothing is null."""
    sums = measured.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("err", "total", "missing")))
    return sums.withColumn("error_rate", RATIO(F.col("err"), F.col("total"))).withColumn("rate_without_missing", RATIO(F.col("err") - F.col("missing"), F.col("total") - F.col("missing")))


def strict_and_lenient(pairs: DataFrame) -> DataFrame:
    """Error rates with every character, and with neither space nor case."""
    both = lambda f: F.levenshtein(f(F.col("pred")), f(F.col("gt")))
    loose = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    sums = pairs.agg(F.count("*").alias("lines"), F.sum(F.length("gt")).alias("chars"), F.sum(both(lambda c: c)).alias("strict"), F.sum(both(loose)).alias("lenient"))
    return sums.select("lines", "chars", RATIO(F.col("strict"), F.col("chars")).alias("strict_rate"), RATIO(F.col("lenient"), F.col("chars")).alias("lenient_rate"))


def confusion_rows(pairs: DataFrame, context: int = 1) -> DataFrame:
    """pairs' columns with a row for each differing passage (pred_part, gt_part) and the pair's cost."""
    c = pairs.withColumn("_c", edit.confusions(F.col("pred"), F.col("gt"), context))
    keys = [x for x in pairs.columns if x not in ("pred", "gt")]
    return c.select(*keys, F.col("_c.cost").alias("cost"), F.explode("_c.confusions").alias("x")).select(*keys, "cost", F.col("x.pred").alias("pred_part"), F.col("x.gt").alias("gt_part"))


def merge_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counters merged: rows counted by the columns, map-side first."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def top_counts(counts: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k greatest n; ties in the order of the columns."""
    return counts.orderBy(F.desc("n"), *tie).limit(k)


def top_counts_per(counts: DataFrame, group: list[str], k: int, *tie: str) -> DataFrame:
    """The k greatest n of every group."""
    w = Window.partitionBy(*group).orderBy(F.desc("n"), *tie)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_pairs_per(pairs: DataFrame, group: str, a: str, b: str, k: int) -> DataFrame:
    """(group, a, b, n, rank): the k most frequent pairs (a, b) of every group, of strings of which none is null.

    A pair is no more frequent than its a, so pairs of the FREQUENT most frequent a of a group are counted first. Where the
    k-th of them is more frequent than any other a, no other pair can be among the k; groups where it isn't, or that have
    fewer, are counted in full, as all are when there are more than MOST_GROUPS.
    """
    ranked = top_counts_per(merge_counts(pairs, group, a), [group], FREQUENT + 1, a).select(group, a, "n", "rank")
    found = ranked.limit(MOST_GROUPS * (FREQUENT + 1) + 1).toArrow()
    if found.num_rows > MOST_GROUPS * (FREQUENT + 1):
        return top_counts_per(merge_counts(pairs, group, a, b), [group], k, a, b)
    spark, first = pairs.sparkSession, pc.less_equal(found["rank"], FREQUENT)
    rest = {r[group]: r["n"] for r in found.filter(pc.invert(first)).to_pylist()}  # no a that is left out is more frequent
    frequent = spark.createDataFrame(found.filter(first).select([group, a]).rename_columns(["own", "word"]))
    held = pairs.join(F.broadcast(frequent), F.col(group).eqNullSafe(F.col("own")) & (F.col(a) == F.col("word")), "left_semi")
    top = top_counts_per(merge_counts(held, group, a, b), [group], k, a, b).select(group, a, b, "n", "rank").toArrow()
    least = {r[group]: r["n"] for r in top.to_pylist() if r["rank"] == k}
    open_ = [g for g, n in rest.items() if least.get(g, 0) <= n]
    done = spark.createDataFrame(top.filter(pa.array([g not in open_ for g in top[group].to_pylist()], pa.bool_())))
    if not open_:
        return done
    again = pairs.join(F.broadcast(spark.createDataFrame(pa.table({"own": pa.array(open_, found.schema.field(group).type)}))), F.col(group).eqNullSafe(F.col("own")), "left_semi")
    return done.unionByName(top_counts_per(merge_counts(again, group, a, b), [group], k, a, b))


def presence(gt: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """Number of keys in both, only in gt, only in out; one pass over the union instead of three joins."""
    both = gt.select(key, F.lit(1).alias("g"), F.lit(0).alias("o")).unionAll(out.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("g").alias("g"), F.max("o").alias("o"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(n((F.col("g") == 1) & (F.col("o") == 1)).alias("in_both"), n(F.col("o") == 0).alias("gt_only"), n(F.col("g") == 0).alias("out_only"))


def write_only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet and whose text isn't empty: what a no-overwrite sink may append."""
    return rows.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(existing.select(key), key, "left_anti")


def share(n: Column, *by: str) -> Column:
    """n over the sum of n, of 0.1 at least."""
    return F.round(n / F.greatest(F.sum(n).over(Window.partitionBy(*by)), F.lit(0.1)), 9)
