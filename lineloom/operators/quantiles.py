"""Exact quantiles of groups of any size: no sort of the rows, no buffer that grows with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom import storage

#: Each round narrows the interval in which a rank lies by so much.
BINS = 1024


def exact_quantiles(rows: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """(by, share, value): quantiles with linear interpolation between the two nearest ranks; nulls and NaN don't count.

    Every round counts the rows of each group by equal parts of the interval where a rank is known to be, keeps the part
    that has it and goes on until that holds a single value: as many rounds as the logarithm of the distinct values, each
    one pass with partial aggregates. Only the ranks' table, two rows for each group and share, is ever joined.
    """
    rows = rows.select(*by, F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = ends.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("h", (F.col("n") - 1) * F.col("share"))
    each = storage.cut(each)
    ranks = each.withColumn("r", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h"))))).select(*by, "r", "lo", "hi").distinct().withColumn("below", F.lit(0).cast("long"))
    while True:
        ranks = storage.cut(ranks)
        if ranks.where("lo < hi").isEmpty():
            break
        open_ = ranks.where("lo < hi").select(*[F.col(c).alias(f"_{c}") for c in by], "r", "lo", "hi", "below")
        same = _every([F.lit(True), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)])
        part = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        near = rows.join(open_, same & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(*by, "r", "below", part.alias("part")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("k").over(Window.partitionBy(*by, "r").orderBy("part"))
        found = near.withColumn("upto", upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("k"))).select(*by, "r", "lo", "hi", (F.col("upto") - F.col("k")).alias("below"))
        ranks = ranks.where("lo = hi").unionByName(found)
    both = each
    for name, rank in (("a", F.floor("h")), ("b", F.ceil("h"))):
        side = ranks.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.col("r").alias(f"{name}_r"), F.col("lo").alias(name))
        both = both.join(side, _every([rank == F.col(f"{name}_r"), *(F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in by)]))
    return both.select(*by, "share", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("value"))


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
