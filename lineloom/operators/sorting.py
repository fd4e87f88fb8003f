"""Whole-table order and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom import storage


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with rank, 1 for the first in the order, which should be total; no task sorts more than a range of them.

    The sorted rows are written once; the ranks within the ranges are then moved by the ranges' counts, one row a range.
    """
    place = F.monotonically_increasing_id()
    made = storage.cut(rows.orderBy(*order).withColumn("_m", place)).withColumn("_p", F.shiftright("_m", 33))
    before = made.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).drop("n")
    return made.join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m", "_p", "_before")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows, the same for the same seed and keys whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
