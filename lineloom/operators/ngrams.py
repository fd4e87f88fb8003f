"""Character n-graph models as tables (prefix, ch, n, neglogp)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions import text

#: n-graphs of so many characters fit in 63 bits.
PACKED = 3


def counts(lines: DataFrame, n: int, column: str = "line", digits: bool = False, drop_last: bool = True) -> DataFrame:
    """(prefix, ch, n) of all n-graphs of the lines of three characters or more, padded with n - 1 "_" on either side.

    drop_last leaves out the last n-graph of each line, as models built this way always have.
    """
    long = lines.where(F.length(column) >= 3)
    if n <= PACKED:
        return long.select(column).mapInArrow(_batch_counts(n, digits, drop_last), "prefix string, ch string, n long").groupBy("prefix", "ch").agg(F.sum("n").alias("n"))
    pad = F.lit("_" * (n - 1))
    folded = long.select(F.concat(pad, text.fold_for_model(F.col(column), digits), pad).alias("s"))
    chars = folded.select(F.split("s", "").alias("s"))
    last = F.size("s") - n + (0 if drop_last else 1)
    whole = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat(*(F.get("s", i + k) for k in range(n))))
    grams = chars.where(last > 0).select(F.explode(whole).alias("g"))
    return grams.groupBy("g").agg(F.count("*").alias("n")).select(F.substring("g", 1, n - 1).alias("prefix"), F.substring("g", n, 1).alias("ch"), "n")


def _batch_counts(n: int, digits: bool, drop_last: bool):
    """Counts of each batch: its folded characters as numbers, n of them packed in one, so only distinct n-graphs become rows."""
    pad = "_" * (n - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [pad + text.folded(x, digits) + pad for x in batch.column(0).to_pylist()]
            points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.int64)
            size = np.array([len(x) for x in lines], np.int64)
            count = np.maximum(size - n + (0 if drop_last else 1), 0)
            start = np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count) + np.arange(count.sum())
            there = np.flatnonzero(np.bincount(points))  # the batch's characters, few as they are, numbered
            number = np.zeros(there[-1] + 1 if len(there) else 0, np.int64)
            number[there] = np.arange(len(there))
            coded, packed = number[points], np.zeros(len(start), np.int64)
            for k in range(n):
                packed = packed * len(there) + coded[start + k]
            if len(there) ** n <= 4 * len(packed):
                times = np.bincount(packed)
                found = np.flatnonzero(times)
                times = times[found]
            else:
                found, times = np.unique(packed, return_counts=True)
            chars = np.stack([there[found // len(there) ** (n - 1 - k) % len(there)] for k in range(n)], 1).astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([chars[i : i + n - 1] for i in range(0, len(chars), n)], pa.string()), pa.array(list(chars[n - 1 :: n]), pa.string()), pa.array(times.astype(np.int64))], ["prefix", "ch", "n"])

    return run


def posteriors(count: DataFrame) -> DataFrame:
    """count with neglogp = log(total of the prefix + 1) - log(n), and for every prefix the reject "~" counted once."""
    total = F.sum("n").over(Window.partitionBy("prefix"))
    first = F.row_number().over(Window.partitionBy("prefix").orderBy("ch")) == 1
    each = count.select("prefix", "ch", "n", total.alias("t"), first.alias("first"))
    own = F.struct("ch", "n")
    rows = F.when(F.col("first"), F.array(own, F.struct(F.lit("~").alias("ch"), F.lit(1).cast("long").alias("n")))).otherwise(F.array(own))
    return each.select("prefix", "t", F.explode(rows).alias("r")).select("prefix", "r.ch", "r.n", F.round(F.log(F.col("t") + 1) - F.log("r.n"), 6).alias("neglogp"))


def look_up(wanted: DataFrame, model: DataFrame, missing: float = 15.0) -> DataFrame:
    """wanted (prefix, ch) with its cost in the model, `missing` where the model has none."""
    return wanted.join(model.select("prefix", "ch", "neglogp"), ["prefix", "ch"], "left").withColumn("cost", F.coalesce("neglogp", F.lit(missing))).drop("neglogp")


def back_off(wanted: DataFrame, primary: DataFrame, secondary: DataFrame, missing: float = 15.0) -> DataFrame:
    """wanted (prefix, ch) with the primary model's cost, else that of a shorter-prefix model, else `missing`."""
    m = secondary.select(F.length("prefix").alias("k")).limit(1)
    short = wanted.crossJoin(F.broadcast(m)).withColumn("short", F.expr("right(prefix, k)")).drop("k")
    p = primary.select("prefix", "ch", F.col("neglogp").alias("c1"))
    s = secondary.select(F.col("prefix").alias("short"), "ch", F.col("neglogp").alias("c2"))
    return short.join(p, ["prefix", "ch"], "left").join(s, ["short", "ch"], "left").select("prefix", "ch", F.coalesce("c1", "c2", F.lit(missing)).alias("cost"))


def best_guesses(model: DataFrame, k: int = 5) -> DataFrame:
    """The k cheapest characters after each prefix, without the reject."""
    w = Window.partitionBy("prefix").orderBy("neglogp", "ch")
    return model.where("ch <> '~'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
