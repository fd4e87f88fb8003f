"""Mixing sources to target weights by the cube method.

Every document gets the inclusion probability of its source: pi = min(1, c * weight / tokens of the source), c being such
that the sample has `keep` of all tokens; a source that is too small for its weight is taken whole and the rest share
what it leaves, so the weights hold between the sources that have more than their share. The flight phase moves the
probabilities of three documents at a time along the null space of two constraints, the number of documents and the number
of tokens, until one of the three is 0 or 1; both totals stay exactly what they were. It runs in groups of about GROUP
documents of one source, again over what the groups leave (two at most each) while a source has more than a group of
those, then in groups across sources, and at last over the GROUP documents at most that are left; the landing then gives
up the token total, and at the very end the document count, for the last two documents.

A hot source is many groups. What is collected is GROUP documents at most; the sources' table is never collected.

Random numbers come from the seed and the documents' ids: the same input gives the same sample, and ties (documents of
the same number of tokens) are told apart by doc_id. Null doc_id: never taken. A null source is a source of its own; a null
or empty text has 0 tokens, and a source without tokens is left out. Rows with the same doc_id and source are one unit. A
text of any length is one unit, counted whole. Other columns, whatever their names, are ignored by the sample and pass
through the stage. No rows: an empty sample.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

KEEP, SEED, GROUP, EPS = 0.8, 20260101, 5000, 1e-9
UNIT = "doc_id long, source string, n_tokens long, p double, pi double"


def waterfill(sources: DataFrame, weights: dict[str | None, float] | None, keep: float) -> DataFrame:
    """(s, pi) of the sources in (s, t), t tokens each: c rises until the sources that it takes whole no longer change."""
    spark = sources.sparkSession
    if weights is None:
        table = sources.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        table = sources.join(F.broadcast(given) if shared.small_enough(len(weights)) else given, F.col("s").eqNullSafe(F.col("k")), "left").drop("k").withColumn("w", F.coalesce("w", F.lit(0.0)))
    table = shared.cut(table)
    budget, c = keep * (table.agg(F.sum("t")).first()[0] or 0), 0.0
    table = table.where("t > 0 and w > 0")
    while True:
        free = F.col("w") * c < F.col("t")
        whole, rest = table.agg(F.sum(F.when(~free, F.col("t"))), F.sum(F.when(free, F.col("w")))).first()
        if rest is None:
            break
        above = (budget - (whole or 0)) / rest
        if above <= c * (1 + 1e-12):
            break
        c = above
    return table.select("s", F.least(F.lit(1.0), F.lit(c) * F.col("w") / F.col("t")).alias("pi"))


def flight(p: list[float], tokens: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight: sums of p and of p * tokens as before, at most two values inside (0, 1)."""
    p = list(p)
    held: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            held.append(k)
        if len(held) < 3:
            continue
        i, j, m = held
        u = (tokens[m] - tokens[j], tokens[i] - tokens[m], tokens[j] - tokens[i])
        scale = max(map(abs, u))
        u = tuple(x / scale for x in u) if scale else (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, q in zip(u, (p[i], p[j], p[m]), strict=True):
            if x > 0:
                up, down = min(up, (1 - q) / x), min(down, q / x)
            elif x < 0:
                up, down = min(up, q / -x), min(down, (1 - q) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for x, q in zip(u, held, strict=True):
            p[q] += step * x
        for q in held:
            p[q] = 0.0 if p[q] < EPS else 1.0 if p[q] > 1 - EPS else p[q]
        held = [q for q in held if 0 < p[q] < 1]
    return p


def land(p: list[float], rng: random.Random) -> list[float]:
    """The rest decided: first by keeping the expected count, then the last unit by its own chance."""
    p = list(p)
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    while len(open_) > 1:
        i, j = open_[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() * (up + down) < down else -down
        p[i], p[j] = p[i] + step, p[j] - step
        for q in (i, j):
            p[q] = 0.0 if p[q] < EPS else 1.0 if p[q] > 1 - EPS else p[q]
        open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    for k in open_:
        p[k] = 1.0 if rng.random() < p[k] else 0.0
    return p


def _flown(seed: int, level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        rng = random.Random(f"{seed}/{level}/{group['source'].iloc[0]}/{group['doc_id'].iloc[0]}")
        return group.assign(p=flight(group["p"].tolist(), group["n_tokens"].astype(float).tolist(), rng))[["doc_id", "source", "n_tokens", "p", "pi"]]

    return run


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = textkernel.utf8(batch.column("text"), lower=False)
        count = np.zeros(len(off) - 1, np.int64)
        for i, j in textkernel.slices(off, textkernel.PIECE):
            for a in range(int(off[i]), int(off[j]), textkernel.PIECE):  # one step but for a long text
                b = min(int(off[j]), a + textkernel.PIECE)
                solid = ~_SPACE[data[a:b]]
                first = solid.copy()
                first[1:] &= ~solid[:-1]
                first[0] &= a == off[i] or bool(_SPACE[data[a - 1]])
                begins = off[i:j][(off[i:j] > a) & (off[i:j] < b)] - a
                first[begins] = solid[begins]
                row = np.searchsorted(off[i : j + 1], np.flatnonzero(first) + a, side="right") - 1
                count[i:j] += np.bincount(row, minlength=j - i)[: j - i]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(count)], ["doc_id", "source", "n_tokens"])


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): white-space separated words of the text."""
    rows = shared.small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shared.lean(_token_counts), "doc_id long, source string, n_tokens long").groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, keep: float = KEEP, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(doc_id, source, n_tokens, pi) of the documents taken. weights: by source; equal if None, 0 for a source not in it.

    group must be 5 at least, for each round to leave fewer documents than it got.
    """
    spark = docs.sparkSession
    unit = shared.cut(units(docs))
    pi = waterfill(unit.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("t")), weights, keep)
    parts = unit.groupBy(F.col("source").alias("s0")).agg(F.ceil(F.count("*") / group).alias("parts"))
    pi = shared.cut(pi.join(parts, F.col("s").eqNullSafe(F.col("s0"))).drop("s0"))
    table = F.broadcast(pi) if shared.small_enough(pi.count()) else pi
    unit = unit.join(table, unit["source"].eqNullSafe(table["s"])).select("doc_id", "source", "n_tokens", F.col("pi").alias("p"), "pi", "parts")
    out = ["doc_id", "source", "n_tokens", "pi"]
    done, left, level, keys = unit.where("p >= 1").select(*out), unit.where("p > 0 and p < 1"), 0, ["source"]
    while True:
        part = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed + level)), F.col("parts"))
        flown = shared.cut(left.groupBy(*keys, part).applyInPandas(_flown(seed, level), UNIT))
        done, rest, level = done.union(flown.where("p = 1").select(*out)), flown.where("p > 0 and p < 1"), level + 1
        counts = rest.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
        n, most = counts.agg(F.sum("n"), F.max("n")).first()
        if keys and (most or 0) > 2:
            left = rest.join(counts.select("s", F.ceil(F.col("n") / group).alias("parts")), rest["source"].eqNullSafe(F.col("s"))).drop("s")
        elif (n or 0) > group:
            keys, left = [], rest.withColumn("parts", F.lit(math.ceil(n / group)).cast("long"))
        else:
            break
    rows = sorted(rest.collect(), key=lambda r: (str(r["source"]), r["doc_id"]))  # group rows at most
    rng = random.Random(f"{seed}/land")
    p = land(flight([r["p"] for r in rows], [float(r["n_tokens"]) for r in rows], rng), rng)
    landed = spark.createDataFrame([(r["doc_id"], r["source"], r["n_tokens"], r["pi"]) for r, x in zip(rows, p, strict=True) if x == 1.0], "doc_id long, source string, n_tokens long, pi double")
    return done.union(landed)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of docs, columns as they are, whose document is in the sample."""
    taken = shared.cut(sample(docs, weights, keep, seed).select("doc_id", F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")))
    side = F.broadcast(taken) if shared.small_enough(taken.count()) else taken
    same = (docs["doc_id"] == side["doc_id"]) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == side["_source"]) & (docs["source"].isNull() == side["_none"])
    return docs.join(side, same, "left_semi")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))
