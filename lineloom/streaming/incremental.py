"""Incremental evaluation on streams: running error rates, confusion counts, moving statistics, leader clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_error_rates(pairs: DataFrame, by: str) -> DataFrame:
    """Streaming (by, pred, gt) to running sums by group; write in complete or update mode."""
    p = pairs.withColumn("err", F.levenshtein("pred", "gt")).withColumn("total", F.length("gt"))
    return p.groupBy(by).agg(F.sum("err").alias("err"), F.sum("total").alias("total")).withColumn("error_rate", F.round(F.try_divide(F.col("err"), F.col("total")), 6))


def windowed_error_rates(pairs: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """The same by event-time window; rows later than `late` are dropped."""
    p = pairs.withWatermark(ts, late).withColumn("err", F.levenshtein("pred", "gt")).withColumn("total", F.length("gt"))
    return p.groupBy(F.window(ts, width).alias("w")).agg(F.sum("err").alias("err"), F.sum("total").alias("total")).select("w.start", "w.end", "err", "total")


def running_confusions(confusions: DataFrame) -> DataFrame:
    return confusions.groupBy("pred_part", "gt_part").agg(F.count("*").alias("n"))


def leaders(vectors: DataFrame, group: str, key: str, vector: str, eps: float) -> DataFrame:
    """(group, key, leader) as vectors arrive: a vector joins the group's nearest leader closer than eps or becomes one."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, flat = (list(x) for x in state.get) if state.exists else ([], [])
        for part in parts:
            out = []
            for k, v in zip(part[key], part[vector], strict=True):
                v = np.asarray(v, float)
                held = np.array(flat, float).reshape(len(ids), -1)
                d = ((held - v) ** 2).sum(1) if len(ids) else np.array([np.inf])
                if d.min() >= eps * eps:
                    ids.append(int(k))
                    flat.extend(v.tolist())
                    out.append((name[0], k, k))
                else:
                    out.append((name[0], k, ids[int(d.argmin())]))
            yield pd.DataFrame(out, columns=[group, key, "leader"])
        state.update((ids, flat))

    return vectors.groupBy(group).applyInPandasWithState(step, f"{group} long, {key} long, leader long", "ids array<long>, flat array<double>", "append", "NoTimeout")
