"""What the corpus operators share: the shared folder, size-checked semi joins, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.storage import cut, fresh_path, remove, shared_dir  # noqa: F401

#: A side is broadcast only while its rows, at BROADCAST_ROW_BYTES each, stay below this.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROW_BYTES = 64
#: Bytes of a batch that goes to a Python task, in place of Spark's 64 MB, unless the session has a setting of its own.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session sending texts to Python tasks in batches of BATCH_BYTES, which bounds what a task holds of them."""
    if df.sparkSession.conf.get(_BATCH, "67108864b") in ("67108864", "67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the machine: Python workers are used again by later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that gives its memory back when the task's last batch is done."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run(rows, starts of the groups and their end) over many whole groups at a time, for groups that are mostly tiny.

    The rows are repartitioned and sorted by keys; a task holds one batch and the group that goes on beyond it, so the
    groups themselves must be bounded.
    """

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and all(batch.column(k)[-1] == held[0].column(k)[-1] for k in keys):
                continue  # still the same group
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                yield from run(table.slice(0, int(at[-1])), at).to_batches()
                table = table.slice(int(at[-1]))
            held = table.to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from run(table, np.append(starts(table), len(table))).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(stream), schema)


def small_enough(rows: int, row_bytes: int = BROADCAST_ROW_BYTES) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def keep_ids(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Left semi join; ids (already materialised by cut) is broadcast only when its counted size allows it."""
    return df.join(F.broadcast(ids) if small_enough(ids.count()) else ids, on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Left anti join under the same size check as keep_ids."""
    return df.join(F.broadcast(ids) if small_enough(ids.count()) else ids, on, "left_anti")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node of each connected component of the undirected pairs.

    Alternates hooking every node to its least neighbour's label with pointer jumping, so the rounds grow with the
    logarithm of a component's diameter; each round is materialised in the shared folder. No pairs: an empty table.
    """
    edges = cut(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(F.col(b), F.col(a))).where("u <> v").distinct())
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")))
        changed = after.where("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
