"""Python functions over many small groups: rows sorted by group go to Python in batches, so no more than a group is held."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

#: Bytes of input files that one task sorts.
TASK_BYTES = 16 << 20


def _tasks(rows: DataFrame) -> int:
    """Tasks for the files that rows are from; 0 if they are from none."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50) // TASK_BYTES  # tables in memory may say that their size is unknown by a huge one


def by_key(rows: DataFrame, by: str) -> DataFrame:
    """rows sorted by a column in tasks that have all of a key; the tasks grow in number with the input, not in size."""
    tasks = _tasks(rows)
    apart = rows.repartition(tasks, by) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(F.col(by))
    return apart.sortWithinPartitions(by)


def _values(column: pa.Array) -> list:
    """to_pylist, which makes an object of Arrow's for every cell; without nulls it can be done without."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_string(column.type):
        d = column.dictionary_encode()
        return list(map(d.dictionary.to_pylist().__getitem__, d.indices.to_numpy().tolist()))
    return column.to_numpy(zero_copy_only=False).tolist()


def per_group(rows: DataFrame, by: str, columns: list[str], f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(by, columns of schema): f gets a group's rows as tuples of the columns, in no order, and returns rows.

    For groups of a page, line or lattice, which are small by their nature: the cost a group is that of the call alone.
    by is an integer; schema has long, double and string columns.
    """
    names, kinds = [c.split()[0] for c in schema.split(", ")], [_KINDS[c.split()[1]] for c in schema.split(", ")]

    def made(out: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*out, strict=True)) or [()] * (1 + len(names))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, [pa.int64(), *kinds], strict=True)], [by, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the last group so far, which may go on in the next batch
        last = None
        for batch in batches:
            keys = _values(batch.column(0))
            cells = list(zip(*(_values(batch.column(1 + k)) for k in range(len(columns))), strict=True))
            out, at = [], 0
            for end in [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)]:
                group, at = (held + cells[at:end] if held else cells[at:end]), end
                held = []
                if group:
                    out += [(last, *row) for row in f(group)]
                last = keys[end]
            held += cells[at:]
            yield made(out)
        if held:
            yield made([(last, *row) for row in f(held)])

    return by_key(rows.select(F.col(by).cast("long").alias(by), *columns), by).mapInArrow(run, f"{by} long, {schema}")
