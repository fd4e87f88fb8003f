"""Every query against its SQL on the smallest tables; the others give rows of a stable schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lineloom.plans import catalog

SF = "/root/testdata/sf0.001"
EMPTY: set[str] = set()


def norm(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows or name in EMPTY
        return
    cur = duck.execute(catalog.ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    names = [c[0] for c in cur.description]
    assert cols == sorted(df.columns)
    want = sorted("|".join(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())
    assert sorted("|".join(norm(r[c]) for c in cols) for r in rows) == want


def test_numeric_rank_has_all_rows_and_empty_cells_last(spark):
    from lineloom.plans import relational

    cells = [(k, f"Brand#{k % 40 + 1}" if k % 5 else ("" if k % 2 else "none")) for k in range(200)]
    rows = relational.numeric_ranks(spark.createDataFrame(cells, "id long, cell string"), "cell", "id").collect()
    want = sorted(cells, key=lambda r: (r[0] % 5 == 0, int(r[1][6:]) if r[0] % 5 else 0, r[0]))
    assert [(r["id"], r["cell"]) for r in rows] == want and [r["rank"] for r in rows] == list(range(1, 201))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
