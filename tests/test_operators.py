"""Operators on tables against plain versions."""

from __future__ import annotations

import random

import numpy as np

from lineloom.operators import lattice, layout, quantiles, records, sorting, vectors
from lineloom.sources import files


def test_exact_quantiles(spark):
    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 1e6) for _ in range(500)], "b": [1.0] * 400 + [2.0], None: [5.0], "c": [rng.choice((1e-9, 3.0, -1e300, 1e300)) for _ in range(50)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {(r[0], r[1]): r[2] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    assert len(got) == 4 * len(values)
    for g, vs in values.items():
        for q in (0.0, 0.3, 0.5, 1.0):
            s, h = sorted(vs), (len(vs) - 1) * q
            want = s[int(h)] + (h - int(h)) * (s[min(int(h) + 1, len(s) - 1)] - s[int(h)])
            assert np.isclose(got[g, q], want, rtol=1e-9)


def test_leaders_are_those_of_one_pass_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    held = []
    for v in x:
        if not held or ((x[held] - v) ** 2).sum(1).min() >= 0.8**2:
            held.append(len(held) and int(np.flatnonzero((x == v).all(1))[0]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 3), (999, None)], "vec_id long, embedding array<double>")
    for parts, batch in ((1, 4096), (7, 40)):
        assert sorted(r[0] for r in vectors.leaders(df.repartition(parts), 0.8, batch=batch).collect()) == held
    near = vectors.leader_clusters(df, 0.8).collect()
    assert len(near) == 300 and all(r["distance"] < 0.8 for r in near)
    assert vectors.leaders(df.limit(0), 0.8).collect() == []


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(80, 2)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(i, j, k + 1) for i in range(80) for k, j in enumerate(sorted((j for j in range(80) if j != i), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:4])}
    for size in (64 << 20, 100):
        monkeypatch.setattr(vectors, "PROTO_BYTES", size)
        monkeypatch.setattr(vectors, "CHUNK_BYTES", 2000)
        assert {(r[0], r[1], r[3]) for r in vectors.knn(df, df, 4).collect()} == want


def test_rank_of_the_whole_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    got = sorting.ranked(spark.createDataFrame(rows, "id long, v int").repartition(6), "v", "id").collect()
    assert [(r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_large_and_small_models_give_the_same_beams(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(k, i, i + rng.randint(1, 2), rng.random(), rng.choice("abcd")) for k in range(20) for i in range(5) for _ in range(2)]
    df = spark.createDataFrame(edges, "lattice_id long, start long, stop long, cost double, cls string")
    model = spark.createDataFrame([(p + q, c, rng.random()) for p in "_abcde" for q in "_abcde" for c in "abcde"], "prefix string, ch string, neglogp double")
    small = sorted(map(tuple, lattice.beam_search(df, model).collect()))
    monkeypatch.setattr(lattice, "MODEL_ROWS", 0)
    assert sorted(map(tuple, lattice.beam_search(df, model).collect())) == small and small


def test_cheapest_path_with_ties():
    edges = [(0, 1, 1.0, "b"), (0, 1, 1.0, "a"), (1, 2, 1.0, "z"), (0, 2, 2.0, "ab"), (1, 2, 1.0, "c")]
    assert lattice.best_path(edges, 0, 2) == (2.0, "ab") and lattice.best_path(edges, 2, 0) is None


def test_forward_lattices_need_no_heap_and_bridged_paths_one_shuffle(spark, monkeypatch):
    rng = random.Random(12)
    cases = [[(a := rng.randrange(6), a + rng.randint(1, 3), rng.randint(1, 9) / 10, rng.choice(("a", "b", "", "ab"))) for _ in range(rng.randint(1, 12))] for _ in range(500)]
    ends = [(min(e[0] for e in g), max(e[1] for e in g)) for g in cases]
    want = [lattice._dijkstra(g, *x) for g, x in zip(cases, ends, strict=True)]
    assert None in want and lattice.best_path([(0, 1, 1.0, "a"), (1, 0, 1.0, "b"), (1, 2, 1.0, "c")], 0, 2) == (2.0, "ac")
    monkeypatch.setattr(lattice.heapq, "heappop", None)
    assert [lattice.best_path(g, *x) for g, x in zip(cases, ends, strict=True)] == want and lattice.best_path(cases[0], 9, 9) == (0.0, "")
    df = spark.createDataFrame([(k, *e) for k, g in enumerate(cases[:40]) for e in g], "lattice_id long, start long, stop long, cost double, cls string")
    out = lattice.shortest_paths(df, bridge=10.0)
    assert {tuple(r) for r in out.collect()} == {(k, *lattice.best_path(lattice.bridged(g), *x)) for k, (g, x) in enumerate(zip(cases[:40], ends[:40], strict=True))}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_files_are_written_below_the_folder_only(spark, tmp_path):
    rows = [("a/b.png", b"12"), ("../x", b"no"), ("/etc/x", b"no"), ("c.png", None)]
    got = files.write_files(spark.createDataFrame(rows, "name string, content binary"), f"file://{tmp_path}").collect()
    assert [r["bytes"] for r in got] == [2] and (tmp_path / "a/b.png").read_bytes() == b"12" and not (tmp_path.parent / "x").exists()


def test_corrections_read_what_was_written(spark):
    rows = [(1, "0001.0000000001", b"\x89PNG", 'a < b & "c"'), (1, "0001.0000000002", None, None), (2, "0002.0000000001", b"x", "é\U0001f600")]
    pages = files.correction_html(spark.createDataFrame(rows, "page_id long, name string, image binary, text string"), ["page_id"])
    got = sorted((r["page_id"], r["name"], None if r["image"] is None else bytes(r["image"]), r["text"]) for r in files.corrections(pages).collect())
    assert got == [(1, "0001.0000000001", b"\x89PNG", 'a < b & "c"'), (1, "0001.0000000002", None, ""), (2, "0002.0000000001", b"x", "é\U0001f600")]


def test_xheight_falls_back_on_line_heights(spark):
    h = spark.createDataFrame([(float(v),) for v in (10, 20, 30)], "v double")
    assert layout.median_xheight(h, h).first()[0] == 10.0 and layout.median_xheight(h, h, least=3).first()[0] == 20.0


def test_log_of_what_was_appended(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    log = records.logged(df, str(tmp_path / "t"), "first")
    log = records.logged(df, str(tmp_path / "t"), "second", log)
    assert [(r["place"], r["note"], r["rows"]) for r in log.orderBy("place").collect()] == [(0, "first", 2), (1, "second", 2)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_tables_that_the_session_knows(spark):
    records.attach(spark, {"gt": "/root/testdata/sf0.001"}, ["nation", "region"])
    known = {r["name"]: r["columns"] for r in records.tables(spark).collect()}
    assert known["gt_nation"] == ["n_nationkey", "n_name", "n_regionkey"] and "gt_region" in known


def test_maps_scaling_and_networks_learn(spark):
    rng = np.random.default_rng(7)
    centre = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    y = rng.integers(0, 3, 240)
    x = centre[y] + rng.normal(0, 0.4, (240, 2))
    som = vectors.SelfOrganisingMap(3, 3, 2)
    som.train(x, 1500)
    where = som.find(x)
    assert sum(len(set(where[y == a]) & set(where[y == b])) for a in range(3) for b in range(a)) == 0
    d = np.sqrt(((x[:40, None] - x[None, :40]) ** 2).sum(-1))
    p = vectors.classical_scaling(d)
    assert np.abs(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) - d).max() < 1e-6
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "embedding array<double>, label int").repartition(3)
    net = vectors.Perceptron(2, 6, 3)
    for _ in range(25):
        assert net.train_step(df, "label") == 240
    assert (net.predict(x).argmax(1) == y).mean() > 0.95
