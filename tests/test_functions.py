"""Unit vectors of the scalar functions and in-task algorithms."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.errors import BadInput
from lineloom.functions import edit, text
from lineloom.operators import imaging, lattice, layout, sequence, vectors
from lineloom.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_edit_distance_and_passages():
    assert edit.xlevenshtein("exccpt", "except", 1) == (1, [("ccp", "cep")])
    assert edit.xlevenshtein("exccpt", "except", 2) == (1, [("xccpt", "xcept")])
    assert edit.xlevenshtein("exccpt", "except", 3) == (1, [("exccpt ", "except ")])
    assert edit.xlevenshtein("", "test", 1) == (4, [])
    assert edit.xlevenshtein("123 111 456", "132 111 444", 1) == (4, [("123_ ", "1_32 "), ("456 ", "444 ")])
    with pytest.raises(ValueError):
        edit.xlevenshtein("a", "")


def test_distance_against_brute_force():
    def slow(a, b):
        return max(len(a), len(b)) if not a or not b else min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(2))
        assert edit.aligned(a, b)[0] == slow(a, b)


def test_normalize_and_project(spark):
    assert one(spark, text.normalize_text(F.lit("  é “x”  _ "))) == "é ''x'' ~"
    assert one(spark, text.project_text(F.lit("Straße 12"), "lnc")) == "STRAE"
    assert one(spark, text.project_text(F.lit("a . . . . . b"), "exact")) == "a....b"
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) is None
    with pytest.raises(BadInput):
        text.project_text(F.lit("a"), "none")


def test_explode_pack(spark):
    assert one(spark, text.gt_explode(F.lit("a_fi_b"))) == ["a", "fi", "b"]
    assert one(spark, text.gt_implode(F.array(*map(F.lit, ("a", "fi", "_"))))) == "a_fi____"
    assert one(spark, text.unpack4(text.pack4(F.lit("aé日")))) == "aé日"


def test_lattice_against_all_paths():
    rng = random.Random(2)
    for _ in range(30):
        edges = [(a, rng.randint(a + 1, 6), float(rng.randint(1, 9)), rng.choice("abc")) for a in range(6) for _ in range(2)]

        def paths(node):
            if node == 6:
                yield 0.0, ""
            for a, b, c, s in edges:
                if a == node:
                    for cost, t in paths(b):
                        yield c + cost, s + t

        assert lattice.best_path(edges, 0, 6) == min(paths(0))
        wide = lattice.beam(edges, {}, 1, 10**6, 0.0, 1.0)
        assert wide[0] == min(paths(0))[0]
    assert lattice.best_path([(0, 1, 1.0, "a")], 0, 2) is None
    assert lattice.align_to_truth([(0, 1, 1.0, "a"), (1, 2, 1.0, "b"), (0, 2, 0.5, "c")], "ab") == [(0, 1, "a"), (1, 2, "b")]


def test_lattice_reader(spark):
    rows = [(1, 0, "segment 0 0:0 1:2:3:4"), (1, 1, "chr 0 0 0.5 a"), (1, 2, "segment 1 1:2 1:2:3:4"), (1, 3, "chr 1 0 1.5 b"), (1, 4, "chr 1 1 2.5")]
    got = lattice.read_lattices(spark.createDataFrame(rows, "lattice_id long, pos long, line string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, 0.5, "a"), (1, 1, 3, 1.5, "b"), (1, 1, 3, 2.5, "")]


def test_labels_and_spread_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(10):
        a = rng.random((9, 7)) > 0.5
        lab, seen, n = imaging.label(a), np.zeros(a.shape, int), 0
        for y, x in itertools.product(range(9), range(7)):
            if a[y, x] and not seen[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    v, u = stack.pop()
                    if 0 <= v < 9 and 0 <= u < 7 and a[v, u] and not seen[v, u]:
                        seen[v, u] = n
                        stack += [(v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)]
        assert (lab == seen).all()
        if n:
            full = imaging.spread(lab)
            assert (full > 0).all() and (full[a] == lab[a]).all()
    assert imaging.boxes(imaging.label(np.eye(2))).tolist() == [[1, 0, 0, 1, 1], [2, 1, 1, 2, 2]]


def test_filters():
    a = np.random.default_rng(4).random((12, 10))
    assert np.allclose(imaging.gaussian(np.ones((5, 5)), 2), 1)
    assert np.isclose(imaging.box(a, (3, 3))[5, 5], a[4:7, 4:7].max())
    assert np.allclose(imaging.zoom(a, a.shape), a)
    assert imaging.skew(np.kron(np.arange(20) % 4 < 2, np.ones((30, 1))).T) == 0
    assert set(np.unique(imaging.binarize(a, window=4))) <= {0, 1}


def test_png_round_trip():
    a = np.random.default_rng(5).integers(0, 256, (7, 5)).astype(np.uint8)
    assert np.allclose(files.decode_png(files.encode_png(a)) * 255, a)
    labels = np.arange(6).reshape(2, 3) * 70000
    assert (files.decode_png(files.encode_png(labels)) == labels).all()


def test_file_sources(spark, tmp_path):
    page = tmp_path / "book" / "0001"
    page.mkdir(parents=True)
    (page / "01000a.gt.txt").write_text("a  b\n")
    (page / "01000a.png").write_bytes(files.encode_png(np.zeros((2, 3), np.uint8)))
    row = files.transcripts(spark, str(page / "*.gt.txt")).first()
    assert (row["book"], row["page_no"], row["line_id"], row["kind"], row["text"]) == ("book", 1, 0x01000A, "gt.txt", "a b")
    image = files.images(spark, str(page / "*.png")).first()
    assert (image["height"], image["width"], image["error"]) == (2, 3, None)
    lines = spark.createDataFrame([("a 1 2 3 4 0",), ("bad",)], "value string")
    assert [tuple(r) for r in files.box_file(lines).collect()] == [("a", 1, 2, 3, 4, 0)]
    cells = files.html_cells(spark.createDataFrame([(1, "<table><tr><td>x</td></tr><tr><td><b>y</b></td></tr></table>")], "page_id long, html string"))
    assert [r["text"] for r in cells.orderBy("row_no").collect()] == ["x", "y"]
    assert bytes(one(spark, files.data_uri(F.lit("data:text/plain;base64,aGk=")))) == b"hi"


def test_decoding_and_alignment(spark):
    p = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.9, 0.05, 0.05], [0.2, 0.1, 0.7]])
    assert sequence.decode_array(p) == [1, 2]
    rows = [(1, t, k, float(p[t, k])) for t in range(5) for k in range(3)]
    got = sequence.greedy_decode(spark.createDataFrame(rows, "seq_id long, t long, k long, p double"))
    assert sorted((r["t"], r["k"]) for r in got.collect()) == [(1, 1), (4, 2)]
    post = sequence.align_posteriors(p, np.eye(3)[[0, 1, 0, 2, 0]])
    assert np.allclose(post.sum(1), 1) and post.shape == p.shape


def test_training_reduces_error():
    model = sequence.Recogniser(3, 6, 3)
    xs = np.kron(np.eye(3)[[0, 1, 0, 2, 0]], np.ones((3, 1)))
    errors = [model.train(xs, [1, 2], 2.0) for _ in range(200)]
    assert errors[-1] < errors[0]


def test_topological_order():
    assert layout.topological_order([1, 2, 3], {1: [3], 3: [2]}) == [2, 3, 1]
    assert sorted(layout.topological_order([1, 2], {1: [2], 2: [1]})) == [1, 2]


def test_knn_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    a = sorted(map(tuple, vectors.knn(df, df, 3).collect()))
    monkeypatch.setattr(vectors, "PROTO_BYTES", 500)
    monkeypatch.setattr(vectors, "BLOCKS", 3)
    assert sorted(map(tuple, vectors.knn(df, df, 3).collect())) == a
    leaders = vectors.leader_clusters(df, 0.3).collect()
    assert len(leaders) == 60 and all(r["distance"] <= 0.6 for r in leaders)
    assert vectors.knn(df.limit(0), df, 3).count() == 0


def test_streaming(spark, tmp_path):
    from lineloom.streaming import incremental

    spark.createDataFrame([("a", "abc", "abd"), ("a", "x", "x"), ("b", "", "zz")], "g string, pred string, gt string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, pred string, gt string").parquet(str(tmp_path / "in"))
    q = incremental.running_error_rates(stream, "g").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["g"]: (r["err"], r["total"]) for r in spark.table("rates").collect()} == {"a": (1, 4), "b": (2, 2)}
