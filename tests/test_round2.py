"""What the second round's findings were about, on small tables."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.functions import text
from lineloom.operators import evaluation, grouping, imaging, lattice, ngrams, records, segmentation, sequence, vectors
from lineloom.operators.nearest import Trie, rounded
from lineloom.plans import catalog


def _page(lines: int = 5) -> np.ndarray:
    a = np.zeros((80 + 30 * lines, 480), int)
    for j in range(lines):
        for i in range(20):
            y, x = 40 + 30 * j, 40 + 14 * i + 8 * (i // 5)
            a[y : y + 14, x : x + 11] = 1
    return a


def test_labels_are_spread_only_about_ink_that_has_none(monkeypatch):
    sizes, spread = [], imaging.spread
    monkeypatch.setattr(segmentation, "spread", lambda lab, most: sizes.append(lab.size) or spread(lab, most))
    a = _page()
    a[47:49, 344:346] = 1  # too small to be a character, near the first line
    lab = segmentation.line_labels(a)
    assert len(segmentation.segment_page(a)[1]) == 5
    assert sizes and max(sizes) < a.size / 4
    whole = spread(np.where(a == 1, lab, 0), segmentation.scale_of(a))
    assert (lab[a == 1] == whole[a == 1]).all()


def test_gaussian_equals_sums_over_mirrored_neighbours():
    rng = np.random.default_rng(0)
    for shape, s in (((7, 90), 3.0), ((60, 5), 12.4), ((40, 41), 1.0)):
        a, r = rng.random(shape), int(4 * s + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        k /= k.sum()
        want = a
        for axis in (0, 1):
            n = shape[axis]
            at = np.arange(-r, n + r) % (2 * n)
            x = np.moveaxis(np.take(want, np.where(at < n, at, 2 * n - 1 - at), axis), axis, 0)
            want = np.moveaxis(np.stack([np.tensordot(k, x[j : j + 2 * r + 1], 1) for j in range(n)]), 0, axis)
        assert np.allclose(imaging.gaussian(a, s), want, atol=1e-12)


def test_boxes_and_labels_of_touching_runs():
    lab = np.array([[1, 1, 2, 0, 3], [3, 0, 2, 2, 0], [0, 0, 0, 0, 7]])
    assert imaging.boxes(lab).tolist() == [[1, 0, 0, 1, 2], [2, 0, 2, 2, 4], [3, 0, 0, 2, 5], [7, 2, 4, 3, 5]]
    assert imaging.label(np.ones((3, 4))).tolist() == [[1] * 4] * 3 and imaging.boxes(np.zeros((2, 2), int)).shape == (0, 5)


def test_packed_classes_of_all_characters_and_of_an_empty_text(spark, tmp_path):
    every = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x10000), 0x1F600]]
    rows = [(1, "", "en"), (2, "".join(every), "en"), (3, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["class_pack"]).fetchall()
    got = [(r["ch"], r["packed"]) for r in catalog.QUERIES["class_pack"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ("", -1) in got and len(got) == len(every) + 1


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for k, y in enumerate(b, 1):
            row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (x != y)))
    return row[-1]


def test_nearest_texts_against_all_pairs():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abü") for _ in range(rng.randrange(n)))
    for _ in range(100):
        texts = list({word(7) for _ in range(rng.randrange(1, 30))})
        ids = rng.sample(range(1000), len(texts))
        trie = Trie(texts, ids)
        for a in (word(8) for _ in range(4)):
            assert trie.nearest(a) == min((rounded(_distance(a, b), max(len(a), len(b), 1)), i) for b, i in zip(texts, ids, strict=True))


@pytest.mark.parametrize("cell", [(1000, 4_000_000), (3, 20)])
def test_matched_truth_makes_no_pairs_of_equal_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(records, "CELL_LINES", cell[0])
    monkeypatch.setattr(records, "CELL_CHARS", cell[1])
    lines = [(k % 2, k, f"line {k % 9}") for k in range(60)] + [(1, 90, None), (None, 91, "line 1"), (7, 92, "no truth"), (8, 93, "x")]
    truths = [(k % 2, 100 + k, f"lime {k % 7}") for k in range(40)] + [(1, 5, None), (8, 6, None), (8, 7, None)]
    out = records.matched_truth(spark.createDataFrame(lines, "page int, line_id long, text string"), spark.createDataFrame(truths, "page int, truth_id long, text string"), "page")
    want = set()
    for page, line, a in lines:
        own = [(rounded(_distance(a, b), max(len(a), len(b), 1)) if a is not None and b is not None else float("inf"), i) for p, i, b in truths if p == page]
        if own:
            cost, i = min(own)
            want.add((page, line, i, None if cost == float("inf") else cost))
    assert {tuple(r) for r in out.collect()} == want and "levenshtein" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_one_length_are_read_together_as_one_by_one(spark, monkeypatch):
    rng, m = np.random.default_rng(1), sequence.Recogniser(4, 6, 5, seed=3)
    for w in m.weights():
        w[...] = rng.normal(0, 1.5, w.shape)
    lines = [rng.random((4, int(rng.integers(3, 9)))) for _ in range(60)]
    xs = [sequence.prepare_line(a, 2) for a in lines]
    assert np.allclose(m.predict_many(np.stack([xs[0], xs[0][::-1]])), [m.predict(xs[0]), m.predict(xs[0][::-1])], atol=1e-12)
    want = {k: [("_abcd"[c], p) for _, c, p in sequence.decode_runs(m.predict(x))] for k, x in enumerate(xs)}
    rows = [(k, a.ravel().tolist(), 4) for k, a in enumerate(lines)] + [(90, [0.1, 0.2] * 10, 5), (91, None, 4), (92, [1.0] * 40, 4)]
    df = spark.createDataFrame(rows, "line_id long, data array<double>, height int")
    for size in (1 << 20, 300):
        monkeypatch.setattr(sequence, "BATCH_VALUES", size)
        got = {r["line_id"]: r for r in sequence.recognise_lines(df, m, list("_abcd"), pad=2).collect()}
        assert len(got) == 63 and all(got[k]["error"] and got[k]["chars"] is None for k in (90, 91, 92))
        for k, chars in want.items():
            assert [c["ch"] for c in got[k]["chars"]] == [c for c, _ in chars] and np.allclose([c["p"] for c in got[k]["chars"]], [p for _, p in chars])


def test_new_leaders_meet_the_rest_in_pieces_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, held = rng.normal(size=(500, 3)), rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - held[None]) ** 2).sum(-1)).min(1)
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 1000)
    for eps in (0.3, float(d[7]), 2.0):
        assert (vectors._closer(x, held, eps) == (((x[:, None] - held[None]) ** 2).sum(-1).min(1) < eps * eps)).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(r[0] for r in vectors.leaders(df, 0.5).collect())
    assert sorted(r[0] for r in vectors.leaders(df.repartition(5), 0.5, batch=30).collect()) == one


def test_search_has_every_fiftieth_vector_as_query_and_all_as_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        best = sorted((v, k) for v, k in zip(d, ids.tolist(), strict=True) if k != ids[i])[:5]
        want |= {(int(ids[i]), k, n + 1) for n, (_, k) in enumerate(best)}
    assert {(r["vec_id"], r["neighbour"], r["rank"]) for r in catalog.QUERIES["knn_join"](spark, "/root/testdata/sf0.001").collect()} == want


def test_projections_of_all_signs_equal_the_sql_and_take_one_pass(spark, tmp_path):
    rng = random.Random(8)
    every = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x3000 * 16), 0x1F600]]
    signs = "ab1 .~_#\"'`“”´‘’„…′″‴〃µμ–—ﬂﬁﬀﬃﬄıſßéÉéK\x1c\x1f\x85\xa0 　\t\n\x0b"
    texts = ["", " ", None, "." * 50_000, ". " * 9, "a . . . . b ... c .. .. d", *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)), *("x ".join(every[i : i + 500]) for i in range(0, len(every), 500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("text_project", "text_normalize"):
        df, sql = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLES[name])
        assert df.columns == [c[0] for c in sql.description] and sorted(map(tuple, df.collect())) == sorted(sql.fetchall())
        assert "regexp_replace" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and plan.count("ArrowEvalPython") == 1


def _lattice_rows(seed: int, lattices: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    return [(None if k == 5 else k, a := rng.randrange(6), a + rng.randint(1, 2), rng.randint(10, 90) / 10, rng.choice("ab")) for k in range(lattices) for _ in range(rng.randint(1, 7))]


LATTICE = "lattice_id long, start long, stop long, cost double, cls string"


def test_groups_go_on_across_batches(spark):
    rows = [(k, v, None if v % 5 == 0 else f"w{v % 3}") for k in (None, 0, -1, 7, 9) for v in range(40 if k == 7 else 3)]
    df = spark.createDataFrame(rows, "k long, v long, s string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 4, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = grouping.per_group(df, "k", ["v", "s"], lambda g: [(len(g), float(sum(v for v, _ in g)), "".join(sorted(s or "-" for _, s in g)))], "n long, t double, s string").collect()
            assert {r[0]: tuple(r)[1:] for r in got} == {k: (len(o), float(sum(v for v, _ in o)), "".join(sorted(s or "-" for _, s in o))) for k in (None, 0, -1, 7, 9) if (o := [r[1:] for r in rows if r[0] == k])}
            assert len(got) == 5 and sum(r["n"] for r in got) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tasks_grow_in_number_with_the_files(spark, monkeypatch):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    monkeypatch.setattr(grouping, "TASK_BYTES", 1000)
    assert grouping.by_key(li, "l_orderkey").rdd.getNumPartitions() > 50
    assert grouping._tasks(spark.createDataFrame([(1,)], "k long")) == 0


def test_beams_shuffle_the_edges_once_and_make_the_model_once(spark):
    edges, made = spark.createDataFrame(_lattice_rows(3), LATTICE), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    grams = [(p + q, c, (ord(p) * 7 + ord(q) * 3 + ord(c)) % 11 / 7) for p in "_ab" for q in "_ab" for c in "ab"]
    model = spark.createDataFrame(grams, "prefix string, ch string, neglogp double").coalesce(1)
    out = lattice.beam_search(edges, model.mapInArrow(counted, model.schema), 3, 20, bridge=10.0)
    got = sorted(map(tuple, out.collect()), key=str)
    assert made.value == len(grams)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    table = {p: {c: x for q, c, x in grams if q == p} for p, _, _ in grams}
    want = []
    for k in {r[0] for r in _lattice_rows(3)}:
        own = [r[1:] for r in _lattice_rows(3) if r[0] == k]
        own += [(n, n + 1, 10.0, "") for n in range(min(e[0] for e in own), max(e[1] for e in own)) if not any(e[:2] == (n, n + 1) for e in own)]
        want.append((k, *lattice.beam(own, table, 3, 20, 15.0, 1.0)))
    assert got == sorted(want, key=str)


def test_counts_of_batches_with_few_and_many_characters(spark):
    rng = random.Random(4)
    every = [chr(c) for c in [*range(1, 0x300), *range(0x2000, 0x2100), 0x1F600, 0xE000]]
    lines = ["", "ab", None, *("".join(rng.choices("ab c", k=rng.randrange(30))) for _ in range(300)), *("".join(rng.choices(every, k=80)) for _ in range(60))]
    for part in (lines[:200], lines):
        df = spark.createDataFrame([(x,) for x in part], "line string").coalesce(1)
        for digits in (False, True):
            assert [text.folded(r[0], digits) for r in df.where("line is not null").collect()] == [r[0] for r in df.where("line is not null").select(text.fold_for_model(F.col("line"), digits)).collect()]
            want = Counter()
            for x in part:
                if x is not None and len(x) >= 3:
                    s = "__" + text.folded(x, digits) + "__"
                    want.update((s[i : i + 2], s[i + 2]) for i in range(len(s) - 3))
            assert {(r["prefix"], r["ch"]): r["n"] for r in ngrams.counts(df, 3, digits=digits).collect()} == want


def test_round_trip_moves_and_sorts_the_edges_only(spark):
    rows = _lattice_rows(7) + [(90, 2, 3, None, "a"), (90, 2, 3, 1e-7, "b"), (90, 6, 7, 1e22, ""), (90, 2, 3, 0.1 + 0.2, "a")]
    edges = spark.createDataFrame(rows, LATTICE).repartition(3)
    out = lattice.round_trip(edges, bridge=10.0)
    bridged = lattice.connected(edges)
    want = Counter(map(tuple, bridged.collect()))
    assert Counter(map(tuple, out.collect())) == want and Counter(map(tuple, lattice.read_lattices(lattice.lattice_lines(bridged).repartition(5)).collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Window" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    lines = [r["line"] for r in lattice.lattice_lines(edges.where("lattice_id = 90")).orderBy("pos").collect()]
    assert lines == ["segment 0 2:2 0:0:0:0", "chr 0 0 null a", "chr 0 1 1e-07 b", "chr 0 2 0.30000000000000004 a", "segment 1 6:6 0:0:0:0", "chr 1 0 1e+22 "]


@pytest.mark.parametrize("frequent, most", [(1, 1000), (4, 1000), (1000, 1000), (4, 0)])
def test_most_frequent_pairs_are_exact_whether_certified_or_counted_in_full(spark, monkeypatch, frequent, most):
    rng = random.Random(9)
    word = lambda: f"w{min(rng.randrange(1, 40), rng.randrange(1, 40), rng.randrange(1, 40))}"
    rows = [(rng.choice(["a", "b", None]), word(), word()) for _ in range(4000)] + [("flat", f"x{i}", f"y{i}") for i in range(30)] + [("rare", "x", "y")]
    monkeypatch.setattr(evaluation, "FREQUENT", frequent)
    monkeypatch.setattr(evaluation, "MOST_GROUPS", most)
    counts, counted, merge = Counter(rows), [], evaluation.merge_counts
    monkeypatch.setattr(evaluation, "merge_counts", lambda df, *by: counted.append(by) or merge(df, *by))
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted(((*r, n) for r, n in counts.items() if r[0] == g), key=lambda r: (-r[3], r[1], r[2]))[:5]
        want |= {(*r, i + 1) for i, r in enumerate(best)}
    got = evaluation.top_pairs_per(spark.createDataFrame(rows, "lang string, gt string, pred string"), "lang", "gt", "pred", 5)
    assert got.columns == ["lang", "gt", "pred", "n", "rank"] and {tuple(r) for r in got.collect()} == want
    assert len(counted) == (2 if frequent == 1000 or most == 0 else 3)
    none = spark.createDataFrame([], "lang string, gt string, pred string")
    assert evaluation.top_pairs_per(none, "lang", "gt", "pred", 5).collect() == []


def test_words_are_looked_for_once(spark, tmp_path):
    texts = [None, "", "one", "one two", "é ß1ß x_y", "12 34"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["top_word_confusions_per_lang"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {tuple(r) for r in df.collect()} == set(con.execute(catalog.ORACLES["top_word_confusions_per_lang"]).fetchall())
    from lineloom.plans.evaluation import _word_pairs

    assert _word_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
