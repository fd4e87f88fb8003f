"""Images, page segmentation and line recognition against plain versions and planted pages."""

from __future__ import annotations

import numpy as np
import pytest

from lineloom.operators import imaging, segmentation, sequence
from lineloom.sources import files


def plain_label(a):
    out, n = np.zeros(a.shape, int), 0
    for y, x in np.ndindex(a.shape):
        if a[y, x] and not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                i, j = todo.pop()
                for u, v in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if 0 <= u < a.shape[0] and 0 <= v < a.shape[1] and a[u, v] and not out[u, v]:
                        out[u, v] = n
                        todo.append((u, v))
    return out


def test_label_and_spread_against_plain():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a = (rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.random()).astype(int)
        assert (imaging.label(a) == plain_label(a)).all()
        lab, most = np.where(rng.random((9, 11)) < 0.15, rng.integers(1, 5, (9, 11)), 0), rng.choice([2, 3.5, np.inf])
        seeds, out = np.argwhere(lab).tolist(), imaging.spread(lab, most)
        for y, x in np.ndindex(lab.shape):
            near = min((((y - a) ** 2 + (x - b) ** 2, lab[a, b]) for a, b in seeds), default=(np.inf, 0))
            assert out[y, x] == (lab[y, x] or (near[1] if near[0] < most**2 else 0))


def test_box_filters_against_windows():
    a = np.random.default_rng(1).random((20, 23))
    for s in (2, 3, 4, 5, 7):
        w = np.lib.stride_tricks.sliding_window_view(np.pad(a, [(s // 2, s - 1 - s // 2)] * 2, "symmetric"), (s, s))
        assert (imaging.box(a, (s, s)) == w.max((-1, -2))).all() and (imaging.box(a, (s, s), np.min) == w.min((-1, -2))).all()
        assert np.allclose(imaging.box(a, (s, s), np.mean), w.mean((-1, -2)))
        assert np.allclose(imaging.percentile_box(a, 80, (s, s), 100), np.sort(w.reshape(20, 23, -1), -1)[..., int(0.8 * s * s)])
    ramp = np.arange(60.0)[:, None] * np.ones((1, 5))
    assert np.allclose(imaging.gaussian(ramp, (2, 0), (1, 0))[20:40], 1, atol=1e-2)


def planted(rng, columns, lines):
    a, boxes = np.zeros((lines * 30 + 80, columns * 420 + 60), int), []
    for c in range(columns):
        for k in range(lines):
            x, y = 40 + c * 420, 40 + k * 30
            x0 = x
            for _ in range(rng.integers(18, 25)):
                a[y : y + 14, x : x + 11] = 1
                last = x + 11
                x += 11 + int(rng.integers(2, 5)) + 8 * (rng.random() < 0.1)
            boxes.append((y, x0, y + 14, last))
    return a, boxes


@pytest.mark.parametrize("columns,lines", [(1, 3), (2, 3), (1, 9), (2, 8)])
def test_planted_pages(columns, lines):
    rng = np.random.default_rng(columns * 10 + lines)
    for _ in range(3):
        a, want = planted(rng, columns, lines)
        lab, b = segmentation.segment_page(a)
        assert [tuple(x) for x in b[:, 1:].tolist()] == want and b[:, 0].tolist() == [0x010000 + k for k in range(1, len(want) + 1)]
        assert ((lab > 0) == (a > 0)).all()


def test_rules_masks_and_guards():
    a, want = planted(np.random.default_rng(3), 1, 3)
    ruled = a.copy()
    ruled[20:22, 10:470] = 1  # a horizontal rule is not a line
    assert [tuple(x) for x in segmentation.segment_page(ruled)[1][:, 1:].tolist()] == want
    mask = np.zeros(a.shape)
    mask[60:100] = 1
    assert [tuple(x) for x in segmentation.segment_page(a, mask=mask)[1][:, 1:].tolist()] == [want[0], want[2]]
    for bad in (np.zeros((50, 50)), a[::3, ::3]):
        with pytest.raises(ValueError, match="scale"):
            segmentation.segment_page(bad)
    with pytest.raises(ValueError, match="too many"):
        segmentation.segment_page(a, set_=segmentation.Settings(most_lines=2))
    two, boxes = planted(np.random.default_rng(4), 2, 12)
    two[:, 430:434] = 1  # a black rule between the columns
    found = segmentation.segment_page(two, set_=segmentation.Settings(black_columns=1))[1]
    assert len(found) == len(boxes)


def test_pages_that_fail_have_an_error(spark):
    good = files.encode_png(1.0 - planted(np.random.default_rng(5), 1, 3)[0])
    rows = [(1, good), (2, b"no image"), (3, None), (4, files.encode_png(np.ones((700, 700))))]
    got = {r["page_id"]: r for r in segmentation.segment_pages(spark.createDataFrame(rows, "page_id long, content binary")).collect()}
    assert len(got[1]["lines"]) == 3 and got[1]["error"] is None and all(got[k]["error"] and got[k]["lines"] is None for k in (2, 3, 4))


def test_page_is_turned_upright_and_scaled():
    a, _ = planted(np.random.default_rng(6), 1, 12)
    gray = 0.9 - 0.7 * imaging.rotated(a.astype(float), 1.0, 0.0) - 0.1 * np.linspace(0, 1, a.shape[1])[None]
    page = imaging.normalize_page(gray)
    assert page.flattened and abs(abs(page.angle) - 1.0) <= 0.25
    assert imaging.rotated(a.astype(float), 1.0, 0.0).mean(1).var() < (1 - page.binary).mean(1).var()
    white = imaging.normalize_page(np.full((30, 30), 0.3))
    assert white.binary.all() and white.angle == 0


def test_degradation_is_seeded():
    a = np.ones((40, 90))
    a[10:30, 10:80:7] = 0
    for f in (imaging.jittered, imaging.distorted, imaging.degraded):
        assert (f(a, 3) == f(a, 3)).all() and f(a, 3).shape == a.shape and (f(a, 3) != f(a, 4)).any()
    assert (imaging.cut_box(a, -2, 85, 3, 95, 1, 0.5) == 0.5).any() and imaging.cut_box(a, 0, 0, 5, 5).shape == (5, 5)


def test_cut_paths_run_between_characters():
    a = np.zeros((20, 40))
    a[3:17, 2:10] = a[3:17, 14:22] = a[3:17, 28:36] = 1
    paths = imaging.cut_paths(a)
    assert paths and all(a[np.arange(20), p].sum() == 0 and (np.abs(np.diff(p)) <= 1).all() for p in paths)
    assert any(10 <= p[10] < 14 for p in paths) and any(22 <= p[10] < 28 for p in paths)


# Sequences


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    m = sequence.Recogniser(4, 5, 3, seed=2)
    for w in m.weights():
        w[...] = rng.normal(0, 0.4, w.shape)
    xs, d = rng.normal(size=(9, 4)), rng.normal(size=(9, 3))
    f = m.features(xs)
    down = d @ m.top[:, 1:]
    for w, g in zip(m.weights(), [d.T @ f, *m.forth.backward(down[:, :5]), *m.back.backward(np.flip(down[:, 5:], 0))], strict=True):
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in w.shape)
            old, ends = w[i], []
            for e in (1e-5, -1e-5):
                w[i] = old + e
                ends.append((d * (m.features(xs) @ m.top.T)).sum())
            w[i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[i]) < 1e-7


def plain_alignment(outputs, targets, lo=1e-5):
    """The same posteriors step by step, without arrays."""
    p = np.maximum(outputs, lo)
    p = p / p.sum(1, keepdims=True)
    n, k = len(p), len(targets)
    match = [[np.log(sum(p[t, c] * targets[s, c] for c in range(p.shape[1]))) for s in range(k)] for t in range(n)]

    def add(x, y):
        return max(x, y) + (0 if abs(x - y) > 10 else np.log(1 + np.exp(-abs(x - y))))

    def walk(m):
        v, rows = [-5.0 * s for s in range(k)], []
        for t in range(n):
            v = [add(v[s] + m[t][s], (v[s - 1] if s else -5.0 * t) + m[t][s]) for s in range(k)]
            rows.append(v)
        return np.array(rows)

    both = walk(match) + walk([r[::-1] for r in match[::-1]])[::-1, ::-1]
    state = np.exp(both - both.max())
    state = state / np.where(state.sum(0) == 0, 1e-9, state.sum(0))
    out = np.maximum(lo, state @ targets)
    return out / out.sum(1, keepdims=True)


def test_alignment_against_plain_version():
    rng = np.random.default_rng(2)
    for n in (5, 30, 60):
        out = rng.random((n, 4))
        targets = np.eye(4)[[0, 2, 0, 1, 0, 3, 0][: min(7, n)]]
        assert np.abs(sequence.align_posteriors(out / out.sum(1, keepdims=True), targets) - plain_alignment(out / out.sum(1, keepdims=True), targets)).max() < 1e-9


def strip(text):
    a = np.ones((4, 4 * len(text) + 2))
    for i, c in enumerate(text):
        a[int(c), 4 * i + 2 : 4 * i + 4] = 0
    return a


def test_training_saving_and_reading_lines(spark, tmp_path):
    rng, m = np.random.default_rng(0), sequence.Recogniser(4, 8, 5, seed=1)
    errors = []
    for _ in range(500):
        text = "".join(map(str, rng.integers(0, 4, rng.integers(1, 5))))
        errors.append(m.train(sequence.prepare_line(strip(text), 4), [int(c) + 1 for c in text], 3e-2))
    assert np.mean(errors[-50:]) < 0.2 * np.mean(errors[:50])
    m.save(str(tmp_path / "m.npz"), ["", *"0123"])
    again, codec = sequence.Recogniser.load(str(tmp_path / "m.npz"))
    texts = ["".join(map(str, rng.integers(0, 4, 3))) for _ in range(20)]
    rows = [(k, strip(t).ravel().tolist(), 4) for k, t in enumerate(texts)] + [(90, [1.0] * 40, 4), (91, None, 4)]
    got = {r["line_id"]: r for r in sequence.recognise_lines(spark.createDataFrame(rows, "line_id long, data array<double>, height int"), again, codec, pad=4).collect()}
    assert np.mean([got[k]["text"] == t for k, t in enumerate(texts)]) > 0.9 and got[90]["error"] and got[91]["error"]
    chars = files.character_tables(sequence.recognise_lines(spark.createDataFrame(rows[:3], "line_id long, data array<double>, height int"), again, codec, pad=4)).collect()
    assert all(0 <= c["x"] < 18 and 0 < c["p"] <= 1 for c in chars) and chars


def test_distributed_step_equals_the_mean_of_single_gradients(spark):
    rng = np.random.default_rng(3)
    rows = [([rng.random(3).tolist() for _ in range(6)], [int(x) for x in rng.integers(1, 3, 2)]) for _ in range(12)] + [([[1.0] * 3] * 4, [1]), ([], [1]), (None, [1])]
    a, b = sequence.Recogniser(3, 4, 3), sequence.Recogniser(3, 4, 3)
    error, n = sequence.train_step(spark.createDataFrame(rows, "xs array<array<double>>, codes array<int>").repartition(4), a, 0.1)
    own = [b.gradients(np.array(x), c) for x, c in rows[:12]]
    b.step([sum(g[k] for _, g in own) / 12 for k in range(len(b.weights()))], 0.1)
    assert n == 12 and abs(error - np.mean([e for e, _ in own])) < 1e-12
    assert all(np.allclose(x, y) for x, y in zip(a.weights(), b.weights(), strict=True))
