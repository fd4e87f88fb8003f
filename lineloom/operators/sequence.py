"""Character sequences: codec, decoding of class probabilities, alignment of a text with them, a recurrent recogniser."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that lines of one length have together while they are decoded.
BATCH_VALUES = 1 << 20


def codec(chars: DataFrame, column: str = "ch") -> DataFrame:
    """(ch, code) of the distinct characters with blank "", reject "~" and the space; 0 is the blank."""
    spark = chars.sparkSession
    every = chars.select(F.col(column).alias("ch")).union(spark.createDataFrame([("",), ("~",), (" ",)], "ch string")).distinct()
    return every.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("long").alias("code"))


def encode(col: Column, codes: dict[str, int]) -> Column:
    """Codes of a text's characters; what the codec lacks gets the code of "~"."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(codes["~"])))


def ctc_targets(col: Column) -> Column:
    """Codes with a blank before each and one at the end."""
    return F.concat(F.flatten(F.transform(col, lambda c: F.array(F.lit(0).cast("long"), c.cast("long")))), F.array(F.lit(0).cast("long")))


def greedy_decode(frames: DataFrame, seq: str = "seq_id", threshold: float = 0.7) -> DataFrame:
    """(seq, run, t, k, p): in each run of frames whose blank is below the threshold, the frame and class of greatest p.

    frames: (seq, t, k, p), class 0 the blank. Of equal p the earlier frame wins, then the lesser class.
    """
    blank = F.max(F.when(F.col("k") == 0, F.col("p"))).over(Window.partitionBy(seq, "t"))
    f = frames.withColumn("on", blank < threshold)
    starts = f.select(seq, "t", "on").distinct().withColumn("new", F.col("on") & ~F.coalesce(F.lag("on").over(Window.partitionBy(seq).orderBy("t")), F.lit(False)))
    runs = starts.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy(seq).orderBy("t"))).where("on").select(seq, "t", "run")
    best = f.where("on and k <> 0").join(runs, [seq, "t"]).groupBy(seq, "run").agg(F.max(F.struct("p", (-F.col("t")).alias("t"), (-F.col("k")).alias("k"))).alias("m"))
    return best.select(seq, "run", (-F.col("m.t")).alias("t"), (-F.col("m.k")).alias("k"), F.col("m.p").alias("p"))


def change_decode(frames: DataFrame, seq: str = "seq_id") -> DataFrame:
    """(seq, t, k): the best class of each frame where it changes to something other than the blank; not at the first frame."""
    best = frames.groupBy(seq, "t").agg(F.max(F.struct("p", (-F.col("k")).alias("k"))).alias("m")).select(seq, "t", (-F.col("m.k")).alias("k"))
    before = F.lag("k").over(Window.partitionBy(seq).orderBy("t"))
    return best.withColumn("b", before).where("b is not null and k <> b and k <> 0").select(seq, "t", "k")


def _log_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log(e^x + e^y), taken as the greater one where they are more than 10 apart."""
    most, apart = np.maximum(x, y), np.abs(x - y)
    return most + np.where(apart > 10, 0, np.log1p(np.exp(-apart)))


def _forward(match: np.ndarray, skip: float = -5.0) -> np.ndarray:
    """Log scores of reaching each target by each frame: stay, step on by one, all in log space."""
    out = np.empty_like(match)
    v = skip * np.arange(match.shape[1], dtype=float)
    for t, row in enumerate(match):
        moved = np.concatenate(([skip * t], v[:-1]))
        v = out[t] = _log_add(v, moved) + row
    return out


def align_posteriors(outputs: np.ndarray, targets: np.ndarray, floor: float = 1e-5) -> np.ndarray:
    """(frames, classes): where in time the target sequence (rows of class weights) lies, by forward and backward scores.

    The score of a state at a frame is normalised over time for each state, below the greatest score of all, so a state
    that is never likely gets nothing; then the states' weights are brought back to classes, floor at least.
    """
    share = lambda x, axis: x / np.where((n := x.sum(axis, keepdims=True)) == 0, 1e-9, n)
    match = np.log(share(np.maximum(outputs, floor), 1) @ targets.T)
    both = _forward(match) + np.flip(_forward(np.flip(match)))
    return share(np.maximum(share(np.exp(both - both.max()), 0) @ targets, floor), 1)


def _sig(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -20, 20)))


class Lstm:
    """One direction of an LSTM with peepholes: weights of the gates i, f, o and the input c, peepholes of the gates.

    There is no output peephole in the first frame.
    """

    def __init__(self, inputs: int, states: int, rng: np.random.Generator):
        self.states = states
        self.w = {g: rng.uniform(-0.1, 0.1, (states, 1 + inputs + states)) for g in "ifoc"}
        self.p = {g: rng.uniform(-0.1, 0.1, states) for g in "ifo"}

    def weights(self) -> list[np.ndarray]:
        return [*self.w.values(), *self.p.values()]

    def forward(self, xs: np.ndarray) -> np.ndarray:
        """Outputs by frame; what the backward pass needs is kept until the next call."""
        n, k = len(xs), self.states
        self.z = np.ones((n, self.w["i"].shape[1]))
        self.i, self.f, self.o, self.c, self.s, out = (np.zeros((n, k)) for _ in range(6))
        s = h = np.zeros(k)
        for t, x in enumerate(xs):
            z = self.z[t]
            z[1 : 1 + len(x)], z[1 + len(x) :] = x, h
            self.i[t], self.f[t] = _sig(self.w["i"] @ z + self.p["i"] * s), _sig(self.w["f"] @ z + self.p["f"] * s)
            self.c[t] = np.tanh(self.w["c"] @ z)
            s = self.s[t] = self.f[t] * s + self.i[t] * self.c[t]
            self.o[t] = _sig(self.w["o"] @ z + (self.p["o"] * s if t else 0))
            h = out[t] = self.o[t] * np.tanh(s)
        return out

    def outputs(self, xs: np.ndarray) -> np.ndarray:
        """What forward gives, for many sequences of one length at once (sequence, frame, input); nothing is kept."""
        w, k, d = np.vstack([self.w[g] for g in "ifoc"]), self.states, xs.shape[2]
        if w.shape[1] != 1 + d + k:
            raise ValueError(f"frames of {d} values, not of {w.shape[1] - 1 - k}")
        own, again, out = xs @ w[:, 1 : 1 + d].T + w[:, 0], w[:, 1 + d :].T, np.empty((*xs.shape[:2], k))
        s = h = np.zeros((len(xs), k))
        for t in range(xs.shape[1]):
            z = own[:, t] + h @ again
            s = _sig(z[:, k : 2 * k] + self.p["f"] * s) * s + _sig(z[:, :k] + self.p["i"] * s) * np.tanh(z[:, 3 * k :])
            h = out[:, t] = _sig(z[:, 2 * k : 3 * k] + (self.p["o"] * s if t else 0)) * np.tanh(s)
        return out

    def backward(self, deltas: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, in their order, for what the outputs of the last forward pass should change by."""
        n, k = deltas.shape
        err = {g: np.zeros((n, k)) for g in "ifoc"}
        before = np.vstack([np.zeros((1, k)), self.s[:-1]])
        later, ds = np.zeros(k), np.zeros(k)  # what the next frame asks of this one's output and state
        for t in range(n - 1, -1, -1):
            dh = deltas[t] + later
            th = np.tanh(self.s[t])
            err["o"][t] = dh * th * self.o[t] * (1 - self.o[t])
            ds = ds + dh * self.o[t] * (1 - th * th) + (err["o"][t] * self.p["o"] if t else 0)
            err["f"][t] = ds * before[t] * self.f[t] * (1 - self.f[t])
            err["i"][t] = ds * self.c[t] * self.i[t] * (1 - self.i[t])
            err["c"][t] = ds * self.i[t] * (1 - self.c[t] ** 2)
            later = sum(err[g][t] @ self.w[g] for g in "ifoc")[-k:]
            ds = ds * self.f[t] + err["f"][t] * self.p["f"] + err["i"][t] * self.p["i"]
        peep = {"i": before, "f": before, "o": np.vstack([np.zeros((1, k)), self.s[1:]])}
        return [*(err[g].T @ self.z for g in self.w), *((err[g] * peep[g]).sum(0) for g in self.p)]


class Recogniser:
    """Bidirectional LSTM with a softmax on top, trained as a whole on aligned transcripts, with momentum."""

    def __init__(self, inputs: int, states: int, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.forth, self.back = Lstm(inputs, states, rng), Lstm(inputs, states, rng)
        self.top = rng.uniform(-0.1, 0.1, (classes, 1 + 2 * states))
        self.motion = [np.zeros_like(w) for w in self.weights()]

    def weights(self) -> list[np.ndarray]:
        """All weights; changing them in place changes the model."""
        return [self.top, *self.forth.weights(), *self.back.weights()]

    def features(self, xs: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(xs), 1)), self.forth.forward(xs), np.flip(self.back.forward(np.flip(xs, 0)), 0)])

    def predict(self, xs: np.ndarray) -> np.ndarray:
        z = self.features(xs) @ self.top.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict_many(self, xs: np.ndarray) -> np.ndarray:
        """predict for sequences of one length (sequence, frame, input)."""
        f = np.concatenate([np.ones((*xs.shape[:2], 1)), self.forth.outputs(xs), np.flip(self.back.outputs(np.flip(xs, 1)), 1)], 2)
        z = f @ self.top.T
        z = np.exp(z - z.max(2, keepdims=True))
        return z / z.sum(2, keepdims=True)

    def gradients(self, xs: np.ndarray, codes: list[int]) -> tuple[float, list[np.ndarray]]:
        """(mean absolute difference to the aligned targets of the codes, direction in which the weights improve)."""
        classes, k = len(self.top), self.forth.states
        features = self.features(xs)
        z = features @ self.top.T
        z = np.exp(z - z.max(1, keepdims=True))
        out = z / z.sum(1, keepdims=True)
        targets = np.eye(classes)[[0] + [c for x in codes for c in (x, 0)]]
        delta = align_posteriors(out, targets) - out
        down = delta @ self.top[:, 1:]
        return float(np.abs(delta).mean()), [delta.T @ features, *self.forth.backward(down[:, :k]), *self.back.backward(np.flip(down[:, k:], 0))]

    def step(self, gradients: list[np.ndarray], rate: float = 1e-4, momentum: float = 0.9) -> None:
        for w, m, g in zip(self.weights(), self.motion, gradients, strict=True):
            m *= momentum
            m += rate * g
            w += m

    def train(self, xs: np.ndarray, codes: list[int], rate: float = 1e-4, momentum: float = 0.9) -> float:
        """One step on one sequence; returns the mean absolute difference before it."""
        error, gradients = self.gradients(xs, codes)
        self.step(gradients, rate, momentum)
        return error

    def save(self, path: str, codec: list[str] | None = None) -> None:
        """Weights, momenta and the codec as an npz file; no code is stored."""
        w = self.weights()
        np.savez_compressed(path, shape=np.array([self.forth.w["i"].shape[1] - 1 - self.forth.states, self.forth.states, len(self.top)]), codec=np.array(codec or [], "U"), **{f"w{k}": x for k, x in enumerate(w)}, **{f"m{k}": x for k, x in enumerate(self.motion)})

    @classmethod
    def load(cls, path: str) -> tuple[Recogniser, list[str]]:
        """(model, codec) from a file of save."""
        with np.load(path, allow_pickle=False) as f:
            model = cls(*(int(x) for x in f["shape"]))
            for k, (w, m) in enumerate(zip(model.weights(), model.motion, strict=True)):
                w[...], m[...] = f[f"w{k}"], f[f"m{k}"]
            return model, f["codec"].tolist()


def train_step(lines: DataFrame, model: Recogniser, rate: float = 1e-4, momentum: float = 0.9) -> tuple[float, int]:
    """One step on all lines (xs: array of frames, codes: array of codes) at once; (mean error, lines used).

    Tasks add up the gradients of their lines and each gives one row, of the model's size; the driver adds those. Lines
    without a frame, of one value only or with a code that the model hasn't are left out.
    """
    sent = lines.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        own, total, error, n = sent.value, None, 0.0, 0
        for part in parts:
            for xs, codes in zip(part["xs"], part["codes"], strict=True):
                xs = np.array([list(f) for f in xs], float) if xs is not None and codes is not None else np.zeros((0, 1))
                if not xs.size or xs.min() == xs.max() or not all(0 < c < len(own.top) for c in codes):
                    continue
                e, g = own.gradients(xs, list(codes))
                total, error, n = (g if total is None else [a + b for a, b in zip(total, g, strict=True)]), error + e, n + 1
        if n:
            yield pd.DataFrame({"n": [n], "error": [error], "g": [np.concatenate([x.ravel() for x in total]).tobytes()]})

    rows = lines.select("xs", "codes").mapInPandas(run, "n long, error double, g binary")
    flat, error, n = np.zeros(sum(w.size for w in model.weights())), 0.0, 0
    for r in rows.toLocalIterator():
        flat, error, n = flat + np.frombuffer(r["g"]), error + r["error"], n + r["n"]
    if not n:
        return float("nan"), 0
    cuts = np.cumsum([w.size for w in model.weights()])[:-1]
    model.step([g.reshape(w.shape) / n for g, w in zip(np.split(flat, cuts), model.weights(), strict=True)], rate, momentum)
    return error / n, n


def prepare_line(image: np.ndarray, pad: int = 16) -> np.ndarray:
    """Frames of a line image: scaled to 1 at most, inverted so that ink is high, with pad white columns on either side."""
    top = image.max() if image.size else 0
    line = (top - image) / top if top else np.zeros_like(image, float)
    return np.pad(line, ((0, 0), (pad, pad))).T


def recognise(frames: DataFrame, model: Recogniser, seq: str = "seq_id", threshold: float = 0.7) -> DataFrame:
    """(seq, codes) of sequences (seq, xs: array of frames): the model is broadcast, each sequence decoded in its task."""
    sent = frames.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for part in parts:
            codes = [decode_array(sent.value.predict(np.array([list(f) for f in xs], float)), threshold) if len(xs) else [] for xs in part["xs"]]
            yield pd.DataFrame({seq: part[seq], "codes": codes})

    return frames.select(F.col(seq).cast("long").alias(seq), "xs").mapInPandas(run, f"{seq} long, codes array<long>")


def decode_runs(p: np.ndarray, threshold: float = 0.7) -> list[tuple[int, int, float]]:
    """(frame, class, probability) of the greatest value but the blank's in each run of frames that are not blank."""
    on, best = (p[:, 0] < threshold).tolist(), p[:, 1:].argmax(1) + 1
    value, best, out, before = p[np.arange(len(p)), best].tolist(), best.tolist(), [], False
    for t, now in enumerate(on):
        if now and not before:
            out.append((t, best[t], value[t]))
        elif now and value[t] > out[-1][2]:
            out[-1] = (t, best[t], value[t])
        before = now
    return out


def decode_array(p: np.ndarray, threshold: float = 0.7) -> list[int]:
    """greedy_decode of one array (frames, classes)."""
    return [k for _, k, _ in decode_runs(p, threshold)]


def recognise_lines(lines: DataFrame, model: Recogniser, codec: list[str], key: str = "line_id", pad: int = 16, threshold: float = 0.7) -> DataFrame:
    """(key, text, chars, error) of line images (data row-major, height): chars holds ch, x and p of every character.

    x is the place in the image, the padding taken off. Lines of one length are decoded together, a bounded number at a
    time; one that fails has an error only.
    """
    sent = lines.sparkSession.sparkContext.broadcast((model, codec))

    def decoded(own: Recogniser, names: list[str], frames: list[np.ndarray]) -> list[tuple]:
        out = []
        for p, f in zip(own.predict_many(np.stack(frames)), frames, strict=True):
            try:
                chars = [{"ch": names[c], "x": float(min(max(t - pad, 0), len(f) - 2 * pad - 1)), "p": v} for t, c, v in decode_runs(p, threshold)]
                out.append(("".join(c["ch"] for c in chars), chars, None))
            except IndexError as e:
                out.append((None, None, f"{type(e).__name__}: {e}"))
        return out

    def run(parts):
        own, names = sent.value
        width = 4 * own.forth.states + len(own.top)
        for part in parts:
            out: list[tuple] = [()] * len(part)
            waiting: dict[tuple, list[tuple[int, np.ndarray]]] = {}

            def settle(some: list[tuple[int, np.ndarray]], out=out) -> None:
                try:
                    found = decoded(own, names, [f for _, f in some])
                except (ValueError, TypeError) as e:
                    found = [(None, None, f"{type(e).__name__}: {e}")] * len(some)
                for (i, _), row in zip(some, found, strict=True):
                    out[i] = row

            for i, (data, h) in enumerate(zip(part["data"], part["height"], strict=True)):
                try:
                    a = np.asarray(data, float).reshape(int(h), -1)
                    if a.size < 10 or a.min() == a.max():
                        raise ValueError("degenerate line")
                    f = prepare_line(a, pad)
                except (ValueError, TypeError, IndexError) as e:
                    out[i] = (None, None, f"{type(e).__name__}: {e}")
                    continue
                same = waiting.setdefault(f.shape, [])
                same.append((i, f))
                if len(same) * len(f) * (width + f.shape[1]) >= BATCH_VALUES:
                    settle(waiting.pop(f.shape))
            for same in waiting.values():
                settle(same)
            yield pd.DataFrame({key: part[key], **{c: [r[k] for r in out] for k, c in enumerate(("text", "chars", "error"))}})

    return lines.select(F.col(key).cast("long").alias(key), "data", "height").mapInPandas(run, f"{key} long, text string, chars array<struct<ch string, x double, p double>>, error string")


def smoothed(errors: list[float], sigma: float) -> list[float]:
    """A log of errors smoothed by a Gaussian that is mirrored at the ends."""
    x = np.asarray(errors, float)
    if not len(x) or sigma <= 0:
        return x.tolist()
    from lineloom.operators.imaging import gaussian

    return gaussian(x[None, :], (0, sigma))[0].tolist()
