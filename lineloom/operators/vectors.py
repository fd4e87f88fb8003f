"""Vectors: nearest neighbours, clustering, projection, per-cluster models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom import storage

#: Prototypes are sent to the tasks only below so many bytes; beyond, the tables are joined in blocks.
PROTO_BYTES, BLOCKS, CHUNK_BYTES = 64 << 20, 16, 32 << 20


def _dense(df: DataFrame, vector: str):
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def knn(queries: DataFrame, protos: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest prototypes (key, vector) of every query, exactly; ties to the lesser key.

    A small prototype table is broadcast. A larger one is cut into blocks, each block of it meets every block of queries,
    and the blocks' k best are merged.
    """
    q = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("qv")).where("q is not null and qv is not null")
    p = protos.select(F.col(key).cast("long").alias("p"), F.col(vector).cast("array<double>").alias("pv")).where("p is not null and pv is not null")
    size = p.agg(F.count("*").alias("n"), F.max(F.size("pv")).alias("d")).first()
    blocks = 1 if (size["n"] or 0) * (size["d"] or 1) * 8 <= PROTO_BYTES else max(BLOCKS, -(-size["n"] * size["d"] * 8 // PROTO_BYTES))
    p = p.withColumn("b", F.pmod(F.xxhash64("p"), F.lit(blocks)))

    def best(qi, qv, pi, pv):
        """The k nearest of each query; pi ascends, and ties go to the lesser key."""
        d = np.maximum((qv * qv).sum(1)[:, None] + (pv * pv).sum(1)[None] - 2 * qv @ pv.T, 0)
        if not itself:
            d[qi[:, None] == pi[None]] = np.inf
        far = np.partition(d, min(k, d.shape[1]) - 1, 1)[:, min(k, d.shape[1]) - 1]
        row, col = np.nonzero((d <= far[:, None]) & np.isfinite(d))
        by = np.lexsort((col, d[row, col], row))
        row, col = row[by], col[by]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        return pd.DataFrame({"q": qi[row], "p": pi[col], "d": np.sqrt(d[row, col])})

    chunk = lambda n: max(1, CHUNK_BYTES // (8 * max(1, n)))  # queries at a time against n prototypes
    stack = lambda s: np.array(s.tolist(), float)
    if blocks == 1:
        rows = p.orderBy("p").select("p", "pv").toArrow()
        sent = q.sparkSession.sparkContext.broadcast((rows["p"].to_numpy(), _stacked(rows["pv"]) if len(rows) else np.zeros((0, 0))))

        def run(parts):
            pi, pv = sent.value
            for part in parts:
                step = chunk(len(pi))
                for at in range(0, len(part) if len(pi) else 0, step):
                    some = part.iloc[at : at + step]
                    yield best(some["q"].to_numpy(), stack(some["qv"]), pi, pv)

        near = q.mapInPandas(run, "q long, p long, d double")
    else:
        each = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("b", F.col("b").cast("long")).withColumn("part", F.pmod(F.hash("q"), F.lit(blocks)))
        spread = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"q": [], "p": [], "d": []})
            right = right.sort_values("p")
            pi, pv, step = right["p"].to_numpy(), stack(right["pv"]), chunk(len(right))
            return pd.concat([best(left["q"].to_numpy()[at : at + step], stack(left["qv"].iloc[at : at + step]), pi, pv) for at in range(0, len(left), step)])

        near = each.groupBy("b", "part").cogroup(spread.groupBy("b", "part")).applyInPandas(cell, "q long, p long, d double")
    w = Window.partitionBy("q").orderBy("d", "p")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(key), F.col("p").alias("neighbour"), F.round("d", 6).alias("distance"), "rank")


def nearest_distance(rows: DataFrame, selection: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rows' keys with the distance to the nearest vector of the selection: what sorting by similarity sorts by."""
    return knn(rows, selection, 1, key, vector, itself=True).select(key, "distance")


def pca(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", whiten: bool = False) -> DataFrame:
    """(key, components): vectors on the k directions of greatest variance; each direction's largest entry is positive."""
    from pyspark.ml.stat import Summarizer

    d = _dense(df.where(F.col(vector).isNotNull()), vector)
    mean = d.agg(Summarizer.mean(F.col("features"))).first()[0].toArray()

    def outer(parts):
        for part in parts:
            x = np.array(part[vector].tolist(), float).reshape(len(part), -1) - mean
            yield pd.DataFrame({"n": [len(part)], "c": [(x.T @ x).ravel()]})

    sums = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(outer, "n long, c array<double>")
    total = sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("c")[i]) for i in range(len(mean) ** 2))).alias("c")).first() if len(mean) <= 16 else None
    if total is None:  # wide: summed by position instead of by that many columns
        rows = sums.select("n", F.posexplode("c").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).orderBy("i").collect()
        n, cov = rows[0]["n"], np.array([r["c"] for r in rows])
    else:
        n, cov = total["n"], np.array(total["c"])
    values, axes = np.linalg.eigh(cov.reshape(len(mean), -1) / n)
    axes, values = axes[:, ::-1][:, :k], values[::-1][:k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    if whiten:
        axes = axes / np.sqrt(np.maximum(values, 1e-12))

    def project(parts):
        for part in parts:
            x = np.array(part[vector].tolist(), float).reshape(len(part), -1) - mean
            yield pd.DataFrame({key: part[key], "components": (np.round(x @ axes, 6) + 0.0).tolist()})

    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInPandas(project, f"{key} long, components array<double>")


def kmeans(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """(key, cluster) by the built-in distributed k-means."""
    from pyspark.ml.clustering import KMeans

    d = _dense(df, vector)
    return KMeans(k=k, seed=seed, maxIter=20).fit(d).transform(d).select(key, F.col("prediction").cast("long").alias("cluster"))


def leaders(df: DataFrame, eps: float, key: str = "vec_id", vector: str = "embedding", batch: int = 4096) -> DataFrame:
    """(key, vector) of the leaders: in the order of the key, a vector is one unless an earlier leader is closer than eps.

    Each round decides the first `batch` vectors that are left, one after the other on the driver, and then takes out of
    the rest, in one pass without a shuffle, what the new leaders reach. The result depends on no partition.
    """
    schema = f"{key} long, {vector} array<double>"
    left = storage.cut(df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull()))
    spark, path = df.sparkSession, None
    while len(rows := left.orderBy(key, vector).limit(batch).toArrow()):
        keys, vecs = rows[key].to_numpy(), _stacked(rows[vector])
        held, chosen = np.empty_like(vecs), []
        for i, v in enumerate(vecs):
            if not _closer(v[None], held[: len(chosen)], eps)[0]:
                held[len(chosen)] = v
                chosen.append(i)
        held = held[: len(chosen)]
        path = path or storage.fresh_path(spark, "leaders")
        spark.createDataFrame(rows.take(chosen), schema).write.mode("append").parquet(path)
        if len(rows) < batch:
            break
        sent, last = spark.sparkContext.broadcast(held), int(keys[-1])

        def outside(parts, sent=sent, last=last):
            for part in parts:
                part = part[part[key] >= last]
                if len(part):
                    part = part[~_closer(np.array(part[vector].tolist(), float).reshape(len(part), -1), sent.value, eps)]
                yield part

        left = storage.cut(left.mapInPandas(outside, schema))
        sent.unpersist()
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _stacked(column) -> np.ndarray:
    """An Arrow column of lists of one length as the rows of an array."""
    flat = column.combine_chunks()
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _closer(x: np.ndarray, held: np.ndarray, eps: float) -> np.ndarray:
    """Whether some row of held is closer than eps to each row of x; in pieces of bounded size, near the bound by differences."""
    out = np.zeros(len(x), bool)
    if not len(held):
        return out
    norm, step = (held * held).sum(1), max(1, CHUNK_BYTES // (8 * len(held)))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        d = some @ held.T
        d *= -2
        d += norm
        d += (some * some).sum(1)[:, None]
        slack = 1e-9 * (eps * eps + norm.max())
        out[at : at + step] = d.min(1) < eps * eps - slack
        for i in np.flatnonzero(~out[at : at + step]):
            near = np.flatnonzero(d[i] < eps * eps + slack)
            out[at + i] = len(near) > 0 and ((held[near] - some[i]) ** 2).sum(1).min() < eps * eps
    return out


def leader_clusters(df: DataFrame, eps: float, key: str = "vec_id", vector: str = "embedding", batch: int = 4096) -> DataFrame:
    """(key, leader, distance): every vector's nearest leader, which is closer than eps unless it is one itself."""
    near = knn(df, leaders(df, eps, key, vector, batch), 1, key, vector, itself=True)
    return near.select(key, F.col("neighbour").alias("leader"), "distance")


def classical_scaling(d: np.ndarray, k: int = 2) -> np.ndarray:
    """Points in k dimensions whose distances are near those given, by the eigenvectors of the centred squares; signs fixed.

    For the prototypes of a model, some thousands at most: the table is square.
    """
    n = len(d)
    c = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-0.5 * c @ (d * d) @ c)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes * np.sqrt(np.maximum(values, 0))


class SelfOrganisingMap:
    """A grid of prototypes that neighbours in the grid share, trained on a bounded sample on the driver."""

    def __init__(self, height: int, width: int, dims: int, seed: int = 1):
        self.shape = (height, width)
        self.proto = np.random.default_rng(seed).normal(size=(height * width, dims)) * 0.1
        y, x = np.divmod(np.arange(height * width), width)
        self.place = np.stack([y, x], 1).astype(float)

    def train(self, data: np.ndarray, steps: int = 2000, rate: float = 0.3, radius: float | None = None, seed: int = 1) -> None:
        rng, radius = np.random.default_rng(seed), radius or max(self.shape) / 2
        for t in range(steps):
            x, f = data[rng.integers(len(data))], t / steps
            near = self.place - self.place[((self.proto - x) ** 2).sum(1).argmin()]
            pull = np.exp(-(near**2).sum(1) / (2 * (radius * (1 - f) + 0.5 * f) ** 2))
            self.proto += (rate * (1 - f) + 0.01) * pull[:, None] * (x - self.proto)

    def find(self, data: np.ndarray) -> np.ndarray:
        """Number of the nearest prototype of each row."""
        return ((data * data).sum(1)[:, None] + (self.proto**2).sum(1)[None] - 2 * data @ self.proto.T).argmin(1)


class Perceptron:
    """A network of one hidden layer; trained by whole passes over a table, each task adding up its rows' gradients."""

    def __init__(self, inputs: int, hidden: int, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(size=(inputs + 1, hidden)) / np.sqrt(inputs + 1), rng.normal(size=(hidden + 1, classes)) / np.sqrt(hidden + 1)]
        self.motion = [np.zeros_like(w) for w in self.w]

    def _through(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = np.ones((len(x), 1))
        x = np.hstack([one, x])
        h = np.hstack([one, np.tanh(x @ self.w[0])])
        z = h @ self.w[1]
        z = np.exp(z - z.max(1, keepdims=True))
        return x, h, z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._through(x)[2]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x, h, p = self._through(x)
        delta = np.eye(p.shape[1])[y] - p
        return [x.T @ ((delta @ self.w[1].T) * (1 - h * h))[:, 1:], h.T @ delta]

    def train_step(self, df: DataFrame, label: str, vector: str = "embedding", rate: float = 0.5, momentum: float = 0.9) -> int:
        """One step on all rows that have a vector and a label; the number of rows."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(parts):
            total, n = None, 0
            for part in parts:
                if len(part):
                    g = sent.value.gradients(np.array(part["x"].tolist(), float), part["y"].to_numpy())
                    total, n = (g if total is None else [a + b for a, b in zip(total, g, strict=True)]), n + len(part)
            if n:
                yield pd.DataFrame({"n": [n], "g": [np.concatenate([x.ravel() for x in total]).tobytes()]})

        rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y")).where("x is not null and y is not null")
        n, flat = 0, np.zeros(sum(w.size for w in self.w))
        for r in rows.mapInPandas(run, "n long, g binary").toLocalIterator():
            n, flat = n + r["n"], flat + np.frombuffer(r["g"])
        if n:
            for w, m, g in zip(self.w, self.motion, np.split(flat, [self.w[0].size]), strict=True):
                m *= momentum
                m += rate * g.reshape(w.shape) / n
                w += m
        return n


def per_cluster(df: DataFrame, cluster: str, label: str, least: int = 1) -> DataFrame:
    """(cluster, label, n, cost): a trivial classifier of each cluster of `least` rows or more, -log of its labels' shares."""
    c = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(cluster))
    return c.withColumn("t", total).where(F.col("t") >= least).select(cluster, label, "n", F.round(-F.log(F.col("n") / F.col("t")), 6).alias("cost"))


def gaussians(df: DataFrame, by: str, vector: str = "embedding", floor: float = 0.01) -> DataFrame:
    """(by, dim, mean, std) of a Gaussian with independent dimensions for each class."""
    each = df.select(by, F.posexplode(vector).alias("dim", "v"))
    return each.groupBy(by, "dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("v"), F.lit(floor)), 6).alias("std"))


def logistic(df: DataFrame, label: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, label, pred, cost): the built-in multinomial logistic regression, on its own training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    d = _dense(df, vector).withColumn("label", F.col(label).cast("double"))
    out = LogisticRegression(maxIter=30, regParam=0.01).fit(d).transform(d)
    p = vector_to_array("probability")
    return out.select(key, F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("pred"), F.round(-F.log(F.array_max(p)), 6).alias("cost"))
