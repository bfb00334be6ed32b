"""A network with one hidden layer on sparse bags of words, fitted by full-batch L-BFGS.

Spark ML's multilayer perceptron turns every row into a dense one and keeps these for all iterations, several hundred times
the size of the sparse rows. Here rows stay sparse, packed in blocks of bounded size; only a block at a time is dense, in a task.
An iteration is one Spark job: tasks sum the gradients of their blocks, the sums are added up in a tree. The driver
holds the parameters and the last steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, so a dense block of 5000 features has 5 MB.
BLOCK_ROWS = 256


def sparse_parts(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values of the entries of (indices, values) rows; a row without indices is dense."""
    cols = [np.arange(len(v), dtype=np.int32) if i is None else np.asarray(i, np.int32) for i, v in rows]
    values = [np.asarray(v, np.float32) for _, v in rows]
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in cols])
    return at, np.concatenate([np.zeros(0, np.int32), *cols]), np.concatenate([np.zeros(0, np.float32), *values])


def dense(n: int, width: int, at: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
    m = np.zeros((n, width), np.float32)
    m[at, cols] = values
    return m


def layers(flat: np.ndarray, width: int, hidden: int):
    """The views of a flat parameter vector: weights and offsets of the hidden layer, then of the two outputs."""
    sizes = [(width, hidden), (hidden,), (hidden, 2), (2,)]
    out, start = [], 0
    for s in sizes:
        out.append(flat[start:start + int(np.prod(s))].reshape(s))
        start += out[-1].size
    return out


def outputs(x: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
    """States of the hidden layer (sigmoid) and the raw outputs of dense rows."""
    w1, b1, w2, b2 = parts
    h = 1 / (1 + np.exp(-np.clip(x @ w1 + b1, -60, 60)))
    return h, h @ w2 + b2


def loss_and_gradient(flat: np.ndarray, width: int, hidden: int, blocks) -> np.ndarray:
    """Sums over the rows of blocks: the gradient of the cross entropy, the cross entropy, and the number of rows."""
    parts, total = layers(flat, width, hidden), np.zeros(len(flat) + 2)
    grads = layers(total[:-2], width, hidden)
    for y, at, cols, values in blocks:
        x = dense(len(y), width, at, cols, values)
        h, raw = outputs(x, parts)
        raw = raw - raw.max(axis=1, keepdims=True)
        p = np.exp(raw)
        p /= p.sum(axis=1, keepdims=True)
        total[-2] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).sum(dtype=np.float64)
        total[-1] += len(y)
        p[np.arange(len(y)), y] -= 1
        d = (p @ parts[2].T) * h * (1 - h)
        for g, part in zip(grads, (x.T @ d, d.sum(axis=0), h.T @ p, p.sum(axis=0))):
            g += part
    return total


def minimise(f, x: np.ndarray, steps: int, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient. Ends when ten steps gain, or the gradient is, next to nothing."""
    value, g = f(x)
    past: list[tuple] = []
    values = [value]
    for _ in range(steps):
        if np.linalg.norm(g) <= max(tolerance * abs(value), 1e-8):
            break
        d, scales = -g, []
        for s, y, r in reversed(past):
            scales.append(r * (s @ d))
            d = d - scales[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])) if past else d / max(np.linalg.norm(g), 1e-12)
        for (s, y, r), a in zip(past, reversed(scales)):
            d = d + (a - r * (y @ d)) * s
        slope, size = g @ d, 1.0
        if slope >= 0:
            d, slope, past = -g, -(g @ g), []
        while True:
            new_value, new_g = f(x + size * d)
            if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if new_value >= value:
            break
        s, y = size * d, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, g = x + s, new_value, new_g
        values.append(value)
        if len(values) > 10 and values[-11] - value <= tolerance * abs(values[0]):
            break
    return x


class SparseNetwork:
    """Estimator of a classifier of labels 0 and 1: ``n_features`` inputs, ``hidden`` sigmoid units, two softmax outputs."""

    def __init__(self, n_features: int, hidden: int = 100, label: str = "label", features: str = "features", max_iter: int = 100, seed: int = 1) -> None:
        self.width, self.hidden, self.label, self.features, self.max_iter, self.seed = n_features, hidden, label, features, max_iter, seed

    def fit(self, df: DataFrame) -> "SparseNetworkModel":
        from shiftkit.session import ship_package

        spark, width, hidden = df.sparkSession, self.width, self.hidden
        ship_package(spark)
        sc, f = spark.sparkContext, F.unwrap_udt(self.features)
        rows = df.select(F.col(self.label).cast("int").alias("y"), f["indices"].alias("i"), f["values"].alias("v"))

        def pack(batches):
            def arrays(pdf):
                for start in range(0, len(pdf), BLOCK_ROWS):
                    part = pdf.iloc[start:start + BLOCK_ROWS]
                    at, cols, values = sparse_parts(list(zip(part["i"], part["v"])))
                    yield [x.tobytes() for x in (part["y"].to_numpy(np.int32), at, cols, values)]

            for pdf in batches:
                yield pd.DataFrame(list(arrays(pdf)), columns=["y", "at", "cols", "vals"])

        packed = rows.mapInPandas(pack, "y binary, at binary, cols binary, vals binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)

        def unpack(r):
            return [np.frombuffer(b, t) for b, t in zip(r, (np.int32, np.int32, np.int32, np.float32))]

        def value(flat):
            sent = sc.broadcast(flat.astype(np.float32))
            total = packed.mapPartitions(lambda part: [loss_and_gradient(sent.value, width, hidden, map(unpack, part))]).treeReduce(lambda a, b: a + b)
            sent.destroy()
            n = max(total[-1], 1.0)
            return total[-2] / n, total[:-2] / n

        rng = np.random.default_rng(self.seed)
        first = np.zeros((width + 1) * hidden + (hidden + 1) * 2)
        for part, fan_in in zip(layers(first, width, hidden), (width, width, hidden, hidden)):
            part[...] = rng.uniform(-2.4, 2.4, part.shape) / fan_in
        try:
            return SparseNetworkModel(minimise(value, first, self.max_iter).astype(np.float32), width, hidden, self.features)
        finally:
            packed.unpersist()


class SparseNetworkModel:
    """The fitted network; ``transform`` adds ``rawPrediction`` (a vector) and ``prediction``."""

    def __init__(self, flat: np.ndarray, width: int, hidden: int, features: str) -> None:
        self.flat, self.width, self.hidden, self.features = flat, width, hidden, features

    def transform(self, df: DataFrame) -> DataFrame:
        width, hidden, sent = self.width, self.hidden, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("array<double>")
        def raw(f: pd.DataFrame) -> pd.Series:
            parts, out = layers(sent.value, width, hidden), []
            for start in range(0, len(f), BLOCK_ROWS):
                part = f.iloc[start:start + BLOCK_ROWS]
                x = dense(len(part), width, *sparse_parts(list(zip(part["indices"], part["values"]))))
                out += outputs(x, parts)[1].astype(np.float64).tolist()
            return pd.Series(out, dtype=object)

        scored = df.withColumn("_raw", raw(F.unwrap_udt(self.features)))
        return scored.withColumn("rawPrediction", array_to_vector("_raw")).withColumn(
            "prediction", (F.col("_raw")[1] > F.col("_raw")[0]).cast("double")).drop("_raw")
