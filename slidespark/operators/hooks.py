"""Hooks for models of the user, and a baseline that can be put in: L1-L3."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.plans.shared import new_folder


def score(samples: DataFrame, load: Callable[[], Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """L1: (x, y, p, logits) of samples (x, y, ..). ``load`` runs once a task and returns the predictor of a batch.

    The predictor gives p and 16 logits a row; a missing row or a value that is not finite is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for f in frames:
            p, logits = (np.asarray(v, np.float64) for v in predict(f))
            if p.shape != (len(f),) or logits.shape != (len(f), 16) or not (np.isfinite(p).all() and np.isfinite(logits).all()):
                raise ValueError("the predictor must give a finite p and 16 finite logits for every row")
            yield pd.DataFrame({"x": f["x"], "y": f["y"], "p": p, "logits": list(logits)})

    return samples.mapInPandas(run, "x long, y long, p double, logits array<double>")


def encode_genes(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], normalize: bool = True, aliases: DataFrame | None = None) -> DataFrame:
    """L2: (symbol, embedding) of texts (symbol, text) under an encoder loaded once a task; vectors of length 1 if asked.

    With aliases (alias, symbol) each alias that is no symbol gets its symbol's vector. Non-finite values and rows of
    unequal dimension are errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for f in frames:
            v = np.asarray(encode(f["text"].tolist()), np.float64)
            if v.ndim != 2 or len(v) != len(f) or not np.isfinite(v).all():
                raise ValueError("the encoder must give one finite vector for every text")
            if normalize:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"symbol": f["symbol"], "embedding": list(v.astype(np.float32))})

    own = texts.select("symbol", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "symbol string, embedding array<float>")
    if aliases is None:
        return own
    more = aliases.join(texts.select(F.col("symbol").alias("alias")), "alias", "left_anti").join(own, "symbol")
    return own.unionByName(more.select(F.col("alias").alias("symbol"), "embedding"))


def fit_baseline(train: DataFrame, features: str = "features", steps: int = 60, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, list]:
    """L3: a foreground classifier (all rows) and a 16-way direction classifier (foreground rows) on pooled features.

    train (features array<double>, foreground 0/1, direction 0..15), of one row at least. Softmax regression by full
    gradients: the features are written once to the shared folder, and a step is one pass over them for both classifiers.
    Each task sums its own gradients, Spark sums those of the tasks, and 18 numbers a feature reach the driver."""
    spark, path = train.sparkSession, new_folder(train.sparkSession, "features")
    x = train.select(F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>")).alias("f"), F.col("foreground").cast("int").alias("foreground"), F.col("direction").cast("int").alias("direction"))
    x.write.parquet(path)
    x = spark.read.schema(x.schema).parquet(path)
    first = x.select(F.size("f")).first()
    if first is None:
        raise ValueError("no rows to fit")
    w = np.zeros((18, first[0]))
    for _ in range(steps):
        grad, n = _gradient(x, w)
        w -= np.where(n > 0, rate * (grad / np.maximum(n, 1) + ridge * w), 0)
    return {"foreground": w[:2].tolist(), "direction": w[2:].tolist()}


def _gradient(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradients of both classifiers, whose weights are rows 0-1 and 2-17 of w, and by row the number of examples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n = np.zeros(w.shape), np.zeros(len(w))
        for f in frames:
            if len(f):
                m, fg = np.array(f["f"].tolist()), f["foreground"].to_numpy()
                for at, use, y in ((slice(0, 2), slice(None), fg), (slice(2, 18), fg == 1, f["direction"].to_numpy())):
                    a, b = m[use], y[use].astype(int)
                    if len(a):
                        z = a @ w[at].T
                        p = np.exp(z - z.max(1, keepdims=True))
                        p /= p.sum(1, keepdims=True)
                        p[np.arange(len(a)), b] -= 1
                        g[at], n[at] = g[at] + p.T @ a, n[at] + len(a)
        k, j = np.indices(g.shape)
        yield pd.DataFrame({"k": np.r_[k.ravel(), np.arange(len(w))], "j": np.r_[j.ravel(), np.full(len(w), -1)], "v": np.r_[g.ravel(), n]})

    g, n = np.zeros(w.shape), np.zeros((len(w), 1))
    for r in rows.mapInPandas(run, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
        if r.j < 0:
            n[r.k] = r.v
        else:
            g[r.k, r.j] = r.v
    return g, n


def baseline_predictor(model: dict[str, list], features: str = "features") -> Callable[[], Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]]:
    """L3 as a predictor for ``score``."""

    def load():
        fg, d = (np.array(model[k]) for k in ("foreground", "direction"))

        def predict(f: pd.DataFrame):
            m = np.array([[1.0, *v] for v in f[features]]).reshape(len(f), -1)
            z = m @ fg.T if len(f) else np.zeros((0, 2))
            return 1 / (1 + np.exp(z[:, 0] - z[:, 1])), m @ d.T if len(f) else np.zeros((0, 16))

        return predict

    return load
