"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames
from ledgerloom.llm.docstats import with_features
from ledgerloom.session import stage

# Bound of the training sample: labelled rows of the smallest id hash.
MAX_TRAINING_ROWS = 30_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_WEIGHT = 1.0
CUT = 0.3


@dataclass
class Trees:
    """Complete binary trees as flat arrays: node i has children 2i+1 and 2i+2, leaves come last."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``, walking all rows down a tree at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boost logistic loss with trees grown level by level on histograms of binned features.

    Without rows the score is 0.5 everywhere; with a single label it is near that label.
    """
    n_features = x.shape[1]
    inner, leaves = 2**depth - 1, 2**depth
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(
        float(np.log(rate / (1 - rate))),
        np.zeros((trees, inner), dtype=np.int64),
        np.full((trees, inner), np.inf),
        np.zeros((trees, leaves)),
    )
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best_gain, best_f, best_b = np.zeros(width), np.zeros(width, dtype=np.int64), np.full(width, -1)
            for f in range(n_features):
                cell = (node - first) * bins + binned[:, f]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(cell, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
                gain[(h < MIN_WEIGHT) | (h_all - h < MIN_WEIGHT)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best_gain + 1e-12
                best_gain = np.where(better, gain[np.arange(width), at], best_gain)
                best_f, best_b = np.where(better, f, best_f), np.where(better, at, best_b)
            for k in range(width):
                if best_b[k] >= 0:
                    model.feature[t, first + k] = best_f[k]
                    model.cut[t, first + k] = edges[best_f[k]][best_b[k]]
            right = (best_b[node - first] >= 0) & (
                binned[np.arange(len(y)), best_f[node - first]] > best_b[node - first]
            )
            node = 2 * node + 1 + right
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        model.leaf[t] = -RATE * g / (h + L2)
        total += model.leaf[t][node - inner]
    return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Quality score of every document.

    Learns from documents whose id has a label and for which ``train`` (a column over
    ``id_col``) holds: a bounded sample, the MAX_TRAINING_ROWS rows of the smallest id hash. Repeated
    labels of an id count as their rounded mean, null labels and ids as none. Returns per row of
    ``docs`` ``id_col``, ``score`` (0 to 1) and ``predicted`` (1 from CUT on). Null and empty texts
    are scored by zero features; without labels every score is 0.5.
    """
    stats = stage(with_features(docs, id_col, text_col), "features")
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(train)
        .groupBy(id_col)
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), id_col)
        .limit(MAX_TRAINING_ROWS)
    )
    rows = stats.join(marks, id_col).select("features", "label").limit(2 * MAX_TRAINING_ROWS).toPandas()
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), -1 if len(rows) else 1)
    order = np.lexsort(x.T) if len(rows) else []
    model = fit(x[order], rows["label"].to_numpy(dtype=np.float64)[order])

    def run(batches):
        for frame in batches:
            if len(frame):
                x = np.array(frame["features"].tolist(), dtype=np.float64)
                yield pd.DataFrame({id_col: frame[id_col], "score": model.score(x)})

    scored = map_frames(stats, run, f"{id_col} {stats.schema[id_col].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
