"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays that numpy traverses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import docstats
from pathloom.llm.common import by_batches, crc_of_id, sampled, slices, texts_of


@dataclass
class Forest:
    """Trees of equal depth in arrays [tree, node]: node i has the children 2i + 1 and 2i + 2; leaves hold values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        first_leaf = (1 << self.depth) - 1
        return 1 / (1 + np.exp(-(self.start + self.value[trees, at - first_leaf].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 20) -> Forest:
    """Boosting of the logistic loss with one histogram pass per level; without both labels the forest is a constant."""
    n, width = x.shape
    least = min(least, max(3, n // 20))
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n < 2 * least or not 0 < y.sum() < n:
        return Forest(feature[:1], threshold[:1], value[:1], depth, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            k = 1 << level
            flat = ((node[:, None] * width + np.arange(width)) * bins + codes).ravel()
            hist = [np.bincount(flat, np.repeat(w, width), k * width * bins).reshape(k, width, bins) for w in (g, h, np.ones(n))]
            gl, hl, nl = (a.cumsum(axis=2) for a in hist)
            gt, ht, nt = (a[:, :1, -1:] for a in (gl, hl, nl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            for i in range(k):
                j, b = divmod(int(best[i]), bins)
                at = k - 1 + i
                if gain[i, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[t, at], threshold[t, at] = j, cuts[j][b]
            now = k - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, now]] > threshold[t, now])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -rate * gs / (hs + ridge)
        margin += value[t][node]
    return Forest(feature, threshold, value, depth, start)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [docstats.features(docstats.statistics(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def learn_quality(docs: DataFrame, labels: DataFrame, held_out: Callable, most: int = 12_000) -> Forest:
    """A forest fitted on at most `most` labelled documents (a sample by hash of the id), none of which held_out(id) picks.

    Rows without an id or with a label other than 0 and 1 teach nothing, nor do null texts; of rows of equal doc_id the
    smallest text does."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    rows = texts_of(docs, sampled(usable, most, F.col("doc_id"), F.col("label")), ["doc_id"])
    rows = by_batches(rows.select("label", "text"), _vectors, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.x, r.label))
    x = np.array([r.x for r in rows], float).reshape(len(rows), docstats.N_FEATURES)
    return fit_forest(x, np.array([r.label for r in rows], float))


def fifth(doc_id: str) -> Column:
    """Whether the crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(crc_of_id(doc_id) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, forest: Forest, score: str = "score") -> DataFrame:
    """docs with the column `score`, the probability that the text has quality label 1. A null text counts as empty; an old
    column of that name goes."""
    rest = [c for c in docs.columns if c not in (score, "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([docstats.features(docstats.statistics(t)) for t in b.column("text").to_pylist()], float).reshape(-1, docstats.N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], names=[*b.schema.names, score])

    return by_batches(docs.select(*rest, "text"), run, f"{fields}, `{score}` double")
