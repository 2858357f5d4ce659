"""Quality rules by robust multivariate outliers.

Every document has a vector of transformed statistics. For each language and source a minimum-covariance-determinant
estimate is fitted by concentration steps: from a start at medians and their deviations, the three quarters of rows that lie
closest in Mahalanobis distance give the next mean and covariance, until no group's determinant falls any more. All steps
are aggregations, so a source that holds a third of all rows is pre-aggregated like any other and no group meets in one
task. A document far from its group's centre is rejected; a group too small for an estimate uses its language's, or else
that of all documents."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import docstats
from pathloom.llm.common import by_batches, slices, small, written

#: Transformed statistics, and how far below its typical spread each may not shrink.
VECTOR = {"f_length": 0.5, "f_word": 0.1, "f_symbols": 0.7, "f_lines": 2.0, "f_repeats": 1.0, "f_upper": 0.5, "f_marks": 0.3, "f_types": 0.1, "f_bars": 0.5}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
K = len(VECTOR)


def vector(stats: tuple[float, ...]) -> list[float]:
    """Shares as logarithms of one plus percents, so that rare marks weigh little and frequent ones much."""
    s = dict(zip(docstats.COUNTS + docstats.SHAPES, stats, strict=True))
    words, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
    share = lambda a, b: math.log1p(100 * a / b)
    return [
        math.log1p(s["n_words"]), math.log1p(s["word_chars"] / words), share(s["n_symbols"], words), share(s["n_dup_lines"], s["n_lines"]), share(s["n_repeat_words"], words),
        share(s["upper"], max(s["upper"] + s["lower"], 1)), share(s["punctuation"], chars), math.log(max(s["distinct_words"], 1) / words) / max(math.log(words + 1), 1), share(s["bars"], words),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [docstats.statistics(t) for t in b.column("text").to_pylist()]
        counts = [pa.array([int(s[i]) for s in found], pa.int64()) for i in range(len(BASE))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *counts, pa.array([vector(s) for s in found], pa.list_(pa.float64()))], names=["doc_id", "lang", "source", *BASE, "x"])


def statistics_of(docs: DataFrame) -> DataFrame:
    """The counts and the vector x of each row; a null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return by_batches(rows, _statistics, STATISTICS)


def _distance(x: Column, mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance, written out over the K * (K + 1) / 2 different products."""
    d = [F.get(x, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(K)]
    total = F.lit(0.0)
    for i in range(K):
        row = F.get(precision, F.lit(i * K + i)) * d[i]
        for j in range(i):
            row = row + 2 * F.get(precision, F.lit(i * K + j)) * d[j]
        total = total + row * d[i]
    return total


def _inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance of each group from its sums; spreads have their floors."""
    floors = np.diag(np.square(list(VECTOR.values())))
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            mean = np.asarray(r.sums, float) / r.n
            cov = np.asarray(r.products, float).reshape(K, K) / r.n - np.outer(mean, mean)
            cov = (cov + cov.T) / 2 + floors
            out.append((r.level, r.lang, r.source, r.n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["level", "lang", "source", "n", "mean", "precision", "log_det"])


_MODEL = "level int, lang string, source string, n long, mean array<double>, precision array<double>, log_det double"
_GROUP = ["level", "lang", "source"]


def _joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    other = model.toDF(*(f"_{c}" if c in _GROUP else c for c in model.columns))
    return rows.join(small(other, 100_000), F.col("level").eqNullSafe(F.col("_level")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_level", "_lang", "_source")


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows whose group is not among the others."""
    other = others.select(*(F.col(c).alias(f"_{c}") for c in _GROUP))
    return rows.join(small(other, 100_000), F.col("level").eqNullSafe(F.col("_level")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left_anti")


def _falling(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """The rows of `new` whose log-determinant lies more than the tolerance below that of their group in `old`."""
    before = old.select(*_GROUP, F.col("log_det").alias("_before"))
    return _joined(new, before).filter(F.col("_before") - F.col("log_det") > tolerance).select(*new.columns)


def estimates(stats: DataFrame, part: float = 0.75, tolerance: float = 1e-3, steps: int = 20) -> DataFrame:
    """One row per group of the levels 0 (language and source), 1 (language) and 2 (all): mean, precision, scale and rows.

    A group takes concentration steps until one lowers the log-determinant by no more than `tolerance`, or `steps` are done
    (each lowers it, so they do settle, in about five). There is one start, the same on every run. `scale` makes the group's median squared distance that of a chi-square distribution with K degrees of freedom."""
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), F.lit(None).cast("string").alias("source")), F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    rows = stats.select("x", F.explode(levels).alias("g")).select("g.*", "x")
    item = [F.get("x", F.lit(i)) for i in range(K)]
    middle = written(rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for c in item)).alias("q")), "quartiles")
    spread = lambda i: F.pow((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349, 2) + list(VECTOR.values())[i] ** 2
    model = middle.select(*_GROUP, "n", F.array(*(F.col("q")[i][1] for i in range(K))).alias("mean"), F.array(*((1 / spread(i)) if i == j else F.lit(0.0) for i in range(K) for j in range(K))).alias("precision"))
    moving, settled = model, []
    for step in range(steps):
        near = _joined(rows, moving).withColumn("d", _distance(F.col("x"), F.col("mean"), F.col("precision"))).select(*_GROUP, "x", "d")
        cuts = written(near.groupBy(*_GROUP).agg(F.percentile_approx("d", F.lit(part), 1000).alias("cut")), "cuts")
        inside = _joined(near, cuts).filter("d <= cut")
        sums = inside.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(c) for c in item)).alias("sums"), *(F.sum(item[i] * item[j]).alias(f"p{i}_{j}") for i in range(K) for j in range(i + 1)))
        full = sums.select(*_GROUP, "n", "sums", F.array(*(F.col(f"p{max(i, j)}_{min(i, j)}") for i in range(K) for j in range(K))).alias("products"))
        last, model = moving, written(full.mapInPandas(_inverted, _MODEL), "model")
        moving = written(_falling(last, model, tolerance), "moving") if step else model
        settled.append(_without(model, moving))
        if not moving.limit(1).count():
            break
    else:
        settled.append(moving)
    model = written(functools.reduce(DataFrame.unionByName, settled), "models")
    last = _joined(rows, model).withColumn("d", _distance(F.col("x"), F.col("mean"), F.col("precision")))
    medians = last.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("d", F.lit(0.5), 1000).alias("median"))
    chi = K * (1 - 2 / (9 * K)) ** 3  # the median of a chi-square distribution, by Wilson and Hilferty
    return written(_joined(medians, model).select(*_GROUP, "rows", "mean", "precision", F.greatest(F.col("median") / chi, F.lit(0.05)).alias("scale")), "estimates")


def judge(stats: DataFrame, tail: float = 0.05, least: int = 100) -> DataFrame:
    """stats with distance, base_failed and kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows. Of the others those are kept whose squared
    distance from their group, by the smallest level with at least `least` documents (or all), is at most K / tail. By
    Chebyshev's inequality no more than the share `tail` of a population lies beyond that, whatever its distribution; the
    statistics are shares with long tails, of which a chi-square quantile would reject many. Null languages and sources are
    groups of their own."""
    stats = written(stats, "statistics")
    models = estimates(stats)
    at = models.withColumn("m", F.struct("rows", "mean", "precision", "scale")).select(*_GROUP, "m")
    fine = at.filter((F.col("level") == 0) & (F.col("m.rows") >= least)).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("m").alias("m0"))
    wide = at.filter((F.col("level") == 1) & (F.col("m.rows") >= least)).select(F.col("lang").alias("_l"), F.col("m").alias("m1"))
    rows = stats.join(small(fine, 100_000), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    rows = rows.join(small(wide, 100_000), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    everyone = models.filter("level = 2").select("rows", "mean", "precision", "scale").first()  # None for an empty table
    literal = lambda v: F.array(*map(F.lit, v))
    whole = F.struct(F.lit(everyone.rows).alias("rows"), literal(everyone.mean).alias("mean"), literal(everyone.precision).alias("precision"), F.lit(everyone.scale).alias("scale")) if everyone else F.col("m0")
    rows = rows.withColumn("m", F.coalesce("m0", "m1", whole))
    rows = rows.withColumn("distance", _distance(F.col("x"), F.col("m.mean"), F.col("m.precision")) / F.col("m.scale"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("distance") <= K / tail)).select(*stats.columns, "distance", "base_failed", "kept")
