"""Packing by non-negative least squares: how often each short combination of lengths that fills a window should occur.

A document's tokens are cut into whole windows and a tail. The histogram of the tails' lengths has fewer classes than the
window has tokens, so it is solved on the driver at any corpus size: combinations of one to three lengths that fill a window
exactly are enumerated, non-negative repeat counts are fitted to the histogram and rounded, residuals are packed greedily
by as many lengths as fill a window, and the few that fill none are laid end to end, cut only where a window ends. Each tail then finds its place by its
rank among the tails of its length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import by_batches, slices, small, written
from pathloom.llm.tokens import tokenizer

#: The bases of so many parts, of at most 12 bytes a length, may be broadcast; more are joined by shuffle.
BROADCAST_PARTS = 4096
TOKENIZED = "part int, doc_id long, n_tokens long, tail int, tail_rank long, full_rank long, ids binary"


def _tokenize(path: str, keeps_space: bool, end_id: int, window: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(path, keeps_space), TaskContext.get().partitionId()
        seen, full = [0] * window, 0
        for piece in slices(batches):
            ids = [x + end for x in tok.encode([t or "" for t in piece.column(1).to_pylist()])]
            n = [len(x) // 4 for x in ids]
            tails, ranks, fulls = [x % window for x in n], [], []
            for length, t in zip(n, tails, strict=True):
                ranks.append(seen[t])
                seen[t] += 1
                fulls.append(full)
                full += length // window
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), piece.column(0), pa.array(n, pa.int64()), pa.array(tails, pa.int32()), pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "n_tokens", "tail", "tail_rank", "full_rank", "ids"])

    return run


def combinations(lengths: np.ndarray, window: int, steps: int = 32) -> list[tuple[int, ...]]:
    """One to three of the lengths that sum to the window; of triples those whose second is one of about `steps` spread ones."""
    have = set(lengths.tolist())
    out: set[tuple[int, ...]] = {(a, window - a) for a in have if window - a in have and a >= window - a}
    middle = sorted(lengths.tolist())[:: max(1, len(lengths) // steps)]
    for a in have:
        for b in middle:
            c = window - a - b
            if c in have:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def completed(first: int, left: dict[int, int], window: int) -> tuple[int, ...] | None:
    """Lengths that fill a window with `first`, out of those that are left: one or two that close the gap, else the longest
    that fits and on; None if that leads nowhere."""
    combo, gap = [first], window - first
    while gap:
        free = {k: n for k in left if (n := left[k] - combo.count(k)) > 0 and k <= gap}
        if gap in free:
            return (*combo, gap)
        pair = next((b for b in sorted(free, reverse=True) if 2 * b >= gap and free.get(gap - b, 0) > (2 * b == gap)), None)
        if pair:
            return (*combo, pair, gap - pair)
        if not free:
            return None
        combo.append(max(free))
        gap -= combo[-1]
    return tuple(combo)


def nonnegative_least_squares(columns: list[dict[int, int]], target: dict[int, float], sweeps: int = 30) -> np.ndarray:
    """x >= 0 that brings sum(x_j * column_j) close to the target, by cyclic coordinate descent on the sparse columns."""
    x, rest = np.zeros(len(columns)), dict(target)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = sum(n * rest[i] for i, n in col.items()) / sum(n * n for n in col.values())
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for i, n in col.items():
                    rest[i] -= n * step
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, bool]], int]:
    """Where the tails of each length go, and how many sequences they fill.

    A row is (length, lo, hi, base, offset, laid). The tails of that length with rank in [lo, hi) stand at `offset` of the
    sequences base + rank - lo each, or, if laid, end to end from token base * window + offset on."""
    left = {k: v for k, v in histogram.items() if 0 < k < window and v > 0}
    taken, rows, sequence = dict.fromkeys(left, 0), [], 0

    def use(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in combo:
            rows.append((length, taken[length], taken[length] + times, sequence, offset, False))
            taken[length] += times
            left[length] -= times
            offset += length
        sequence += times

    def fits(col: dict[int, int]) -> int:
        return min(left[i] // n for i, n in col.items())

    combos = combinations(np.array(sorted(left), int), window) if left else []
    columns = [{i: c.count(i) for i in c} for c in combos]
    x = nonnegative_least_squares(columns, {k: float(v) for k, v in left.items()})
    for j in np.argsort(-x, kind="stable"):
        if times := min(int(x[j]), fits(columns[j])):
            use(combos[j], times)
    # the residuals, the longest first
    for length in sorted(left, reverse=True):
        while left[length] and (combo := completed(length, left, window)):
            use(combo, fits({i: combo.count(i) for i in combo}))
    at = sequence * window
    for length in sorted(left, reverse=True):
        if left[length]:
            rows.append((length, taken[length], taken[length] + left[length], at // window, at % window, True))
            at += length * left[length]
    return rows, -(-at // window)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 1024, keeps_space: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every document's text (null: empty) is tokenized and ended by `end_id`; each of its tokens lies in one piece. All
    sequences but the last are full. Rows of equal doc_id are documents of their own; doc_id may be null; an empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = written(by_batches(texts, _tokenize(tokenizer_path, keeps_space, end_id, window), TOKENIZED), "tokenized", "zstd")
    # for each part and length of tail; at length 0 the tails are missing, and whole windows are counted there
    own = rows.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("full"))
    own = written(own, "histogram")
    histogram = {r.tail: r.n for r in own.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    places, n_tail_sequences = plan(histogram, window)
    by_tail = own.groupBy("part", "tail").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tail_bases = by_tail.select("part", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tail_base"))
    # one row per part, with the bases of the lengths that it has
    tail_bases = tail_bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("tail", "tail_base"))).alias("tail_bases"))
    parts = own.groupBy("part").agg(F.sum("full").alias("full")).withColumn("_", F.lit(0))
    full_bases = parts.select("part", F.coalesce(F.sum("full").over(Window.partitionBy("_").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))
    bases = small(written(tail_bases.join(full_bases, "part"), "bases"), BROADCAST_PARTS)
    planned = spark.createDataFrame(places, "tail int, lo long, hi long, base long, at long, laid boolean")
    ranked = rows.join(bases, "part").withColumn("rank", F.element_at("tail_bases", F.col("tail")) + F.col("tail_rank")).drop("tail_bases")
    # at most a few thousand rows: their number depends on the window alone
    placed = ranked.join(F.broadcast(planned), (ranked["tail"] == planned["tail"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").drop(planned["tail"])
    pos = F.when(F.col("laid"), F.col("base") * window + F.col("at") + (F.col("rank") - F.col("lo")) * F.col("tail")).otherwise((F.col("base") + F.col("rank") - F.col("lo")) * window + F.col("at"))
    placed = placed.withColumn("pos", pos).withColumn("n_full", F.floor(F.col("n_tokens") / window)).withColumn("first_part", F.least(F.col("tail").cast("long"), window - F.col("pos") % window))
    first_full = n_tail_sequences
    pieces = F.expr(f"""concat(
        if(n_full > 0, transform(sequence(0L, n_full - 1), k -> named_struct('start', k * {window}L, 'length', {window}L, 'sequence_id', {first_full}L + full_base + full_rank + k, 'offset', 0L)), array()),
        if(tail > 0, array(named_struct('start', n_full * {window}L, 'length', first_part, 'sequence_id', pos div {window}L, 'offset', pos % {window}L)), array()),
        if(tail > first_part, array(named_struct('start', n_full * {window}L + first_part, 'length', tail - first_part, 'sequence_id', pos div {window}L + 1, 'offset', 0L)), array()))""")
    cut = placed.select("doc_id", "ids", F.col("n_tokens").alias("doc_tokens"), F.explode(pieces).alias("p"))
    return cut.select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.expr("substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"), "doc_tokens", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))
