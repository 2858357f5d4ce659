"""Order-preserving near-duplicate removal of paths by the Jaccard similarity of their node sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.scratch import written


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b (draw ids) and similarity of all pairs of distinct sets (draw_id, items) with Jaccard >= threshold > 0.

    Items are ordered from rare to frequent; two such sets must share one of the first few, so only those are joined on."""
    sets = sets.select("draw_id", "items")
    frequency = sets.select(F.explode("items").alias("item")).groupBy("item").count()
    listed = sets.select("draw_id", F.explode("items").alias("item")).join(frequency, "item")
    ordered = listed.groupBy("draw_id").agg(F.array_sort(F.collect_list(F.struct("count", "item"))).alias("o"))
    n = F.size("o")
    prefix = n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    heads = ordered.select("draw_id", n.alias("n"), F.explode(F.slice("o", F.lit(1), F.least(prefix.cast("int"), n))["item"]).alias("item"))
    left, right = heads.toDF("a", "na", "item"), heads.toDF("b", "nb", "item")
    pairs = left.join(right, "item").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    named = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return named.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)


def greedy_dedup(paths: DataFrame, threshold: float) -> DataFrame:
    """The paths that a scan in the order of draw_id keeps: each unless a kept one before it is at least `threshold` alike.

    Equal sets are joined first, which settles all when no two different sets can be that alike. What is left is decided in
    rounds over the pairs: a path whose alike predecessors are all rejected is kept, one with a kept predecessor is not.
    A lower threshold drops more. At 0 or less only the first path stays, above 1 all do."""
    if threshold > 1:
        return paths
    if threshold <= 0:
        return paths.join(F.broadcast(paths.agg(F.min("draw_id").alias("draw_id"))), "draw_id", "left_semi")
    own = F.array_sort(F.array_distinct("nodes"))
    sets = written(paths.groupBy(own.alias("items")).agg(F.min("draw_id").alias("draw_id")).select("draw_id", "items"), "sets")
    longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    if longest and threshold > (longest - 1) / longest:
        return paths.join(sets.select("draw_id"), "draw_id", "left_semi")
    pairs = written(similar_pairs(sets, threshold).select("a", "b"), "pairs")
    rejected = None
    open_pairs = pairs
    kept = written(sets.select(F.col("draw_id").alias("a")).join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "kept")
    while True:
        out = written(open_pairs.join(kept, "a", "left_semi").select(F.col("b").alias("a")).distinct(), "out")
        rejected = out if rejected is None else rejected.union(out)
        # pairs whose first is decided or whose second is rejected settle nothing more
        rest = open_pairs.join(out.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b").join(kept, "a", "left_anti").join(out, "a", "left_anti")
        rest = written(rest, "open")
        undecided = open_pairs.select(F.col("b").alias("a")).distinct().join(out, "a", "left_anti")
        kept = written(undecided.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "kept")
        open_pairs = rest
        if not kept.limit(1).count():
            break
    return paths.join(sets.select("draw_id"), "draw_id", "left_semi").join(rejected.distinct(), paths["draw_id"] == rejected["a"], "left_anti")


def ordered_fold(paths: DataFrame, threshold: float) -> DataFrame:
    """The same by a fold over all paths in one task, for few of them; greedy_dedup() is tested against it."""
    item = F.array_sort(F.collect_list(F.struct("draw_id", "nodes")))
    empty = F.expr("CAST(array() AS array<struct<draw_id:bigint,nodes:array<string>>>)")
    fold = F.aggregate(item, empty, lambda acc, x: F.when(F.exists(acc, lambda y: jaccard(x.nodes, y.nodes) >= threshold), acc).otherwise(F.array_append(acc, x)))
    return paths.agg(fold.alias("k")).select(F.explode("k").alias("k")).select("k.draw_id", "k.nodes")


def dedup_stats(paths: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: kept and skipped."""
    a, b = (df.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1)) for df, n in ((paths, "paths"), (kept, "kept")))
    return a.join(b, "_k").select("kept", (F.col("paths") - F.col("kept")).alias("duplicates_skipped"))
