"""Draws of start nodes with replacement, by degree or uniformly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.draws import below
from pathloom.operators.graph import in_ranges, ranked


def running_total(df: DataFrame, order: str, amount: str, buckets: int = 64) -> DataFrame:
    """df with lo, the sum of `amount` over the rows before in the order of the distinct longs `order`, in two phases."""
    parts = in_ranges(df, order, buckets)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over at most `buckets` rows
    sizes = parts.groupBy("_p").agg(F.sum(amount).alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_i", inner).join(F.broadcast(sizes), "_p").withColumn("lo", F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")


def sample_weighted(spark: SparkSession, degrees: DataFrame, k: int, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """draw_id and start of k draws, each node with the weight of its degree; without any edge all nodes weigh the same.

    A node owns a stretch of the total degree as long as its own. Stretches and draws meet by the bucket they fall in, so a
    hub, which owns many buckets, is spread over them; there is no join on ranges alone."""
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    if not total:
        return sample_uniform(spark, degrees, k, seed)
    width = max(1, -(-total // buckets))
    owned = running_total(degrees.filter("degree > 0").select("ord", "id", "degree"), "ord", "degree").withColumn("hi", F.col("lo") + F.col("degree"))
    owned = owned.select("id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("b"))
    draws = spark.range(k).select(F.col("id").alias("draw_id"), below(F.lit(total), seed, F.col("id"), "start").alias("u")).withColumn("b", F.floor(F.col("u") / width))
    return draws.join(owned, "b").filter("u >= lo and u < hi").select("draw_id", F.col("id").alias("start"))


def sample_uniform(spark: SparkSession, nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """draw_id and start of k draws, all nodes (ord, id) alike; an empty table gives no draws."""
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "draw_id long, start string")
    places = ranked(nodes.select("ord", "id"), "ord", "place")
    draws = spark.range(k).select(F.col("id").alias("draw_id"), below(F.lit(n), seed, F.col("id"), "start").alias("place"))
    return draws.join(places, "place").select("draw_id", F.col("id").alias("start"))


def sample_starts(spark: SparkSession, degrees: DataFrame, strategy: str, k: int, seed: int = 42) -> DataFrame:
    if strategy not in ("frequency_weighted", "random"):
        raise ValueError(f"unknown sampling strategy: {strategy}")
    return (sample_weighted if strategy == "frequency_weighted" else sample_uniform)(spark, degrees, k, seed)
