"""A property graph over trade tables: regions, nations, suppliers, customers, parts and brands.

Attribute names vary by kind of node, so that every step of label resolution is used; nations border each other in rings,
so that the graph has cycles; a region trades within itself, a self-loop; a supplier and a part that meet in several line items keep the last one's attributes."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.model import ATTRS
from pathloom.operators.graph import collapse_edges


def _attrs(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit("string").alias("type")) for k, v in values.items()))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = [
        t("region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("R"), "r_regionkey").alias("id"), _attrs(name=F.col("r_name"), type=F.lit("region")).alias("attrs")),
        t("nation").select(F.col("n_nationkey"), F.concat(F.lit("N"), "n_nationkey"), _attrs(type=F.lit("nation"), label=F.col("n_name"))),
        t("supplier").select(F.col("s_suppkey"), F.concat(F.lit("S"), "s_suppkey"), _attrs(name=F.lit(""), title=F.col("s_name"), description=F.lit(""), desc=F.lit("unused"))),
        t("customer").select(F.col("c_custkey"), F.concat(F.lit("C"), "c_custkey"), _attrs(type=F.lit("customer"), segment=F.col("c_mktsegment"), desc=F.col("c_name"))),
        t("part").select(F.col("p_partkey"), F.concat(F.lit("P"), "p_partkey"), _attrs(display_name=F.col("p_name"), description=F.concat(F.lit("a part of type "), "p_type"))),
        t("part").select(F.substring_index("p_brand", "#", -1).cast("long").alias("k"), F.concat(F.lit("B"), F.substring_index("p_brand", "#", -1)), _attrs(type=F.lit("brand"), color=F.lit("none"))).distinct(),
    ]
    out = None
    for rank, df in enumerate(kinds):
        part = df.toDF("k", "id", "attrs").select((F.lit(rank) * F.lit(10**12) + F.col("k")).cast("long").alias("ord"), "id", "attrs")
        out = part if out is None else out.unionByName(part)
    return out


def _by_id(lines: DataFrame) -> DataFrame:
    return lines.select("ord", F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), "attrs")


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from supplier to part for every line item: pairs repeat."""
    return _by_id(_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def _lines(lines: DataFrame) -> DataFrame:
    """The same by the keys of supplier and part, which are cheaper to compare than ids."""
    order = F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")
    return lines.select(order.alias("ord"), "l_suppkey", "l_partkey", _attrs(weight=F.col("l_quantity").cast("int"), predicate=F.when(F.col("l_returnflag") == "R", "SUPPLIED_BACK").otherwise("SUPPLIES"), reasoning=F.concat(F.lit("line status "), "l_linestatus")).alias("attrs"))


#: From the name of a table to its rows.
Tables = Callable[[str], DataFrame]


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def trade_edges_leaving(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """A function from few nodes (column id), which are sent to every task, to those of trade_edges() that leave them.

    Keys are compared before ids are made of them, and a table is not read where none of its sources is there."""
    read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return lambda nodes: _edges(read, nodes)


def _edges(t: Tables, leaving: DataFrame | None = None) -> DataFrame:
    def borders() -> DataFrame:
        ring = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
        first = F.first("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
        return t("nation").withColumn("next", F.coalesce(F.lead("n_nationkey").over(ring), first)).filter("next <> n_nationkey")

    # kind of the sources, column of their keys, rows, edges of these
    kinds = [
        ("R", "n_regionkey", lambda: t("nation"), lambda df: df.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "n_nationkey"), _attrs(label=F.lit("HAS_NATION")))),
        ("N", "n_nationkey", borders, lambda df: df.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("N"), "next"), _attrs(relationship=F.lit("BORDERS")))),
        ("N", "s_nationkey", lambda: t("supplier"), lambda df: df.select("s_suppkey", F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("S"), "s_suppkey"), _attrs(type=F.lit("HOSTS"), weight=F.lit("1")))),
        ("N", "c_nationkey", lambda: t("customer"), lambda df: df.select("c_custkey", F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("C"), "c_custkey"), _attrs(weight=F.lit("1"), custom=F.lit("HOME_OF")))),
        ("S", "l_suppkey", lambda: t("lineitem"), lambda df: _by_id(collapse_edges(_lines(df), ("l_suppkey", "l_partkey")))),
        ("P", "p_partkey", lambda: t("part"), lambda df: df.select("p_partkey", F.concat(F.lit("P"), "p_partkey"), F.concat(F.lit("B"), F.substring_index("p_brand", "#", -1)), _attrs(color=F.lit("none")))),
        ("R", "r_regionkey", lambda: t("region"), lambda df: df.select("r_regionkey", F.concat(F.lit("R"), "r_regionkey"), F.concat(F.lit("R"), "r_regionkey"), _attrs(connection_type=F.lit("TRADES_WITHIN")))),
    ]
    there = None if leaving is None else {r[0] for r in leaving.select(F.substring("id", 1, 1)).distinct().collect()}
    out = None
    for rank, (kind, key, rows, made) in enumerate(kinds):
        if there is not None and kind not in there:
            continue
        df = rows()
        if leaving is not None:
            keys = leaving.select(F.substring("id", 2, 20).try_cast("long").alias(key), "id").filter(F.concat(F.lit(kind), key) == F.col("id"))
            df = df.join(F.broadcast(keys.select(key)), key, "left_semi")
        part = made(df).toDF("k", "src", "dst", "attrs").select((F.lit(rank) * F.lit(10**15) + F.col("k")).cast("long").alias("ord"), "src", "dst", "attrs")
        out = part if out is None else out.unionByName(part)
    return leaving.sparkSession.range(0).select(F.col("id").alias("ord"), *(F.lit(None).cast(kind).alias(c) for c, kind in (("src", "string"), ("dst", "string"), ("attrs", ATTRS)))) if out is None else out
