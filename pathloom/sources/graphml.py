"""GraphML files as node and edge DataFrames, and back."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.graph import collapse_edges, upsert_nodes

_DATA = "array<struct<_key string, _VALUE string>>"
_KEY = "_id string, _for string, `_attr.name` string, `_attr.type` string, default string"


def _bag(data: Column, keys: Column, domain: str, own_id: Column | None = None) -> Column:
    """The attributes of one element: declared keys give names and types, missing ones defaults, undeclared ones stand for themselves."""
    mine = F.filter(keys, lambda k: F.coalesce(k["_for"], F.lit("all")).isin(domain, "all"))

    def attribute(d: Column) -> Column:
        key = F.get(F.filter(mine, lambda k: k["_id"] == d["_key"]), F.lit(0))
        return F.struct(F.coalesce(key["_attr.name"], d["_key"]).alias("key"), d["_VALUE"].alias("value"), F.coalesce(key["_attr.type"], F.lit("string")).alias("type"))

    empty = F.expr("CAST(array() AS array<struct<key:string,value:string,type:string>>)")
    listed = F.coalesce(F.transform(data, attribute), empty)
    given = F.coalesce(F.transform(data, lambda d: d["_key"]), F.expr("CAST(array() AS array<string>)"))
    defaults = F.transform(F.filter(mine, lambda k: k["default"].isNotNull() & ~F.array_contains(given, k["_id"])), lambda k: F.struct(k["_attr.name"].alias("key"), k["default"].alias("value"), F.coalesce(k["_attr.type"], F.lit("string")).alias("type")))
    bag = F.concat(listed, F.coalesce(defaults, empty))
    if own_id is None:
        return bag
    return F.when(own_id.isNotNull(), F.concat(F.array(F.struct(F.lit("id").alias("key"), own_id.alias("value"), F.lit("string").alias("type"))), bag)).otherwise(bag)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a file in document order; a missing file is an error, an undirected edge keeps its direction.

    Nodes and ordered pairs that occur again take the attributes of their last occurrence and the place of their first. Every
    element is a row of its own, so that no row grows with the file; only the declared keys reach the driver."""

    def elements(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)

    declared = [tuple(k) for k in elements("key", _KEY).collect()]
    one = spark.createDataFrame([(declared,)], f"keys array<struct<{_KEY}>>").withColumn("_k", F.lit(1))
    # a file is read by one task from its start to its end, so that ids grow with the place in it
    place = F.monotonically_increasing_id().alias("ord")
    n = elements("node", f"_id string, data {_DATA}").select(place, "*", F.lit(1).alias("_k")).join(F.broadcast(one), "_k")
    e = elements("edge", f"_id string, _source string, _target string, data {_DATA}").select(place, "*", F.lit(1).alias("_k")).join(F.broadcast(one), "_k")
    nodes = n.select("ord", F.col("_id").alias("id"), _bag(F.col("data"), F.col("keys"), "node").alias("attrs"))
    edges = e.select("ord", F.col("_source").alias("src"), F.col("_target").alias("dst"), _bag(F.col("data"), F.col("keys"), "edge", F.col("_id")).alias("attrs"))
    return upsert_nodes(nodes), collapse_edges(edges)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file on the driver, row by row; every attribute name and type of a domain becomes a key."""
    key_ids: dict[tuple[str, str, str], str] = {}
    for domain, df in (("node", nodes), ("edge", edges)):
        for r in df.select(F.explode("attrs").alias("a")).select("a.key", "a.type").distinct().orderBy("key", "type").collect():
            key_ids[domain, r.key, r.type] = f"d{len(key_ids)}"

    def data(domain: str, attrs: list) -> str:
        return "".join(f'<data key="{key_ids[domain, a.key, a.type]}">{escape(a.value or "")}</data>' for a in attrs)

    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for (domain, name, kind), key in key_ids.items():
            out.write(f'<key id="{key}" for="{domain}" attr.name={quoteattr(name)} attr.type="{kind}"/>\n')
        out.write('<graph edgedefault="directed">\n')
        for r in nodes.orderBy("ord").toLocalIterator():
            out.write(f"<node id={quoteattr(r.id)}>{data('node', r.attrs)}</node>\n")
        for r in edges.orderBy("ord").toLocalIterator():
            out.write(f"<edge source={quoteattr(r.src)} target={quoteattr(r.dst)}>{data('edge', r.attrs)}</edge>\n")
        out.write("</graph>\n</graphml>\n")
