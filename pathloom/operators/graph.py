"""Graph operators: upserts, degrees, neighbours, capacity, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import resolve
from pathloom.functions.draws import uniform
from pathloom.operators.scratch import written

#: Colours of the node export.
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#9c755f")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the attributes of its last row at the place of its first."""
    return nodes.groupBy("id").agg(F.min("ord").alias("ord"), F.max_by("attrs", "ord").alias("attrs")).select("ord", "id", "attrs")


def collapse_edges(edges: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """One row per ordered pair of ends: the attributes of its last row (of equal ones the greatest bag) at the place of its first."""
    return edges.groupBy(*ends).agg(F.min("ord").alias("ord"), F.max(F.struct("ord", "attrs"))["attrs"].alias("attrs")).select("ord", *ends, "attrs")


def resolved_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("ord", "id", resolve.node_label(F.col("attrs"), F.col("id")).alias("label"), resolve.node_description(F.col("attrs")).alias("description"))


def resolved_edges(edges: DataFrame) -> DataFrame:
    return edges.select("ord", "src", "dst", resolve.edge_relationship(F.col("attrs")).alias("relationship"), resolve.edge_reasoning(F.col("attrs")).alias("reasoning"))


def adjacency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with src_ord: sorted by src_ord and ord they are grouped by source, sources in node order."""
    return edges.join(nodes.select(F.col("id").alias("src"), F.col("ord").alias("src_ord")), "src", "left")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, id, degree, out_degree and in_degree of every node; a self-loop counts twice."""
    ends = edges.select(F.stack(F.lit(2), F.col("src"), F.lit(1), F.col("dst"), F.lit(0)).alias("id", "o"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("o").alias("out_degree"))
    joined = nodes.select("ord", "id").join(counts, "id", "left").na.fill(0, ["degree", "out_degree"])
    return joined.select("ord", "id", "degree", "out_degree", (F.col("degree") - F.col("out_degree")).alias("in_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, total, maximal (1 without edges) and average degree, capacity estimate."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total_degree"), F.greatest(F.coalesce(F.max("degree"), F.lit(0)), F.lit(1)).alias("max_degree"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    one = d.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k")
    average = F.when(F.col("n_nodes") == 0, 0.0).otherwise(2.0 * F.col("n_edges") / F.col("n_nodes"))
    return one.select("n_nodes", "n_edges", "total_degree", "max_degree", average.alias("avg_degree"), (F.greatest("n_nodes", "n_edges") * 2).alias("capacity"))


def neighbors(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """start, id and hop for the nodes whose shortest distance along edges from each start (column id) is 1 to depth.

    A start is not its own neighbour; one without edges, known or not, has none. Each round is written, so that plans stay short."""
    steps = written(edges.select("src", "dst").distinct(), "steps")  # every round reads them
    seen = written(starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("hop")).distinct(), "hop")
    last = seen
    for hop in range(1, depth + 1):
        reached = last.join(steps, last["id"] == steps["src"]).select("start", F.col("dst").alias("id")).distinct()
        last = written(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(last)
    return seen.filter("hop > 0")


def successors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start and id for the direct successors of each start (column id), itself among them where it has a self-loop."""
    known = starts.select(F.col("id").alias("start")).distinct()
    return edges.select(F.col("src").alias("start"), F.col("dst").alias("id")).distinct().join(known, "start", "left_semi")


def in_ranges(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """df with _p, the number of the range of about equal ranges of `order` that a row is in.

    A row is compared with as many bounds as a binary search takes; to add up comparisons with all of them took far longer."""
    bounds = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col(order) > bounds[middle], search(middle + 1, hi)).otherwise(search(lo, middle))

    return df.withColumn("_p", search(0, len(bounds)))


def ranked(df: DataFrame, order: str, name: str, buckets: int = 64) -> DataFrame:
    """df with the dense rank from 0 of its distinct longs `order` as `name`.

    Ranges of the column are ranked each by itself and shifted by the sizes of those before, so that no task sorts all rows."""
    parts = in_ranges(df, order, buckets)
    sizes = parts.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn("_r", within).join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_b") + F.col("_r")).cast("long")).drop("_p", "_b", "_r")


def node_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label, size (15 to 35 by degree), colour and tooltip of every node."""
    bags, labels = nodes.select("id", "attrs"), resolved_nodes(nodes).select("id", "label")
    d = degrees(nodes, edges)
    top = d.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(0)), F.lit(1)).alias("m")).withColumn("_k", F.lit(1))
    rows = d.join(bags, "id").join(labels, "id").withColumn("_k", F.lit(1)).join(F.broadcast(top), "_k")
    rest = F.transform(F.filter("attrs", lambda a: ~a.key.isin(*resolve.LABELS)), lambda a: F.concat(F.lit("<br>"), a.key, F.lit(": "), F.coalesce(a.value, F.lit(""))))
    tip = F.concat(F.lit("<b>"), "label", F.lit("</b><br>ID: "), "id", F.lit("<br>Connections: "), F.col("degree").cast("string"), F.array_join(rest, ""))
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (uniform(F.col("id")) % len(PALETTE) + 1).cast("int"))
    return rows.select("id", "label", (F.lit(15.0) + F.lit(20.0) * F.col("degree") / F.col("m")).alias("size"), colour.alias("colour"), tip.alias("tooltip"))


def edge_export(edges: DataFrame) -> DataFrame:
    """src, dst, relationship and tooltip of every edge."""
    rest = F.transform(F.filter("attrs", lambda a: ~a.key.isin(*resolve.RELATIONSHIPS)), lambda a: F.concat(F.lit("<br>"), a.key, F.lit(": "), F.coalesce(a.value, F.lit(""))))
    relation = resolve.edge_relationship(F.col("attrs"))
    return edges.select("src", "dst", relation.alias("relationship"), F.concat(F.lit("<b>"), relation, F.lit("</b>"), F.array_join(rest, "")).alias("tooltip"))


def preview(nodes: DataFrame, edges: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows of nodes and of edges as text: kind, ord, line. The number of rows is the feature."""
    n = resolved_nodes(nodes).orderBy("ord").limit(rows).select(F.lit("node").alias("kind"), "ord", F.col("label").alias("line"))
    e = resolved_edges(edges).orderBy("ord").limit(rows)
    labels = resolved_nodes(nodes).select("id", "label")
    named = e.join(labels.toDF("src", "a"), "src", "left").join(labels.toDF("dst", "b"), "dst", "left")
    return n.unionByName(named.select(F.lit("edge").alias("kind"), "ord", F.concat(F.coalesce("a", "src"), F.lit(" → ["), "relationship", F.lit("] → "), F.coalesce("b", "dst")).alias("line")))
