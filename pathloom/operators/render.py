"""Paths as text: the one-line form and the context with descriptions and reasoning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import resolved_edges, resolved_nodes
from pathloom.operators.scratch import written
from pathloom.operators.walk import Leaving

#: So many steps of walks are sent to every task at most, to keep only their nodes and edges; more are joined by shuffle.
FEW = 1_000_000


def render_paths(walks: DataFrame, nodes: DataFrame, edges: DataFrame, leaving: Leaving | None = None) -> DataFrame:
    """draw_id, start, nodes, length, path_str and rich_context of walks, from nodes and edges, resolved or not.

    path_str is `A -[rel]-> B -[rel]-> C`. rich_context has a line `  [label] - description` for each node and
    `    --(rel)--> (Reasoning: text)` for each edge; empty descriptions and reasons leave no trace.
    Where the walks are few, nodes and edges that are on none of them are dropped before anything shuffles or aggregates them;
    that takes unresolved ones, as Spark moves no filter below the functions that resolve. `leaving` is that of random_walks."""
    walks = written(walks.select("draw_id", "start", "nodes", "length"), "rendered")
    steps = walks.select("draw_id", F.posexplode("nodes").alias("pos", "id"), F.col("nodes"))
    steps = steps.select("draw_id", "pos", "id", F.get("nodes", F.col("pos") + 1).alias("next"))
    if (walks.agg(F.sum(F.size("nodes"))).first()[0] or 0) <= FEW:
        met = written(steps.select(F.col("id").alias("src"), F.col("next").alias("dst")).distinct(), "met")
        nodes = nodes.join(F.broadcast(met.select(F.col("src").alias("id")).distinct()), "id", "left_semi")
        edges = (leaving(met.select(F.col("src").alias("id")).distinct()) if leaving else edges).join(F.broadcast(met), ["src", "dst"], "left_semi")
    nodes = resolved_nodes(nodes) if "attrs" in nodes.columns else nodes
    edges = resolved_edges(edges) if "attrs" in edges.columns else edges
    named = steps.join(nodes.select("id", "label", "description"), "id", "left")
    named = named.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("next"), "relationship", "reasoning"), ["id", "next"], "left")
    label, relation = F.coalesce("label", "id"), F.coalesce("relationship", F.lit("RELATED_TO"))
    more = F.col("next").isNotNull()
    line = F.concat(F.lit("  ["), label, F.lit("]"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description")).otherwise(""))
    arrow = F.concat(F.lit("    --("), relation, F.lit(")-->"), F.when(F.coalesce("reasoning", F.lit("")) != "", F.concat(F.lit(" (Reasoning: "), "reasoning", F.lit(")"))).otherwise(""))
    parts = named.select(
        "draw_id", "pos",
        F.concat(label, F.when(more, F.concat(F.lit(" -["), relation, F.lit("]-> "))).otherwise("")).alias("s"),
        F.when(more, F.concat(line, F.lit("\n"), arrow)).otherwise(line).alias("c"),
    )
    whole = parts.groupBy("draw_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "c"))).alias("p"))
    text = whole.select("draw_id", F.array_join(F.col("p.s"), "").alias("path_str"), F.array_join(F.col("p.c"), "\n").alias("rich_context"))
    return walks.select("draw_id", "start", "nodes", "length").join(text, "draw_id")
