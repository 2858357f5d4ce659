"""Small graphs that come along, to try the engine without a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.model import EDGES, NODES

#: For each sample its edges as (from, relationship, to); a name before a colon is the node's type.
SAMPLES = {
    "orchard": (
        ("tree: Apple tree", "BEARS", "fruit: Apple"), ("tree: Pear tree", "BEARS", "fruit: Pear"), ("insect: Honey bee", "POLLINATES", "tree: Apple tree"),
        ("insect: Honey bee", "POLLINATES", "tree: Pear tree"), ("fruit: Apple", "PRESSED_INTO", "drink: Cider"), ("fruit: Pear", "PRESSED_INTO", "drink: Perry"),
        ("insect: Codling moth", "DAMAGES", "fruit: Apple"), ("bird: Blue tit", "EATS", "insect: Codling moth"), ("drink: Cider", "FERMENTED_WITH", "yeast: Wine yeast"),
    ),
    "workshop": (
        ("tool: Plane", "SMOOTHS", "material: Oak"), ("tool: Chisel", "CUTS", "joint: Mortise"), ("joint: Mortise", "FITS", "joint: Tenon"), ("joint: Tenon", "MADE_OF", "material: Oak"),
        ("tool: Whetstone", "SHARPENS", "tool: Chisel"), ("tool: Whetstone", "SHARPENS", "tool: Plane"), ("finish: Linseed oil", "PROTECTS", "material: Oak"), ("joint: Tenon", "HELD_BY", "adhesive: Hide glue"),
    ),
    "makeup": (
        ("skin: Dry skin", "looks_best_with", "finish: Dewy"), ("skin: Oily skin", "looks_best_with", "finish: Matte"), ("finish: Matte", "avoid", "product: Face oil"), ("finish: Dewy", "needs", "product: Moisturizer"),
        ("product: Primer", "pairs_with", "product: Foundation"), ("product: Moisturizer", "goes_under", "product: Primer"), ("product: Foundation", "applied_by", "technique: Stippling"),
    ),
}


def sample_graph(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a sample."""
    ids = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for a, _, b in SAMPLES[name] for x in (a, b)))}
    bag = lambda n: [(k, v, "string") for k, v in zip(("type", "name"), n.split(": "), strict=True)]
    nodes = spark.createDataFrame([(i, node, bag(n)) for i, (n, node) in enumerate(ids.items())], NODES)
    return nodes, spark.createDataFrame([(i, ids[a], ids[b], [("relationship", r, "string")]) for i, (a, r, b) in enumerate(SAMPLES[name])], EDGES)
