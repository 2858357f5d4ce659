"""Edges by the nodes that they leave, and what is read and aggregated to find those of few walks."""

import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import graph, render, walk
from pathloom.plans import catalog
from pathloom.sources import tables

SF = "/root/testdata/sf0.001"


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ids", [["R1", "N3", "S2", "S5", "P7", "B12", "C4"], ["P7", "P8"], ["B12", "C4"], ["S2", "S02", "Sx", "S", "", "zz", None, "N3 "]])
def test_edges_that_leave_nodes(spark, ids):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    found = tables.trade_edges_leaving(spark, SF)(nodes)
    expected = tables.trade_edges(spark, SF).filter(F.col("src").isin([i for i in ids if i]))
    assert found.columns == expected.columns and found.dtypes == expected.dtypes
    assert sorted(found.collect()) == sorted(expected.collect())
    assert ("l_suppkey" in _optimized(found)) == any(i and i[0] == "S" for i in ids)


def test_no_step_compares_ids_of_all_line_items(spark, monkeypatch):
    """A walk over parts and brands reads no line items; one from suppliers compares keys."""
    plans, real = [], walk.written
    monkeypatch.setattr(walk, "written", lambda df, name: plans.append(_optimized(df)) or real(df, name))
    monkeypatch.setattr(catalog, "_weighted", lambda spark, sf_dir: spark.createDataFrame([(0, "P1"), (1, "P2")], "draw_id long, start string"))
    assert {r.path.split(">")[0][0] + r.path.split(">")[1][0] for r in catalog.random_walk(spark, SF).collect()} == {"PB"}
    assert not any("l_suppkey" in p for p in plans)


def _below_aggregate_of_lines(plan):
    """The lines of the plan from the aggregate over line items to their table."""
    lines = plan.split("\n")
    table = next(i for i, line in enumerate(lines) if re.search(r"Relation \[.*l_suppkey", line))
    top = max(i for i in range(table) if re.search(r"\bAggregate \[", lines[i]))
    return lines[top:table]


@pytest.mark.parametrize("leaving", [True, False])
def test_rendering_collapses_no_edge_off_the_walks(spark, leaving):
    walks = spark.createDataFrame([(0, "N1", ["N1", "S1", "P0"], 3)], "draw_id long, start string, nodes array<string>, length int")
    nodes, edges = catalog.trade_graph(spark, SF)
    s = edges.filter("src like 'S%'").orderBy("src", "dst").first()
    walks = walks.withColumn("nodes", F.array(F.lit("N1"), F.lit(s.src), F.lit(s.dst)))
    found = render.render_paths(walks, nodes, edges, tables.trade_edges_leaving(spark, SF) if leaving else None)
    assert any("LeftSemi" in line for line in _below_aggregate_of_lines(_optimized(found)))
    resolved = render.render_paths(walks, graph.resolved_nodes(nodes), graph.resolved_edges(edges))
    assert found.collect() == resolved.collect()


def test_ranges_by_few_comparisons(spark):
    rows = spark.range(0, 5000).select((F.col("id") * F.col("id")).alias("k"))
    found = graph.in_ranges(rows, "k", 64)
    bounds = sorted(set(rows.approxQuantile("k", [i / 64 for i in range(1, 64)], 0.001)))
    assert all(r._p == sum(r.k > b for b in bounds) for r in found.collect())
    assert len({r._p for r in found.select("_p").distinct().collect()}) == len(bounds) + 1
    deepest = depth = 0
    for word in re.findall(r"CASE|END", found._jdf.queryExecution().analyzed().toString()):
        depth += 1 if word == "CASE" else -1
        deepest = max(deepest, depth)
    assert 0 < deepest <= 7
