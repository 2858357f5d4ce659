"""Few walks over a large graph: neither walks nor runs copy or shuffle the whole of it."""

from pyspark.sql import functions as F

from pathloom.model import EDGES, NODES, TIERS
from pathloom.operators import walk
from pathloom.plans import catalog, generate

SF = "/root/testdata/sf0.001"


def _spied(monkeypatch, module):
    names = []
    monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append((name, f(df, name))) or names[-1][1])
    return names


def test_a_step_numbers_the_successors_of_few_nodes(spark, monkeypatch):
    edges = catalog.trade_graph(spark, SF)[1]
    draws = spark.range(3).select(F.col("id").alias("draw_id"), F.concat(F.lit("R"), F.col("id")).alias("start"))
    spied = _spied(monkeypatch, walk)
    few = {r.draw_id: r.nodes for r in walk.random_walks(draws, edges, max_hops=3).collect()}
    assert all(df.count() < 200 for name, df in spied if name == "steps")
    monkeypatch.setattr(walk, "FEW", 0)
    assert {r.draw_id: r.nodes for r in walk.random_walks(draws, edges, max_hops=3).collect()} == few


def test_stored_graphs_are_not_copied_and_degrees_counted_once(spark, monkeypatch):
    spied = _spied(monkeypatch, generate)
    nodes = spark.createDataFrame([(0, "a", []), (1, "b", [])], NODES)
    edges = spark.createDataFrame([(0, "a", "b", [])], EDGES)
    assert len(generate.autotune(spark, nodes, edges, 2, tiers=TIERS[:2], stored=True).tiers) == 2
    names = [name for name, _ in spied]
    assert names.count("degrees") == 1 and not {"graph", "nodes", "edges"} & set(names)
