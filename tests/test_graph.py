import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import resolve
from pathloom.functions.draws import below
from pathloom.model import EDGES, NODES
from pathloom.operators import dedup, graph, render, sample, walk
from pathloom.sources import graphml


def _nodes(spark, bags):
    return spark.createDataFrame([(i, n, [(k, v, t) for k, v, t in bag]) for i, (n, bag) in enumerate(bags.items())], NODES)


def _edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, []) for i, (a, b) in enumerate(pairs)], EDGES)


S = "string"


@pytest.mark.parametrize(
    ("bag", "label"),
    [(([(n, "x", S), ("other", "y", S)]), "x") for n in resolve.LABELS]
    + [
        ([("name", "", S), ("title", "T", S)], "T"),
        ([("name", "0", "int"), ("foo", "F", S)], "F"),
        ([("name", "0.0", "double"), ("value", "false", "boolean")], "id1"),
        ([("value", "7", "long")], "7"),
        ([("type", "t", S), ("color", "c", S)], "id1"),
        ([("size", "3", "double"), ("foo", "F", S), ("bar", "B", S)], "F"),
        ([], "id1"),
    ],
)
def test_labels(spark, bag, label):
    assert graph.resolved_nodes(_nodes(spark, {"id1": bag})).first().label == label


@pytest.mark.parametrize(
    ("bag", "relationship"),
    [([(n, "x", S)], "x") for n in resolve.RELATIONSHIPS] + [([("weight", "2", S)], "RELATED_TO"), ([("weight", "2", S), ("custom", "C", S)], "C"), ([], "RELATED_TO")],
)
def test_relationships(spark, bag, relationship):
    edges = spark.createDataFrame([(0, "a", "b", bag)], EDGES)
    assert graph.resolved_edges(edges).first().relationship == relationship


@pytest.mark.parametrize(("bag", "description"), [([("description", "", S), ("desc", "x", S)], ""), ([("desc", "x", S)], "x"), ([], ""), ([("description", "d", S)], "d")])
def test_descriptions(spark, bag, description):
    assert graph.resolved_nodes(_nodes(spark, {"a": bag})).first().description == description


def test_upserts_keep_the_last_attributes_at_the_first_place(spark):
    nodes = spark.createDataFrame([(0, "a", [("name", "old", S)]), (1, "b", []), (2, "a", [("name", "new", S)])], NODES)
    assert [(r.ord, r.id, r.label) for r in graph.resolved_nodes(graph.upsert_nodes(nodes)).orderBy("ord").collect()] == [(0, "a", "new"), (1, "b", "b")]
    edges = spark.createDataFrame([(0, "a", "b", [("label", "old", S)]), (1, "a", "b", [("label", "new", S)])], EDGES)
    assert [(r.ord, r.relationship) for r in graph.resolved_edges(graph.collapse_edges(edges)).collect()] == [(0, "new")]


def test_degrees_and_stats(spark):
    nodes, edges = _nodes(spark, {"a": [], "b": [], "c": []}), _edges(spark, [("a", "a"), ("a", "b")])
    assert {r.id: (r.degree, r.out_degree, r.in_degree) for r in graph.degrees(nodes, edges).collect()} == {"a": (3, 2, 1), "b": (1, 0, 1), "c": (0, 0, 0)}
    r = graph.graph_stats(nodes, edges).first()
    assert (r.n_nodes, r.n_edges, r.total_degree, r.max_degree, r.capacity) == (3, 2, 4, 3, 6)
    assert r.avg_degree == pytest.approx(4 / 3)
    empty = graph.graph_stats(_nodes(spark, {"a": []}).limit(0), _edges(spark, [("a", "b")]).limit(0)).first()
    assert (empty.n_nodes, empty.max_degree, empty.avg_degree) == (0, 1, 0.0)


def test_neighbors_by_shortest_distance(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")])
    found = graph.neighbors(edges, _nodes(spark, {"a": [], "z": []}), 3).collect()
    assert {(r.start, r.id): r.hop for r in found} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}


def test_draws_follow_degrees(spark):
    nodes, edges = _nodes(spark, {c: [] for c in "abcde"}), _edges(spark, [("a", b) for b in "bcd"])
    d = graph.degrees(nodes, edges)
    found = {r.start: r["count"] for r in sample.sample_weighted(spark, d, 6000).groupBy("start").count().collect()}
    assert sum(found.values()) == 6000 and "e" not in found
    for n, weight in {"a": 3, "b": 1, "c": 1, "d": 1}.items():
        assert abs(found[n] - 1000 * weight) < 150
    uniform = {r.start: r["count"] for r in sample.sample_starts(spark, d, "random", 5000).groupBy("start").count().collect()}
    assert set(uniform) == set("abcde") and all(abs(n - 1000) < 150 for n in uniform.values())
    alone = graph.degrees(nodes, edges.limit(0))
    assert sample.sample_weighted(spark, alone, 50).count() == 50
    assert sample.sample_weighted(spark, alone.limit(0), 50).count() == 0
    with pytest.raises(ValueError):
        sample.sample_starts(spark, d, "other", 1)


def test_walks_are_simple_and_maximal(spark):
    rng = random.Random(1)
    pairs = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)})
    edges = _edges(spark, pairs)
    draws = spark.range(60).select(F.col("id").alias("draw_id"), F.concat(F.lit("n"), F.col("id") % 12).alias("start"))
    walks = walk.random_walks(draws, edges).collect()
    paths = {tuple(r.nodes) for r in walk.maximal_paths(edges, draws.select(F.col("start").alias("id")).distinct()).collect()}
    assert len(walks) == 60
    for r in walks:
        assert len(set(r.nodes)) == len(r.nodes) == r.length
        assert r.length == 1 or tuple(r.nodes) in paths
    capped = walk.random_walks(draws, edges, max_hops=1).collect()
    assert len(capped) == 60 and max(r.length for r in capped) <= 2


def _scan(rows, threshold):
    kept = []
    for d, nodes in sorted(rows):
        a = set(nodes)
        if not any(len(a & b) / len(a | b) >= threshold for _, b in kept):
            kept.append((d, a))
    return {d for d, _ in kept}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.6, 0.95, 1.0, 1.1])
def test_dedup_is_the_ordered_scan(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = [(i, [str(x) for x in rng.sample(range(9), rng.randint(2, 5))]) for i in range(60)]
    paths = spark.createDataFrame(rows, "draw_id long, nodes array<string>")
    expected = {0} if threshold <= 0 else _scan(rows, threshold)
    assert {r.draw_id for r in dedup.greedy_dedup(paths, threshold).collect()} == expected
    if 0 < threshold <= 1:
        assert {r.draw_id for r in dedup.ordered_fold(paths, threshold).collect()} == expected


def test_rendering(spark):
    nodes = _nodes(spark, {"a": [("name", "A", S), ("description", "first", S)], "b": [("name", "B", S)]})
    edges = spark.createDataFrame([(0, "a", "b", [("label", "likes", S), ("reasoning", "so", S)])], EDGES)
    walks = spark.createDataFrame([(0, "a", ["a", "b"], 2)], "draw_id long, start string, nodes array<string>, length int")
    r = render.render_paths(walks, graph.resolved_nodes(nodes), graph.resolved_edges(edges)).first()
    assert r.path_str == "A -[likes]-> B"
    assert r.rich_context == "  [A] - first\n    --(likes)--> (Reasoning: so)\n  [B]"


def test_graphml_round_trip(spark, tmp_path):
    nodes = _nodes(spark, {"a&b": [("name", "<A>", S), ("size", "1.5", "double")], "c": []})
    edges = spark.createDataFrame([(0, "a&b", "c", [("label", 'x "y"', S)])], EDGES)
    graphml.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = graphml.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert [tuple(r) for r in n.orderBy("ord").collect()] == [tuple(r) for r in nodes.orderBy("ord").collect()]
    assert [tuple(r) for r in e.collect()] == [tuple(r) for r in edges.collect()]


def test_successors_keep_self_loops(spark):
    edges = spark.createDataFrame([(0, "a", "a", []), (1, "a", "b", []), (2, "a", "b", [])], EDGES)
    nodes = spark.createDataFrame([(0, "a", []), (1, "b", [])], NODES)
    assert sorted((r.start, r.id) for r in graph.successors(edges, nodes).collect()) == [("a", "a"), ("a", "b")]


def test_draws_below_large_numbers(spark):
    n = 3 * 2**31
    rows = [r.u for r in spark.range(4000).select(below(F.lit(n), 42, F.col("id"), "start").alias("u")).collect()]
    assert all(0 <= u < n for u in rows) and abs(sum(rows) / len(rows) / n - 0.5) < 0.02 and len(set(rows)) == 4000
