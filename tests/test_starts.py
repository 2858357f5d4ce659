"""Queries that start from every node of the trade graph, by brute force."""

import pytest

from pathloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trade(spark):
    nodes, edges = catalog.trade_graph(spark, SF)
    out = {}
    for r in edges.select("src", "dst").distinct().collect():
        out.setdefault(r.src, set()).add(r.dst)
    return sorted(r.id for r in nodes.select("id").collect()), out


def test_neighbors_of_every_node(spark, trade):
    ids, out = trade
    expected = set()
    for start in ids:
        seen, last = {start}, {start}
        for hop in (1, 2, 3):
            last = {d for n in last for d in out.get(n, ())} - seen
            seen |= last
            expected |= {(start, n, hop) for n in last}
    rows = [(r.start, r.id, r.hop) for r in catalog.khop_neighbors(spark, SF).collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert {s[0] for s, _, _ in rows} == set("RNSP")


def test_maximal_paths_of_every_node(spark, trade):
    ids, out = trade
    expected, stack = set(), [(i,) for i in ids]
    while stack:
        path = stack.pop()
        more = [d for d in out.get(path[-1], ()) if d not in path]
        stack += [(*path, d) for d in more]
        if not more and len(path) > 1:
            expected.add((path[0], ">".join(path), len(path)))
    rows = [(r.start, r.path, r.length) for r in catalog.maximal_paths(spark, SF).collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert {s[0] for s, _, _ in rows} == set("RNSP")
