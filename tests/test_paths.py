"""Maximal paths that are put together from beginnings and tails, by brute force and by what is written on the way."""

import random
from collections import Counter

import pytest

from pathloom.model import EDGES
from pathloom.operators import walk


def _edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, []) for i, (a, b) in enumerate(pairs)], EDGES)


def _starts(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _all_paths(pairs, starts, max_hops):
    out, found = {}, Counter()
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    stack = [(s,) for s in starts]
    while stack:
        path = stack.pop()
        more = [d for d in out.get(path[-1], ()) if d not in path]
        if more and len(path) <= max_hops:
            stack += [(*path, d) for d in more]
        elif len(path) > 1:
            found[path] += 1
    return found


@pytest.mark.parametrize(("seed", "max_hops", "share"), [(1, 999, 1), (2, 999, 3), (3, 3, 1), (4, 2, 2)])
def test_paths_through_cycles_and_beyond_them(spark, seed, max_hops, share):
    rng = random.Random(seed)
    ring = [(f"c{i}", f"c{(i + 1) % 4}") for i in range(4)] + [("c0", "c0"), ("c2", "c0")]
    pairs = [*ring, *((f"c{rng.randrange(4)}", f"f{rng.randrange(12)}") for _ in range(8))]
    pairs += [(f"f{a}", f"f{b}") for a, b in (sorted(rng.sample(range(12), 2)) for _ in range(16))] + [("f3", "f3"), ("loop", "loop"), *ring[:2]]
    ids = sorted({x for p in pairs for x in p} | {"alone"})[::share] + ["c0"]
    expected = _all_paths(pairs, ids, max_hops)
    rows = walk.maximal_paths(_edges(spark, pairs), _starts(spark, ids), max_hops).collect()
    assert Counter(tuple(r.nodes) for r in rows) == expected
    assert all((r.start, r.length) == (r.nodes[0], len(r.nodes)) for r in rows)
    lengths = Counter()
    for path, n in expected.items():
        lengths[len(path)] += n
    assert {r.length: r.n for r in walk.path_lengths(_edges(spark, pairs), _starts(spark, ids), max_hops).collect()} == lengths


def test_fewer_rows_are_written_than_paths_found(spark, monkeypatch):
    """8 starts in a ring share what follows them: 64 steps of two levels, then 8 that lead to one end."""
    ring = [(f"c{i}", f"c{(i + 1) % 8}") for i in range(8)]
    pairs = [*ring, *(("c0", f"a{i}") for i in range(8)), *((f"a{i}", f"b{j}") for i in range(8) for j in range(8)), *((f"b{j}", "end") for j in range(8))]
    ids, kept = sorted({x for p in pairs for x in p}), []
    monkeypatch.setattr(walk, "written", lambda df, name, f=walk.written: kept.append((name, f(df, name))) or kept[-1][1])
    assert walk.maximal_paths(_edges(spark, pairs), _starts(spark, ids)).count() == 8 * 64 + 64 + 8 + 7
    assert max(df.count() for _, df in kept) < 200
    kept.clear()
    assert sum(r.n for r in walk.path_lengths(_edges(spark, pairs), _starts(spark, ids)).collect()) == 8 * 64 + 64 + 8 + 7
    assert all(df.count() <= 100 for _, df in kept)
