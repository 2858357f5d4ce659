"""Every overlap that the law accepts is found, by a brute force that knows no seeds."""

import random

import pytest

from pathloom.llm import decontam

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def _law(docs, items):
    out = set()
    for d, t in docs:
        w = t.split()
        for i, x in items:
            v = x.split()
            for start in range(-len(v) + 1, len(w)):
                same = sum(0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v)))
                if (same == len(v)) if len(v) < 3 else (same >= 13 or 2 * same >= len(v)):
                    out.add((d, i))
    return out


def _found(spark, docs, items):
    rows = decontam.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


def test_random_substitutions(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{rng.randrange(50)}" for _ in range(n))) for i, n in enumerate([3, 4, 5, 6, 7, 8, 12, 15, 18, 22, 27, 30, 41, 53, 59, 60, 61, 90])]
    docs = []
    for share in (0.2, 0.3, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0):
        for _, x in items:
            body = [f"own{k}" for k in range(rng.randrange(12))]
            docs.append((len(docs), " ".join(body + [w if rng.random() < share else "other" for w in x.split()] + body)))
    for _, x in items:  # exactly the least overlap: at random, evenly spread, in every second place
        v = x.split()
        n = len(v)
        m = min(13, -(-n // 2))
        for places in (rng.sample(range(n), m), [k * (n - 1) // max(m - 1, 1) for k in range(m)], range(0, n, 2)):
            docs.append((len(docs), " ".join(w if k in set(places) else "other" for k, w in enumerate(v))))
    expected = _law(docs, items)
    assert len(expected) > 100
    assert _found(spark, docs, items) == expected


@pytest.mark.parametrize("text", ["alone", "two words", "just three words", "a b c d", "one two three four five"])
def test_short_items_are_found_whole(spark, text):
    docs = [(1, f"before {text} after"), (2, text), (3, "before after"), (4, text.split()[0][::-1] + " x")]
    assert _found(spark, docs, [(7, text)]) == {(1, 7), (2, 7)}
