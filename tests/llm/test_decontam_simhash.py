import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import decontam, queries, simhash

DOCS = "doc_id long, text string, item_id string, fp string, h string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def _brute(docs, items):
    """All (doc, item) where at some offset half of the item's words or 13 are equal."""
    out = set()
    for row, (d, t) in enumerate(docs):
        w = _words(t)
        for i, x in items:
            v = _words(x)
            for start in range(-len(v) + 1, len(w)):
                same = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
                if sum(same) >= 13 or 2 * sum(same) >= len(v):
                    out.add((d, row, i))
    return {(d, i) for d, _, i in out}


def test_decontamination_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "é"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 30)))) for i in range(12)]
    items.append((99, items[0][1]))
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 3:
            passage = rng.choice(items)[1].split()
            every = rng.choice([0, 3, 4, 5, 7])
            passage = [f"sub{k}" if every and k % every == every - 1 else p for k, p in enumerate(passage)][: rng.randint(6, 40)]
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((d, " ".join(body).upper() if d % 2 else ", ".join(body)))
    docs += [(None, items[3][1]), (None, "nothing here"), (7, items[4][1]), (61, None), (62, ""), (63, items[0][1] + ".\n" + items[0][1])]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    bench = spark.createDataFrame(items + [(100, None), (101, "too few words")], "item_id long, text string")
    found = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == _brute(docs, items)
    kept = decontam.decontaminated(df, bench)
    assert kept.columns == df.columns
    bad = {(d, t) for d, t in docs if _brute([(d, t)], items)}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (x for x in docs if x not in bad)))


@pytest.mark.parametrize("every", [3, 4, 5, 8])
def test_passages_with_substituted_words_are_found(spark, every):
    item = " ".join(f"word{i}" for i in range(30))
    text = "some words before " + " ".join("other" if i % every == 0 else f"word{i}" for i in range(30)) + " and after"
    df = spark.createDataFrame([(1, text), (2, "some words before and after")], "doc_id long, text string")
    found = decontam.contaminated(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in found] == [(1, 5, 3)]


def test_decontamination_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(df, none).count() == 0
    assert decontam.decontaminated(df, none).count() == 1
    assert decontam.decontaminated(df.limit(0), none).count() == 0


def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_fingerprints_by_brute_force():
    texts = [None, "", " \n", "one", "one two", "A b C", "a B c d e f", "É é \x0b x\x85y z", "the cat " * 500, "a b c d"]
    assert [simhash.fingerprint(t or "") for t in texts] == [_fingerprint(t) for t in texts]


def _components(points):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    listed = sorted(points)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = {}
    for p in listed:
        groups.setdefault(root(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_by_brute_force(spark, seed):
    rng = random.Random(seed)
    points = {0, (1 << 64) - 1}
    for _ in range(25):
        center = rng.getrandbits(64)
        points.add(center)
        for _ in range(rng.randint(0, 12)):
            p = center
            for b in rng.sample(range(64), rng.randint(1, 7)):
                p ^= 1 << b
            points.add(p)
    for _ in range(6):  # pairs at exactly three bits in any halves, and chains of them
        p = rng.getrandbits(64)
        for _ in range(4):
            points.add(p)
            for b in rng.sample(range(64), 3):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    close = simhash.components(simhash.close_edges(df))
    rooted = df.join(close.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    far = simhash.components(simhash.far_edges(rooted)).select(F.col("v").alias("root"), F.col("root").alias("top"))
    groups = {}
    for r in rooted.join(far, "root", "left").collect():
        groups.setdefault(r.top if r.top is not None else r.root, set()).add(r.fp % (1 << 64))
    assert sorted(map(sorted, groups.values())) == _components(points)


def test_near_duplicates_of_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base), (7, base + " more"), (5, "something else entirely here"), (None, base), (1, None), (2, ""), (3, " \n"), (5, "other text of the same id")]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [(d, _fingerprint(t)) for d, t in rows]
    groups = _components({p for _, p in prints})
    least = {p: min((d for d, q in prints if q in g and d is not None), default=None) for g in groups for p in g}
    assert got == sorted(((d, least[p]) for d, p in prints), key=str)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 5]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def _bodies(n):
    return [" ".join(f"body{k}word{i}" for i in range(60)) for k in range(n)]


A, B, C = _bodies(3)


@pytest.mark.parametrize(("rows", "n"), [([(None, A), (None, B), (None, C)], 3), ([(5, A), (5, B)], 2), ([(5, A), (1, B), (5, B)], 2), ([(5, A), (5, A), (None, A)], 1), ([(None, A)] * 3, 1)])
def test_one_row_stays_of_each_component(spark, rows, n):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in simhash.representatives(df).collect()]
    assert len(kept) == n and {t for _, t in kept} == {t for _, t in rows} and set(kept) <= set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_representatives_of_random_tables(spark, seed):
    rng = random.Random(seed)
    bodies = _bodies(4)
    texts = [*bodies, *(b.upper() for b in bodies), None, "", "  "]
    rows = [(rng.choice([None, None, 1, 2, 3, 4]), rng.choice(texts)) for _ in range(60)]
    df = spark.createDataFrame([(d, t, f"i{k}", "y", None) for k, (d, t) in enumerate(rows)], DOCS)
    kept = simhash.representatives(df).collect()
    groups = _components({_fingerprint(t) for _, t in rows})
    at = {p: i for i, g in enumerate(groups) for p in g}
    least = {i: min((d for d, t in rows if d is not None and at[_fingerprint(t)] == i), default=None) for i in range(len(groups))}
    assert sorted(at[_fingerprint(r.text)] for r in kept) == list(range(len(groups)))
    assert all(r.doc_id == least[at[_fingerprint(r.text)]] for r in kept)
    assert len({r.item_id for r in kept}) == len(kept)


def test_near_duplicates_query(spark):
    rows = queries.op8_simhash_near_duplicates(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {d: _fingerprint(t) for d, t in texts.items()}
    groups = {p: g for g in _components(set(prints.values())) for p in g}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == {d: min(e for e, q in prints.items() if q in groups[p]) for d, p in prints.items()}
