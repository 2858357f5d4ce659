import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import license_scan, queries, sharding

DOCS = "doc_id long, text string, shard string, matches string"


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"))
    rows = sharding.shard_documents(docs, sharding.tree([1.0] * 8)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    by_shard = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    for slots in by_shard.values():
        assert slots == list(range(len(slots)))
        assert abs(len(slots) - 2500) < 300
    assert abs(sum(r.grown_shard == 8 for r in rows) - 20000 / 9) < 300


def test_weights_and_confined_movement(spark):
    docs = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    old, new = sharding.tree([1, 1, 1, 1, 2, 0.0, 1, 1]), sharding.tree([1, 1, 1, 1, 4, 0.0, 1, 1])
    rows = docs.select(sharding.place(F.col("k"), old).alias("a"), sharding.place(F.col("k"), new).alias("b")).collect()
    share = [sum(r.a == s for r in rows) / 20000 for s in range(8)]
    assert share[5] == 0 and abs(share[4] - 0.25) < 0.02 and abs(share[0] - 0.125) < 0.02
    # shard 4's rack and region grew: a row stays or enters that region, and within the region only rack 2 gains
    assert all(r.a == r.b or r.b >= 4 for r in rows)
    assert all(r.b in (4, 5) for r in rows if r.a >= 4 and r.a != r.b)


def test_draws_are_the_documented_hashes(spark):
    root = sharding.tree([1.0, 2.0], racks=1, per_rack=2)

    def expected(key):
        import math

        def u(name):
            seed = xxhash.xxh64_intdigest(key.encode(), 42)
            return ((xxhash.xxh64_intdigest(name.encode(), seed) >> 11) + 0.5) / 2**53

        return min((-math.log(u(f"s{s}")) / w, s) for s, w in ((0, 1.0), (1, 2.0)))[1]

    rows = spark.range(300).select("id", sharding.place(F.col("id").cast("string"), root).alias("s")).collect()
    assert [r.s for r in rows] == [expected(str(r.id)) for r in rows]


def test_sharding_of_odd_tables(spark):
    rows = [(1, None, "x", "y"), (1, "é", "x", "y"), (None, "", "x", "y"), (None, "b", None, None), (1, "é", "x", "y")]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), sharding.tree([1.0] * 8))
    assert set(got.columns) == {"doc_id", "text", "matches", "shard", "grown_shard", "slot"}
    found = got.collect()
    assert len(found) == 5 and len({r.shard for r in found if r.doc_id == 1}) == 1
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), sharding.tree([1.0])).count() == 0
    clash = spark.createDataFrame([(1, 2, 3, 4)], "doc_id long, _bucket int, _base int, _rank int")
    assert set(clash.columns) < set(sharding.shard_documents(clash, sharding.tree([1.0] * 2)).columns)


def test_thousands_of_shards(spark):
    root = sharding.tree([1.0] * 3000, racks=20, per_rack=10)
    rows = spark.range(6000).select(sharding.place(F.col("id").cast("string"), root).alias("s")).collect()
    assert len({r.s for r in rows}) > 2000


def test_sharding_query(spark):
    rows = queries.op2_hash_tree_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_columns(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "...", "MIT License", "mit-license!", "The MIT License and the mit License.", "under the GNU General Public License, version 3", "gnu general public licence", "CC BY", "cc by cc by-nc", "(CC-BY)",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "apache\nlicense", "apache licenseé", "émit license", "mit license9", "\x00mit\x7flicense\x00", "MIT licenſe", "mit " * 3 + "license " * 3,
    "words before " * 4000 + "Released under the MIT License. " * 300 + "and after", "GNU GENERAL PUBLIC LICENSE GNU GENERAL PUBLIC LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
]


def test_license_base_columns_by_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "MIT License", None, None)], DOCS)
    found = license_scan.scan_licenses(df)
    assert found.columns.count("matches") == 1
    rows = found.select("doc_id", "text", "n_words", *(c.alias(k) for k, c in license_scan.summarized(F.col("matches")).items())).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_columns(r.text), r.text
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by_text = {r.text: r for r in rows}
    assert by_text["Licensed under CC BY-NC 4.0."].labels == "cc-by,cc-by-nc"
    assert by_text["Licensed under the Apache License, Version 2.0."].labels == "apache,apache-2.0"
    assert by_text[TEXTS[-1]].labels == "mit-notice" and by_text[TEXTS[-1]].n_base == 0
    assert by_text[None].labels == "" and by_text[None].score == 0


def test_whole_texts_and_their_intersections(spark):
    mit = license_scan.TEXTS[0].words
    bent = mit.replace("without restriction", "with restriction")
    loose = "deal software restriction " * 50
    rows = [(1, mit.capitalize()), (2, bent), (3, loose), (4, "x " * 30 + mit.replace(" ", ", ")), (5, mit.replace("merge publish", "merge and publish"))]
    found = license_scan.scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).withColumn("_words", F.lit(1)))
    assert "_words" in found.columns
    got = {r.doc_id: r for r in found.select("doc_id", *(c.alias(k) for k, c in license_scan.summarized(F.col("matches")).items())).collect()}
    assert [got[i].labels for i in range(1, 5)] == ["mit-notice,mit-text", "mit-notice", "", "mit-notice,mit-text"]
    assert got[5].labels == "mit-notice"  # words after the one put in stand elsewhere


def test_license_query_on_documents(spark):
    rows = queries.op3_license_scan(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_columns(texts[r.doc_id])


def test_license_of_an_empty_table(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("text", ["a" * 10, "İ license", "x K mit license"])
def test_license_odd_letters(spark, text):
    df = spark.createDataFrame([(1, text, None, None)], DOCS)
    r = license_scan.scan_licenses(df).select("n_words", license_scan.summarized(F.col("matches"))["n_base"].alias("n")).first()
    assert (r.n_words, r.n) == base_columns(text)[:2]
