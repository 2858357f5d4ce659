import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from pathloom.llm import packing, queries, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = ["a", "B", "é", "é", "ß", "Σ", "ΑΣ", "İ", "the", "'s", "don't", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", ".", ",", "..", "!", "_", "9", "１２", "²", "½", "中文", "क़", "😀", "ﬁ", "ǅ", "ŉ", "\0", "<|endoftext|>", "́", ",a", ". "]


_fresh = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def _library(path, text):
    """The ids by the library alone, from its own object."""
    return np.array(_fresh[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"])
def test_added_tokens_are_the_librarys(text):
    for path, keeps_space in ((WORD, False), (BYTE, True)):
        assert tokens.PieceTokenizer(path, keeps_space).encode([text]) == [_library(path, text)]


def test_both_queries_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    rows = sorted(queries.op1_token_files(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = _library(WORD, texts[r.doc_id]) + b"\1\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    found = {d: _library(BYTE, t) + b"\0" * 4 for d, t in texts.items()}
    pieces = queries.op9_nnls_packing(spark, sf).collect()
    covered = {d: 0 for d in texts}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids = found[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert (r.start, r.ids_crc32, r.doc_tokens) == (covered[r.doc_id], zlib.crc32(ids), len(found[r.doc_id]) // 4)
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) // 4 for d, x in found.items()}


def test_most_tails_are_placed_whole():
    rng = random.Random(4)
    for n in (300, 3_000, 300_000):
        histogram = {}
        for _ in range(n):
            k = min(1023, max(1, int(rng.lognormvariate(5, 1))))
            histogram[k] = histogram.get(k, 0) + 1
        rows, _ = packing.plan(histogram, 1024)
        laid = sum(hi - lo for _, lo, hi, _, _, laid in rows if laid)
        assert laid <= 0.1 * n


@pytest.mark.parametrize(("path", "keeps_space"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_library_ids(path, keeps_space):
    rng = random.Random(11)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    tok = tokens.PieceTokenizer(path, keeps_space, most=500)
    for i in range(0, len(texts), 250):
        assert tok.encode(texts[i : i + 250]) == [_library(path, t) for t in texts[i : i + 250]]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


ROWS = [(5, "The cat sat. On, the mat!", "x"), (1, None, None), (3, "", "y"), (3, "again", "y"), (None, "no id", "z"), (9, "word " * 5000, None), (5, "The cat sat. On, the mat!", "x")]


def _expected(path, keeps_space, end):
    tok = tokens.PieceTokenizer(path, keeps_space)
    return [(d, np.frombuffer(tok.direct([t or ""])[0] + np.array([end], "<u4").tobytes(), "<u4")) for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]


def test_token_files_round_trip(spark, tmp_path):
    path = tokens.write_token_files(_docs(spark, ROWS), WORD, 1, f"file://{tmp_path}/t", block_bytes=64)
    got = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, ids) in zip(got, _expected(WORD, False, 1), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, at, len(ids), ids.astype("<u4").tobytes())
        at += len(ids)
    assert tokens.read_document(spark, path, 3) == [[1], tokens.PieceTokenizer(WORD, False).lib.encode("again").ids + [1]]
    assert tokens.read_document(spark, path, 4) == []


def test_token_files_share_a_dictionary(spark, tmp_path):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog " * 4, None) for i in range(400)]
    path = tokens.write_token_files(_docs(spark, rows), WORD, 1, f"file://{tmp_path}/t", dict_bytes=2048)
    assert len(spark.read.parquet(f"{path}/dictionary").collect()) == 1
    assert {r.dict_hash for r in spark.read.parquet(f"{path}/blocks").collect()} == {r.dict_hash for r in spark.read.parquet(f"{path}/dictionary").collect()}
    assert tokens.read_token_files(spark, path).count() == 400
    assert tokens.read_document(spark, path, 7)[0][:-1] == tokens.PieceTokenizer(WORD, False).lib.encode(rows[7][1]).ids


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = tokens.write_token_files(_docs(spark, []), WORD, 1, f"file://{tmp_path}/t")
    assert tokens.read_token_files(spark, path).count() == 0


def _check_pieces(rows, window):
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert 0 < r.length <= window and r.start + r.length <= r.doc_tokens
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    sizes = []
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    assert sum(s < window for s in sizes) <= 1
    return by_doc


def test_packing_places_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "house", "zebra"]) for _ in range(rng.randint(0, 90))), None) for i in range(300)]
    got = packing.pack(_docs(spark, rows), BYTE, 0, window=64).collect()
    by_doc = _check_pieces(got, 64)
    tok = tokens.PieceTokenizer(BYTE, True)
    ids = {d: tok.direct([t])[0] + bytes(4) for d, t, _ in rows}
    for d, places in by_doc.items():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == len(ids[d]) // 4
    assert len(by_doc) == 300
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


def test_packing_of_odd_tables(spark):
    got = packing.pack(_docs(spark, ROWS), BYTE, 0).collect()
    assert sum(r.length for r in got) == sum(len(i) for _, i in _expected(BYTE, True, 0))
    assert packing.pack(_docs(spark, []), BYTE, 0).count() == 0
    same = packing.pack(_docs(spark, [(i, "one two three", None) for i in range(700)]), BYTE, 0)
    assert {r.doc_tokens for r in same.collect()} == {4}
    _check_pieces(same.withColumn("doc_id", F.monotonically_increasing_id()).collect(), 1024)


def test_plan_uses_each_tail_once():
    rng = random.Random(4)
    for _ in range(20):
        histogram = {rng.randint(1, 63): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        rows, n = packing.plan(histogram, 64)
        used = {}
        for length, lo, hi, *_ in rows:
            assert used.get(length, 0) == lo < hi
            used[length] = hi
        assert used == histogram
        assert n == -(-sum(k * v for k, v in histogram.items()) // 64)


def test_least_squares_recovers_counts():
    columns = [{3: 1, 5: 1}, {4: 2}, {2: 1, 6: 1}]
    x = packing.nonnegative_least_squares(columns, {3: 7.0, 5: 7.0, 4: 10.0, 2: 1.0, 6: 3.0})
    assert np.allclose(x, [7, 5, 2], atol=0.5)
