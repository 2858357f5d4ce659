"""Token-ID output: documents as token ids in files with a shared zstandard dictionary.

A folder of token files holds three Parquet tables:

* ``blocks``: one row per block of consecutive documents, in ascending doc_id order. A row has the number of ids before
  it in its part (``inner``), the documents' ids, their token counts, the end of each one's compressed frame in ``payload`` (the offset index), and the hash of the dictionary.
  Every document is a zstandard frame of its own, so that one short document is read by decompressing only its frame.
* ``dictionary``: one row with the dictionary's hash and bytes (no row if the corpus is too small to train one).
* ``manifest``: for each written part, how many ids the parts before it hold.

All three are written by Spark, so they lie wherever Spark can write and survive lost executors.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import by_batches, sampled, scratch_path, slices, texts_of, written

BLOCKS = "part int, block int, first_doc long, last_doc long, n_docs int, inner long, n_tokens long, width int, dict_hash string, doc_ids array<long>, counts array<int>, ends array<int>, payload binary"
DECODED = "doc_id long, start long, n_tokens long, ids binary"
#: A blank after white space, or a full stop or comma after anything but a letter or digit: no place to cut.
_RUN, _MARKS = re.compile(r" (?<=\s )"), re.compile(r"[.,](?<=[\W_].)")
#: The same for texts that are composed and lower-cased first, which turns some other letters into a letter and a mark.
_LOWER_MARKS = re.compile("[.,](?<=[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f].)")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]


class PieceTokenizer:
    """The ids of the tokenizers library, with a cache of the pieces between blanks and before full stops and commas.

    Both vocabularies cut a text there before they merge bytes, so the ids of a text are those of its pieces in a row. Each
    new piece goes to the library once; the cache has two generations of at most `most` pieces, and so follows the text at
    a bounded size. With `keeps_space` a blank belongs to the piece after it (byte-level vocabularies), else texts are
    lower-cased; a text with longer runs of white space then goes to the library as a whole, and one with other marks
    before full stops or commas is cut at blanks alone."""

    def __init__(self, path: str, keeps_space: bool, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # texts with an added token go to the library as a whole
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.model = self.lib.model
        self.keeps_space, self.most = keeps_space, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Cache pieces. Those of Latin letters alone are one word to the library, and go right to its merging step."""
        merge, id_bytes, rest, young = self.model.tokenize, self.id_bytes, [], self.young
        for p in pieces:
            blank = self.keeps_space and p[:1] == " "
            word = p[1:] if blank else p
            if not self.keeps_space:
                word = word.lower()
            if not word.isalpha() or not word.isascii() and (max(p) >= "\u0250" or not self.keeps_space and not p.isalpha()):
                rest.append(p)
                continue
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_LETTERS)
            young[p] = b"".join([id_bytes[t.id] for t in merge(_BLANK + word if blank else word)])
        young.update(zip(rest, self.direct(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        out: list[bytes] = [b""] * len(texts)
        pieces: dict[int, list[str]] = {}
        whole: list[int] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if "\0" in text or self.keeps_space and _RUN.search(text) or any(t in text for t in self.added):
                whole.append(i)
                continue
            marked = text if (_MARKS if self.keeps_space else _LOWER_MARKS).search(text) else text.replace(".", "\0.").replace(",", "\0,")
            marked = marked.replace(" ", "\0 ") if self.keeps_space else marked.replace("\n", "\0").replace(" ", "\0")
            p = pieces[i] = marked.split("\0")
            missing |= set(p).difference(self.young)
        known = missing & self.old.keys() if self.old else set()
        for p in known:
            self.young[p] = self.old[p]
        self.learn(list(missing - known))
        get = self.young.__getitem__
        for i, p in pieces.items():
            out[i] = b"".join(map(get, p))
        for i, ids in zip(whole, self.direct([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_tokenizers: dict[tuple[str, bool], PieceTokenizer] = {}


def tokenizer(path: str, keeps_space: bool) -> PieceTokenizer:
    """One per worker process, kept between tasks."""
    if (path, keeps_space) not in _tokenizers:
        _tokenizers[path, keeps_space] = PieceTokenizer(path, keeps_space)
    return _tokenizers[path, keeps_space]


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary for serialized id arrays; empty if there are too few samples to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _encoder(tokenizer_path: str, keeps_space: bool, end: bytes, width: int, dictionary: bytes) -> Callable:
    """Each document's frame, with the place at which it was read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        tok, part, row = tokenizer(tokenizer_path, keeps_space), TaskContext.get().partitionId(), 0
        for piece in slices(batches):
            ids = [x + end for x in tok.encode(piece.column(1).to_pylist())]
            n = len(ids)
            columns = [piece.column(0), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array([press.compress(_narrow(x, width)) for x in ids], pa.binary())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_part", "_row", "n", "frame"])

    return encode


def _blocks(width: int, dict_hash: str, block_bytes: int) -> Callable:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, block = _BLOCK_SCHEMA, TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        total = inner = 0

        def row() -> pa.RecordBatch:
            columns = [[part], [block], [next((d for d in doc_ids if d is not None), None)], [doc_ids[-1]], [len(doc_ids)], [inner], [sum(counts)], [width], [dict_hash], [doc_ids], [counts], [list(accumulate(map(len, frames)))], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for piece in batches:
            for doc_id, n, frame in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                total += len(frame)
                if total >= block_bytes:
                    yield row()
                    inner += sum(counts)
                    block, doc_ids, counts, frames, total = block + 1, [], [], [], 0
        if doc_ids:
            yield row()

    return gather


_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("payload", pa.binary())])
_DECODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, keeps_space: bool = False, sample_docs: int = 1_000, longest: int = 1 << 16, dict_bytes: int = 64 << 10, block_bytes: int = 1 << 20) -> str:
    """Encode the column text of docs and write token files in ascending doc_id order; returns their folder.

    A null text counts as empty, an empty one is the end id alone; a null doc_id comes first; rows of equal doc_id are kept
    all, in the order in which they were read; an empty table gives empty files. Other columns are not read. The dictionary
    is trained on at most `sample_docs` documents (a sample by hash of the id) of at most `longest` bytes; every document is
    encoded whole, and frames are shuffled rather than texts, in ranges that split a doc_id with many rows."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tok = tokenizer(tokenizer_path, keeps_space)
    width = 2 if max(tok.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    texts = [r.text for r in texts_of(rows, sampled(rows.select("doc_id"), sample_docs, F.col("doc_id")).distinct(), ["doc_id"], longest).collect()]
    dictionary = trained_dictionary([_narrow(ids + end, width) for ids in tok.encode(sorted(texts))], dict_bytes)
    dict_hash = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    frames = written(by_batches(rows, _encoder(tokenizer_path, keeps_space, end, width, dictionary), "doc_id long, _part int, _row long, n int, frame binary"), "frames", "none")
    order = ["doc_id", "_part", "_row"]
    ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    ordered.mapInArrow(_blocks(width, dict_hash, block_bytes), BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(dict_hash, bytearray(dictionary))] if dictionary else [], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # one row per written part
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = accumulate((r.n for r in sizes), initial=0)
    spark.createDataFrame([(r.part, b) for r, b in zip(sizes, before, strict=False)], "part int, before long").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def _decoder(dictionaries: dict[str, bytes]) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        readers = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v) if v else None) for k, v in [("", b""), *dictionaries.items()]}
        for batch in batches:
            for row in batch.to_pylist():
                read, payload, start, ids = readers[row["dict_hash"]], row["payload"], row["base"], []
                starts, at = [], 0
                for n, to in zip(row["counts"], row["ends"], strict=True):
                    raw = read.decompress(payload[at:to])
                    ids.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if row["width"] == 2 else raw)
                    starts.append(start)
                    start, at = start + n, to
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(ids, pa.binary())], schema=_DECODED_SCHEMA)

    return decode


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a folder of token files: doc_id, start (ids before it), n_tokens, ids (little-endian uint32)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    manifest = spark.read.schema("part int, before long").parquet(f"{path}/manifest")
    dictionaries = {r.dict_hash: bytes(r.dictionary) for r in spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").collect()}
    # the manifest has a row for each written part
    return blocks.join(F.broadcast(manifest), "part").select((F.col("before") + F.col("inner")).alias("base"), "width", "dict_hash", "doc_ids", "counts", "ends", "payload").mapInArrow(_decoder(dictionaries), DECODED)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document of that doc_id: only the blocks whose range holds it are read, only its frames decompressed."""
    import zstandard

    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "block").collect()
    dictionaries = {r.dict_hash: bytes(r.dictionary) for r in spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").collect()}
    out = []
    for r in rows:
        read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[r.dict_hash]) if r.dict_hash else None)
        for i, d in enumerate(r.doc_ids):
            if d == doc_id:
                raw = read.decompress(bytes(r.payload[r.ends[i - 1] if i else 0 : r.ends[i]]))
                out.append(np.frombuffer(raw, "<u2" if r.width == 2 else "<u4").tolist())
    return out
