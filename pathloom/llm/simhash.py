"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints have 64 bits. Two within `threshold` 3 differ in at most one bit in one of their two halves, so anchors are
chosen per half: the codewords of the perfect Hamming code of length 31, whose covering radius is 1. Every fingerprint has
one home anchor within that radius and is replicated to all anchors within radius plus the half's threshold, 1 + 1 = 2;
each anchor then compares its home fingerprints with its replicas. That finds every pair within the threshold.

A dense cloud of fingerprints would have quadratically many such pairs. So the fingerprints within two bits of each other
are first joined by their common neighbours, at 65 rows a fingerprint, and anchors report only the pairs that still belong
to different components. Equal fingerprints are one from the start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import by_batches, free_name, slices, small, written

THRESHOLD = 3


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[-n:], strict=True)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(1)], names=["doc_id", "fp", "text_hash"])


def text_hash(docs: DataFrame) -> Column:
    """Tells the texts of rows of equal doc_id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of each row; a null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), F.col("text"))
    return by_batches(rows, _fingerprints, "doc_id long, fp long, text_hash long")


def _bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_edges(points: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within two bits of each other.

    Each point stands at itself and at its 64 neighbours; those who meet at a place are within two bits. A place has at
    most 65 points. One or two that meet there need no more than their smallest and largest; the rare fuller places look
    up all their points."""
    places = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    met = points.select("fp", F.explode(places).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = written(met, "places")
    two = met.select("a", "b")
    around = F.array(F.col("v"), *(F.col("v").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    more = met.filter("n > 2").select("a", F.explode(around).alias("b")).join(points.select(F.col("fp").alias("b")), "b").filter("a <> b").select("a", "b")
    return two.union(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v and root (its component's smallest vertex) for every vertex of the edges (a, b), by minimum labels with shortcuts.

    Each round is written to the shared folder; hot vertices are pre-aggregated and their joins left to AQE to split."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("v"), "root"), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        low = labels.join(seen.select(F.col("a").alias("v"), "r"), "v").select("v", "root", F.least("root", "r").alias("r"))
        # the label's own label is a shortcut
        jump = labels.select(F.col("v").alias("r"), F.col("root").alias("far"))
        new = written(low.join(jump, "r").select("v", F.col("root").alias("was"), F.least("r", "far").alias("root")), "labels")
        if not new.filter("root < was").limit(1).count():
            return new.select("v", "root")
        labels = new.select("v", "root")


def _halves() -> list[tuple[int, list[int]]]:
    """For each half: the shift of its 31 bits, and for each bit of the syndrome the mask of the positions it sums."""
    return [(shift, [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]) for shift in (0, 32)]


def anchored(points: DataFrame, homes: bool) -> DataFrame:
    """The columns of points with half and anchor: the home anchor in each half, or all anchors within two bits in it."""
    out = []
    for half, (shift, masks) in enumerate(_halves()):
        x = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << 31) - 1))
        syndrome = sum((F.bit_count(x.bitwiseAND(F.lit(m))) % 2 * F.lit(1 << k) for k, m in enumerate(masks)), F.lit(0))
        at = points.withColumn("_x", x).withColumn("_s", syndrome.cast("int")).withColumn("half", F.lit(half))
        out.append(at)
    rows = out[0].union(out[1])
    home = F.when(F.col("_s") == 0, F.col("_x")).otherwise(F.col("_x").bitwiseXOR(F.expr("shiftleft(1L, _s - 1)")))
    if homes:
        return rows.withColumn("anchor", home).drop("_x", "_s")
    # pairs of positions i < j with i ^ j = s: flipping both gives another codeword
    pairs = F.expr("transform(filter(sequence(1, 31), i -> (i ^ _s) > i), i -> _x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ _s) - 1))")
    return rows.withColumn("anchor", F.explode(F.when(F.col("_s") == 0, F.array(F.col("_x"))).otherwise(F.array_append(pairs, home)))).drop("_x", "_s")


def far_edges(points: DataFrame) -> DataFrame:
    """Edges (a, b) between components: of points (fp, root) within three bits whose roots differ."""
    home = anchored(points.select(F.col("fp"), F.col("root")), True).select("half", "anchor", F.col("fp").alias("x"), F.col("root").alias("a"))
    rep = anchored(points.select(F.col("fp"), F.col("root")), False).select("half", "anchor", F.col("fp").alias("y"), F.col("root").alias("b"))
    near = home.join(rep, (home["half"] == rep["half"]) & (home["anchor"] == rep["anchor"]) & (F.col("a") < F.col("b")) & (_bits_apart(F.col("x"), F.col("y")) <= THRESHOLD))
    return near.select("a", "b").distinct()


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, fp and text_hash of each row, top (one for each component) and component_id (its smallest doc_id)."""
    rows = written(fingerprints(docs), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    close = components(close_edges(points))
    rooted = written(points.join(close.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    far = components(far_edges(rooted)).select(F.col("v").alias("root"), F.col("root").alias("top"))
    topped = rooted.join(far, "root", "left").select("fp", "least", F.coalesce("top", "root").alias("top"))
    least = topped.groupBy("top").agg(F.min("least").alias("component_id"))
    classes = written(topped.join(least, "top").select("fp", "top", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "text_hash", "top", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' doc_id with fp and component_id, the smallest doc_id reachable over links of at most three differing bits.

    Null and empty texts and those without words have fingerprint zero and link like any other. Rows of equal doc_id are
    kept all; a null doc_id gets the smallest id of its component, or null if that has none. An empty table gives no rows."""
    return _classified(docs).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Exactly one row of docs for each component; all columns stay.

    It is the row with the component's smallest doc_id (null only where it has no other), of several of that id the one whose
    text has the smallest hash, and of rows equal in id and text the one that sorts first by the other columns (any, where
    a column has no order). Rows of one doc_id in different components are judged each by its own text."""
    found = written(_classified(docs), "classified")
    first = found.filter("doc_id is null and component_id is null or doc_id = component_id").groupBy("top").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_doc")) & (F.col("text_hash") == F.col("_kept_text"))
    first = first.select(F.col("doc_id").alias("_kept_doc"), F.col("text_hash").alias("_kept_text"))
    counted = found.join(first, same).groupBy("_kept_doc", "_kept_text").count()
    chosen = written(counted.select("_kept_doc", "_kept_text", (F.col("count") > 1).alias("_repeated")), "chosen")
    names = {c: free_name(docs, c) for c in chosen.columns}
    chosen = chosen.withColumnsRenamed(names)
    doc, text, repeated = (F.col(names[c]) for c in ("_kept_doc", "_kept_text", "_repeated"))
    ours = docs["doc_id"].cast("long").eqNullSafe(doc) & (text_hash(docs) == text)
    kept = docs.join(small(chosen.filter(~repeated)), ours, "left_semi")
    if chosen.filter(repeated).limit(1).count():
        # the rare rows equal in id and text: partial minima before any shuffle
        pick = F.first if "map<" in docs.schema.simpleString() else F.min
        more = docs.join(small(chosen.filter(repeated)), ours).groupBy(doc, text).agg(pick(F.struct(*(docs[c] for c in docs.columns))).alias("_row"))
        kept = kept.unionByName(more.select("_row.*"))
    return kept
