"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words of which some positions are ignored: three words count, the first, one `gap` further
on and one after that. Words of test items and of training texts are hashed under the masks and the hashes are joined: the
hash of the first two by equality, the third's within the join. Around each hit the item is laid over the text and compared
word by word: substituted words cost a position each and no more. Built of SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import small, written

SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which value is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case words: runs of digits, letters and characters beyond ASCII. Null and empty texts have none."""
    raw = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)

    def trimmed(w: Column) -> Column:
        skip = (F.get(w, F.lit(0)) == "").cast("int")
        last = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
        return F.slice(w, skip + 1, F.size(w) - skip - last)

    return _with(raw, trimmed)


def least_overlap(n: int, least_share: float, least_run: int) -> int:
    """How many words of an item of n must stand in place at least: all of one or two."""
    if n < 3:
        return n
    return min(least_run, next((k for k in range(1, n + 1) if k / n >= least_share), n + 1))


def least_near(n: int, overlap: int, span: int) -> tuple[int, int]:
    """(q, r): any `overlap` of n places have, from r of them on, q within the next `span` places, their own included."""
    q = max((q for q in range(1, overlap + 1) if (q - 1) * (n // span) + min(q - 1, n % span) < overlap), default=1)
    return q, max(1, overlap - q + 1 - (q - 1) * ((n - 1) // span))


def least_span(n: int, overlap: int) -> int:
    """The shortest window such that any `overlap` of n places have three in one, and so seldom by chance that few places are
    compared in vain: four in one, or three in three of them. Where one or two count, any item is one window."""

    def enough(b: int) -> bool:
        q, r = least_near(n, overlap, b)
        return q > 3 or q == 3 and r >= min(3, overlap - 2)

    return next((b for b in range(3, n) if enough(b)), n)


def windows(rows: DataFrame, words: str, keep: list[str], span: int) -> DataFrame:
    """One row per word: the columns `keep`, pos, and the hashes t0 to t(span - 1) of it and the words after it (null past the end)."""
    shifted = [F.col(words).alias("t0"), *(F.slice(F.col(words), k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"t{k}") for k in range(1, span))]
    hashes = [F.when(F.col(f"z.t{k}").isNotNull(), F.hash(F.col(f"z.t{k}"))).alias(f"t{k}") for k in range(span)]
    return rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z")).select(*keep, "pos", *hashes)


def _pairs(rows: DataFrame, gaps: list[int]) -> Column:
    """For each gap, the gap and the hash of it, the first word and the word so far on; null past the end."""
    return F.explode(F.array(*(F.struct(F.lit(g).alias("gap"), F.when(F.col(f"t{g}").isNotNull(), F.xxhash64(F.lit(g), F.col("t0"), F.col(f"t{g}"))).alias("h")) for g in gaps)))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, least_run: int = 13) -> DataFrame:
    """One row per document and item that overlap: doc_id, _text_hash, item_id, start, overlap (words equal in place), share.

    A text leaks an item if, with the item laid over it anywhere, `least_share` of the item's words or `least_run` of them
    stand in their places (items of one or two words: all); of several places the best counts, the first among equals. No
    such place is missed: the masks span as many words as the benchmark's lengths ask for (least_span), which is a fifth of
    an item of over 26 words, so that their number grows with the longest item. Items of equal words are all reported. Null
    and empty texts leak nothing; rows of equal doc_id are judged each by its own text, which _text_hash tells; a null
    doc_id is a value like any other."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    items = written(benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct(), "items")
    least = {n: least_overlap(n, least_share, least_run) for (n,) in items.select(F.size("item_words")).distinct().collect()}
    least = {n: k for n, k in least.items() if k <= n}
    spans = {n: least_span(n, k) for n, k in least.items()} or {1: 1}
    span, few = max(spans.values()), {n for n in least if least[n] < 3}
    spans = {n: b if n in few else span for n, b in spans.items()}
    near = {n: (k, 1) if n in few else least_near(n, k, span) for n, k in least.items()} or {1: (1, 1)}
    gaps = sorted({g for n, b in spans.items() for g in ([0] if b == 1 else range(1, min(b, n) - (n not in few)))})
    look = lambda of: F.create_map(*(F.lit(x) for n in spans for x in (n, of(n))))[F.size("item_words")]
    marked = items.select("item_id", "item_words", look(spans.get).alias("own"), look(lambda n: near[n][0]).alias("need"), look(lambda n: near[n][1]).alias("rows")).filter("own is not null")
    seeds = windows(marked, "item_words", ["item_id", "own", "need", "rows"], span)
    seeds = seeds.select("item_id", "own", "need", "rows", F.col("pos").alias("item_pos"), *(F.when(F.col("own") > k, F.col(f"t{k}")).alias(f"t{k}") for k in range(span)))
    vocabulary = written(seeds.select("t0").distinct(), "vocabulary")
    seeds = seeds.select("item_id", "own", "need", "rows", "item_pos", *(F.col(f"t{k}").alias(f"i{k}") for k in range(span)), _pairs(seeds, gaps).alias("s"))
    # one word alone counts only for items of one word
    seeds = seeds.filter(F.col("s.h").isNotNull() & ((F.col("s.gap") > 0) | (F.col("own") == 1)))
    seeds = written(seeds.select("item_id", "need", "rows", "item_pos", *(f"i{k}" for k in range(1, span)), F.col("s.h").alias("h")), "seeds")
    rows = docs.select("doc_id", text_hash.alias("_text_hash"), F.col("text"))
    key = ["doc_id", "_text_hash"]
    seen = windows(rows.select(*key, words_of(F.col("text")).alias("w")), "w", key, span).join(small(vocabulary), "t0", "left_semi")
    seen = seen.select(*key, "pos", *(f"t{k}" for k in range(1, span)), _pairs(seen, gaps).alias("s"))
    seen = seen.select(*key, "pos", *(f"t{k}" for k in range(1, span)), F.col("s.gap").alias("gap"), F.col("s.h").alias("h")).filter("h is not null")
    # the first two are equal by their hash
    alike = sum((F.coalesce(((F.col("gap") < k) & (F.col(f"t{k}") == F.col(f"i{k}"))).cast("int"), F.lit(0)) for k in range(2, span)), F.least(F.col("gap"), F.lit(1)) + 1)
    hits = seen.join(small(seeds), "h").filter(alike >= F.col("need")).groupBy(*key, "item_id", (F.col("pos") - F.col("item_pos")).alias("start"), "rows").agg(F.countDistinct("pos").alias("n"))
    hits = written(hits.filter("n >= rows").groupBy(*key).agg(F.collect_set(F.struct("item_id", "start")).alias("places")), "hits")
    pairs = small(hits.withColumnsRenamed({"doc_id": "_leak_doc", "_text_hash": "_leak_text"}))
    same = F.col("doc_id").eqNullSafe(F.col("_leak_doc")) & (F.col("_text_hash") == F.col("_leak_text"))
    laid = rows.join(pairs, same).select(*key, "places", words_of(F.col("text")).alias("w"))

    # only the words under an item leave the text
    under = F.transform("places", lambda p: F.struct(p.item_id.alias("item_id"), p.start.alias("start")))
    longest = max(spans)
    cut = F.transform(under, lambda p: F.struct(p.item_id.alias("item_id"), p.start.alias("start"), F.slice(F.col("w"), F.greatest(p.start, F.lit(0)) + 1, F.lit(longest) + F.least(p.start, F.lit(0))).alias("under")))
    places = laid.select(*key, F.explode(cut).alias("p")).select(*key, "p.item_id", F.col("p.start").cast("long").alias("start"), "p.under").join(small(items), "item_id")
    ahead = F.greatest(-F.col("start"), F.lit(0)).cast("int")
    equal = F.size(F.filter(F.transform("item_words", lambda w, k: F.get(F.col("under"), F.when(k >= ahead, k - ahead)) == w), lambda x: x))
    counted = written(places.select(*key, "item_id", "start", equal.alias("overlap"), F.size("item_words").alias("n"), F.xxhash64("item_words").alias("_item")), "overlaps")
    counted = counted.withColumn("share", F.col("overlap") / F.col("n"))
    lawful = F.when(F.col("n") < 3, F.col("overlap") == F.col("n")).otherwise((F.col("share") >= least_share) | (F.col("overlap") >= least_run))
    best = F.max_by(F.struct("start", "overlap", "share"), F.struct(F.col("overlap"), -F.col("start")))
    return counted.filter(lawful).groupBy(*key, "item_id", "_item").agg(best.alias("b")).select(*key, "item_id", "b.*").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of docs whose text leaks no benchmark item; all columns stay."""
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_leak_doc"), F.col("_text_hash").alias("_leak_text")).distinct(), "leaks")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("_leak_doc")) & (own == F.col("_leak_text")), "left_anti")
