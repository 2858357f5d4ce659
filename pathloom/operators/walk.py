"""Self-avoiding walks: one random walk per draw, or all maximal simple paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.draws import below
from pathloom.operators.scratch import written


def placed_steps(edges: DataFrame, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """(src, dst and place, which numbers the distinct successors of each src from 0; src and out, how many it has).

    Places go by 256 buckets of the md5 of dst and by dst within them, so that no task orders all successors of a hub.
    Both are written where they are to be read often (`store`); the distinct edges are in any case."""
    kept = written if store else lambda df, name: df
    bucketed = written(edges.select("src", "dst").distinct().withColumn("_b", F.substring(F.md5(F.col("dst").cast("binary")), 1, 2)), "steps")
    before = F.sum("n").over(Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # at most 256 rows each
    sizes = bucketed.groupBy("src", "_b").agg(F.count(F.lit(1)).alias("n")).select("src", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("src", "_b").orderBy("dst")) - 1
    ranked = bucketed.withColumn("_r", within).join(sizes, ["src", "_b"])
    return kept(ranked.select("src", "dst", (F.col("_before") + F.col("_r")).cast("long").alias("place")), "steps"), kept(bucketed.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "outs")


#: From nodes (column id) to the edges that leave them.
Leaving = Callable[[DataFrame], DataFrame]
#: So many draws are sent to every task at most; more meet the edges by shuffle.
FEW = 100_000


def random_walks(draws: DataFrame, edges: DataFrame, max_hops: int = 999, seed: int = 42, tries: int = 8, leaving: Leaving | None = None) -> DataFrame:
    """draw_id, start, nodes and length of a walk from each draw's start, until no unvisited successor is left or at max_hops.

    Each step draws `tries` places among the successors and takes the first that leads to an unvisited one, which is a
    uniform choice; a draw costs so many rows however many neighbours a hub has. Only where all of them were visited before
    are the unvisited successors listed, and the one whose md5 of seed, draw, step and id is smallest is next, uniform too.
    Few draws are sent to the edges, and a step numbers the successors of the nodes where they stand only: no step shuffles all
    edges. `leaving` gives the edges that leave given nodes (column id), where the source of the graph finds them with less work
    than by comparing the ids of all. For more draws all successors are numbered once. Rounds are written to the shared folder; their number is that of
    the longest walk."""
    active = written(draws.select("draw_id", "start", F.col("start").alias("cur"), F.array("start").alias("nodes")), "walks")
    few = active.count() <= FEW
    if not few:
        steps, outs = placed_steps(edges)
    ended = []
    for step in range(max_hops):
        if few:
            here = active.select(F.col("cur").alias("id")).distinct()
            there = leaving(here) if leaving else edges.join(F.broadcast(here.withColumnRenamed("id", "src")), "src", "left_semi")
            steps, outs = placed_steps(there, store=False)
        drawn = F.posexplode(F.array(*(below(F.col("out"), seed, F.col("draw_id"), step, k) for k in range(tries)))).alias("k", "place")
        asked = active.select("draw_id", F.col("cur").alias("src")).join(outs, "src").select("draw_id", "src", drawn)
        met = (F.broadcast(asked) if few else asked).join(steps, ["src", "place"]).groupBy("draw_id").agg(F.array_sort(F.collect_list(F.struct("k", "dst")))["dst"].alias("met"))
        first = F.get(F.filter("met", lambda d: ~F.array_contains("nodes", d)), F.lit(0))
        tried = written(active.join(met, "draw_id", "left").select("draw_id", "start", "cur", "nodes", first.alias("dst")), "walks")
        choice = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw_id").cast("string"), F.lit(str(step)), "dst").cast("binary")), F.col("dst"))
        stuck = tried.filter("dst is null").select("draw_id", "cur", "nodes")
        options = (F.broadcast(stuck) if few else stuck).join(steps, F.col("cur") == steps["src"]).filter(~F.array_contains("nodes", F.col("dst")))
        chosen = options.groupBy("draw_id").agg(F.min(choice)["dst"].alias("_other"))
        moved = written(tried.join(chosen, "draw_id", "left").select("draw_id", "start", "nodes", F.coalesce("dst", "_other").alias("dst")), "walks")
        ended.append(moved.filter("dst is null").select("draw_id", "start", "nodes"))
        active = moved.filter("dst is not null").select("draw_id", "start", F.col("dst").alias("cur"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        if not active.limit(1).count():
            break
    else:
        ended.append(active.select("draw_id", "start", "nodes"))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out.withColumn("length", F.size("nodes"))


def usable(walks: DataFrame) -> DataFrame:
    """Walks of more than one node; walk_losses() counts the others."""
    return walks.filter("length > 1")


def walk_losses(walks: DataFrame) -> DataFrame:
    """One row: walks, and those dropped because they start where no edge leaves."""
    return walks.agg(F.count(F.lit(1)).alias("walks"), F.count_if(F.col("length") < 2).alias("dropped_short"))


def _into(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """The steps that paths from the starts (column id) may take; all of them where every step leaves a start."""
    if not steps.select(F.col("src").alias("id")).distinct().join(starts, "id", "left_anti").limit(1).count():
        return steps
    seen = last = starts.distinct()
    while True:
        onward = steps.join(last.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        last = written(onward.join(seen, "id", "left_anti"), "reached")
        if not last.limit(1).count():
            return written(steps.join(seen.withColumnRenamed("id", "src"), "src", "left_semi"), "steps")
        seen = seen.unionByName(last)


class _Parts:
    """The paths from the starts in two parts, so that none is written as a whole.

    No cycle can be reached from a free node, so what may follow it on a path never depends on what came before: its tails are
    listed (or, for `lengths`, counted by hops) once, from the ends backwards, a round for each level. Beginnings grow from the
    starts step by step as far as the first free node. A maximal path is a beginning and one of the tails of its last node."""

    def __init__(self, edges: DataFrame, starts: DataFrame, max_hops: int, lengths: bool) -> None:
        self.lengths, self.max_hops = lengths, max_hops
        starts = starts.select("id")
        steps = _into(written(edges.select("src", "dst").filter("src <> dst").distinct(), "steps"), starts)  # a self-loop leads to nothing new
        sources = written(steps.select("src").distinct(), "sources")
        inner = sources.select(F.col("src").alias("dst"), F.lit(True).alias("_i"))
        self.steps = written(steps.join(inner, "dst", "left").select("src", "dst", F.coalesce("_i", F.lit(False)).alias("inner")), "steps")
        self.free, self.tails, self.levels = None, None, 0
        self._peel(sources)
        self._begin(starts)

    def _peel(self, sources: DataFrame) -> None:
        blocked, core = self.steps.filter("inner").select("src", "dst"), sources
        while self.levels < self.max_hops:
            ready = written(core.join(blocked.select("src").distinct(), "src", "left_anti"), "free")
            if not ready.limit(1).count():
                break
            self.levels += 1
            tails = written(self._tails_of(ready), "tails")
            self.tails = tails if self.tails is None else self.tails.unionByName(tails)
            self.free = ready if self.free is None else self.free.unionByName(ready)
            core = written(core.join(ready, "src", "left_anti"), "core")
            blocked = written(blocked.join(ready.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"), "blocked")
        self.core = core

    def _tails_of(self, ready: DataFrame) -> DataFrame:
        mine = self.steps.join(ready, "src", "left_semi")
        ends, more = mine.filter("not inner"), mine.filter("inner")
        if self.lengths:
            found = ends.select(F.col("src").alias("id"), F.lit(1).alias("hops"), F.lit(1).cast("long").alias("n"))
            if self.tails is not None:
                found = found.unionByName(more.select(F.col("src").alias("_s"), F.col("dst").alias("id")).join(self.tails, "id").select(F.col("_s").alias("id"), (F.col("hops") + 1).alias("hops"), "n"))
            return found.groupBy("id", "hops").agg(F.sum("n").alias("n"))
        found = ends.select(F.col("src").alias("id"), F.array("dst").alias("tail"))
        if self.tails is None:
            return found
        return found.unionByName(more.select(F.col("src").alias("_s"), F.col("dst").alias("id")).join(self.tails, "id").select(F.col("_s").alias("id"), F.concat(F.array("id"), "tail").alias("tail")))

    def _begin(self, starts: DataFrame) -> None:
        """Sets whole, paths (start, nodes) that end without a tail, and begun, those whose last node has tails."""
        free = starts.limit(0).select("id", F.lit(True).alias("_f")) if self.free is None else self.free.select(F.col("src").alias("id"), F.lit(True).alias("_f"))
        first = lambda ids: ids.select(F.col("id").alias("start"), F.array("id").alias("nodes"), "id")
        begun, whole = [first(starts.join(free, "id", "left_semi"))], []
        onward = self.steps.join(self.core, "src", "left_semi").join(free.withColumnRenamed("id", "dst"), "dst", "left")
        onward = written(onward.select("src", "dst", "inner", F.coalesce("_f", F.lit(False)).alias("free")), "onward")
        active = first(starts.join(self.core.withColumnRenamed("src", "id"), "id", "left_semi"))
        self.rounds = 0
        while self.rounds < self.max_hops:
            step = (F.col("id") == onward["src"]) & ~F.array_contains("nodes", F.col("dst"))
            grown = written(active.join(onward, step, "left").select("start", "nodes", "dst", "inner", "free"), "paths")
            self.rounds += 1
            longer = F.array_append("nodes", F.col("dst")).alias("nodes")
            whole += [grown.filter(F.col("dst").isNull() & (F.size("nodes") > 1)).select("start", "nodes"), grown.filter("not inner").select("start", longer)]
            begun.append(grown.filter("free").select("start", longer, F.col("dst").alias("id")))
            active = grown.filter("inner and not free").select("start", longer, F.col("dst").alias("id"))
            if not active.limit(1).count():
                break
        else:
            whole.append(active.select("start", "nodes").filter(F.size("nodes") > 1))
        union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
        self.begun, self.whole = union(begun), union(whole) if whole else active.limit(0).select("start", "nodes")

    @property
    def cut(self) -> bool:
        """Whether some beginning and tail may be longer than max_hops together."""
        return self.rounds + self.levels > self.max_hops


def maximal_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 999) -> DataFrame:
    """start, nodes and length of every maximal simple path of more than one node from the starts (column id).

    Paths are put together from beginnings and tails in one join, whose rows are the result; see _Parts."""
    parts = _Parts(edges, starts, max_hops, lengths=False)
    out = parts.whole
    if parts.tails is not None:
        joined = parts.begun.join(parts.tails, "id").select("start", F.concat("nodes", "tail").alias("nodes"))
        if parts.cut:
            short = F.size("nodes") <= max_hops + 1
            joined = joined.filter(short).unionByName(joined.filter(~short).select("start", F.slice("nodes", 1, max_hops + 1).alias("nodes")).distinct())
        out = out.unionByName(joined)
    return out.withColumn("length", F.size("nodes"))


def path_lengths(edges: DataFrame, starts: DataFrame, max_hops: int = 999) -> DataFrame:
    """length and n, the number of maximal_paths() of that length, which are counted and not listed beyond their beginnings."""
    parts = _Parts(edges, starts, max_hops, lengths=True)
    if parts.cut:
        return maximal_paths(edges, starts, max_hops).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    out = parts.whole.groupBy(F.size("nodes").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    if parts.tails is not None:
        begun = parts.begun.groupBy("id", F.size("nodes").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(begun.join(parts.tails, "id").select((F.col("_l") + F.col("hops")).alias("length"), (F.col("_n") * F.col("n")).alias("n")))
    return out.groupBy("length").agg(F.sum("n").alias("n"))
