"""Sharding by a hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import free_name, small, written


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard. An inner node weighs as much as its shards together."""

    name: str
    children: tuple[Node, ...] = ()
    own: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.shard]


def tree(weights: list[float], racks: int = 2, per_rack: int = 2) -> Node:
    """The shards 0 to len(weights) - 1, `per_rack` to a rack and `racks` racks to a region."""
    size, regions = racks * per_rack, []
    for r in range(0, len(weights), size):
        region = range(r, min(r + size, len(weights)))
        kids = [Node(f"g{r // size}/k{k // per_rack}", tuple(Node(f"s{s}", (), weights[s], s) for s in region if s // per_rack == k // per_rack)) for k in region[::per_rack]]
        regions.append(Node(f"g{r // size}", tuple(kids)))
    return Node("root", tuple(regions))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes, so rows move only into it.

    A shard put into an old region would raise that region's weight, and the rows that enter it would be drawn among all
    of its racks; movement would still stay within the subtrees whose weights changed, but not within the new shard."""
    s, g = len(root.shards()), len(root.children)
    return Node("root", (*root.children, Node(f"g{g}+{s}", (Node(f"g{g}+{s}/k", (Node(f"s{s}", (), weight, s),)),))))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of key and node: the child with the smallest wins, by weight's share."""
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def place(key: Column, root: Node) -> Column:
    """The shard (int) at which the key's descent ends. Only siblings' draws are compared, level by level.

    The tree is a table of each node's children, so that the expression grows with the levels and not with the shards."""
    nodes, table, depth, at = [root], [], 0, 0
    level = [root]
    while any(n.children for n in level):
        level, depth = [c for n in level for c in n.children], depth + 1
    while at < len(nodes):
        node = nodes[at]
        kids = [c for c in node.children if c.weight > 0]
        # a shard above the last level draws itself
        table.append([{"i": len(nodes) + k, "name": c.name, "w": c.weight} for k, c in enumerate(kids)] if node.children else [{"i": at, "name": node.name, "w": 1.0}])
        nodes.extend(kids)
        at += 1
    children = F.from_json(F.lit(json.dumps(table)), "array<array<struct<i:int,name:string,w:double>>>")
    shards = F.from_json(F.lit(json.dumps([n.shard for n in nodes])), "array<int>")
    here = F.lit(0)
    for _ in range(depth):
        here = F.array_min(F.transform(F.get(children, here), lambda c: F.struct(draw(key, c["name"], c["w"]).alias("d"), c["i"].alias("i"))))["i"]
    return F.get(shards, here)


def shard_documents(docs: DataFrame, root: Node, buckets: int = 1024) -> DataFrame:
    """docs with shard, grown_shard (with one more shard of weight 1) and slot, the row's place in its shard from 0, gapless.

    The shard depends on doc_id and the tree alone; all rows of one doc_id, and all without one, share a shard. Columns of
    these three names are replaced. Slots follow a hash bucket of the row (its columns but for the text) and then doc_id, so
    that no task numbers a whole shard or all rows of one doc_id; rows equal in doc_id and bucket are numbered in the order
    of their columns. An empty table gives no rows."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.drop("shard", "grown_shard", "slot")
    bucket, base, rank = (free_name(docs, c) for c in ("_bucket", "_base", "_rank"))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    dealt = {"shard": place(key, root), "grown_shard": place(key, grown(root)), bucket: F.pmod(F.xxhash64(key, *hashed), F.lit(buckets)).cast("int")}
    # at most shards x buckets rows from here on
    counts = rows.select(dealt["shard"].alias("shard"), dealt[bucket].alias(bucket)).groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    ordered = [F.col(f"`{f.name}`") for f in rows.schema if f.name != "doc_id" and "map<" not in f.dataType.simpleString()]
    within = Window.partitionBy("shard", bucket).orderBy("doc_id", *ordered)
    numbered = rows.withColumns(dealt).withColumn(rank, F.row_number().over(within))
    return numbered.join(small(written(bases, "bases")), ["shard", bucket]).withColumn("slot", F.col(base) + F.col(rank) - 1).drop(bucket, base, rank)
