"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends region -> rack -> shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from (key, child id), and the least draw wins,
so a child gets its share of the weight and a change of one child's weight moves rows
only into or out of that child: siblings keep their order among themselves.  Below the
changed child nothing else moves.  A new shard therefore joins as a new region of its
own (``plan``): rows that move go into it and nowhere else.

Numbering inside the shards is a two-pass prefix sum: rows are numbered within
(input partition, shard) and shifted by the counts of the earlier partitions, so no
task holds a whole shard or a hot key.

Cases: a null key is hashed as the empty string; null or empty texts count as no bytes;
repeated rows and equal keys land in the same shard with slots of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from expstudy.llm.common import let, written

#: Bytes that a stored row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``children`` is empty and ``shard`` set at a leaf."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def plan(shards: int, region: int = 10, rack: int = 5, planned: int = 40) -> Node:
    """``shards`` equal shards: the planned ones in regions of racks, later ones a region each."""
    def leaf(i: int) -> Node:
        return Node(f"shard{i}", shard=i)

    regions, first = [], min(shards, planned)
    for a in range(0, first, region):
        ids = range(a, min(a + region, first))
        racks = [Node(f"rack{b // rack}", tuple(leaf(i) for i in ids if b <= i < b + rack))
                 for b in range(a, a + len(ids), rack)]
        regions.append(Node(f"region{a // region}", tuple(racks)))
    for i in range(first, shards):
        regions.append(Node(f"grown{i}", (Node(f"grownrack{i}", (leaf(i),)),)))
    return Node("root", tuple(regions))


def _children(node: Node) -> dict[str, tuple[Node, ...]]:
    """The children of every inner node by its name."""
    out = {node.name: node.children} if node.children else {}
    for c in node.children:
        out |= _children(c)
    return out


def _draw(key: Column, child: Column) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 48 bits of md5(key / child)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["name"])), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 48))) / child["weight"]


def shard_of(key: Column, root: Node) -> Column:
    """The shard that ``key`` (a string) descends to: one weighted draw for each level."""
    inner = _children(root)
    child = lambda c: F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(c.shard).alias("shard"))
    tree = F.create_map(*[x for n, cs in inner.items() for x in (F.lit(n), F.array(*map(child, cs)))])
    level, at = [root], F.struct(F.lit(root.name).alias("name"), F.lit(0.0).alias("weight"), F.lit(root.shard).alias("shard"))
    while level := [c for n in level for c in n.children]:
        least = lambda node: F.array_min(F.transform(
            F.coalesce(tree[node["name"]], F.array(node)), lambda c: F.struct(_draw(key, c).alias("draw"), c.alias("child"))))["child"]
        at = let(at, least)
    return at["shard"]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """Each row's shard, its slot there, and its shard when one more shard joins."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(df.select(
        F.col(key).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        shard_of(k, plan(shards)).cast("int").alias("shard"),
        shard_of(k, plan(shards + 1)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "shards")
    # one row for each input partition and shard: as many as the scan has tasks, times the shards
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row")) - 1
    return (rows.withColumn("__local", local).join(base, ["shard", "__part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("__base") + F.col("__local")).cast("long").alias("slot"), "grown_shard"))
