"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight with u from md5(key, child);
the smallest draw wins, so a child wins in proportion to its weight and a draw depends on nothing but key, child and
weight. If a weight grows, rows only move into that child; inside subtrees whose weights stay as they were, nothing moves.
A new shard opens a region of its own (`Topology.grown`), therefore it takes rows only into itself.

Nulls, ties, repeats: a null key counts as the text "null"; equal keys go to the same shard; repeated rows stay, each with
its own slot. An empty table gives an empty result. Columns other than key and text aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "root"
#: Rows that one slot group holds on average; groups are sorted alone.
SLOT_GROUP_ROWS = 8192


@dataclass(frozen=True)
class Topology:
    """Leaves as (region, rack, shard, weight). Shard numbers are unique."""

    leaves: tuple[tuple[str, str, int, float], ...]

    @classmethod
    def regular(cls, shards: int, per_rack: int = 4, racks: int = 2) -> Topology:
        """Full regions of racks x per_rack shards of weight 1; each shard beyond them is a region of its own."""
        per_region = per_rack * racks
        full = shards // per_region * per_region
        leaves = [(f"r{s // per_region}", f"k{s % per_region // per_rack}", s, 1.0) for s in range(full)]
        return cls(tuple(leaves)) if full == shards else cls(tuple(leaves)).grown(shards - full)

    def grown(self, shards: int = 1, weight: float = 1.0) -> Topology:
        """With more shards, each in a region of its own; the other subtrees keep their weights."""
        first = 1 + max((leaf[2] for leaf in self.leaves), default=-1)
        return Topology(self.leaves + tuple((f"s{s}", "k0", s, weight) for s in range(first, first + shards)))

    def weighted(self, shard: int, weight: float) -> Topology:
        """With another weight for one shard."""
        return Topology(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.leaves))

    def children(self) -> dict[str, dict[str, float]]:
        """Of each inner node: its children and their weights, which are sums over their leaves."""
        out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for region, rack, shard, weight in self.leaves:
            out[ROOT][region] += weight
            out[region][f"{region}/{rack}"] += weight
            out[f"{region}/{rack}"][str(shard)] += weight
        return out


def unit(digest: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard of a text key: three weighted draws, one for each level."""
    table = F.create_map(*[
        part
        for node, below in topology.children().items()
        for part in (F.lit(node), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in below.items()]))
    ])

    def draw(child: Column) -> Column:
        cost = -F.log(unit(F.md5(F.concat_ws("|", key, child["node"])))) / child["weight"]
        return F.struct(cost.alias("cost"), child["node"].alias("node"))

    node = F.lit(ROOT)
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(table, node), draw))["node"]
    return node.cast("int")


def place(docs: DataFrame, topology: Topology, grown: Topology | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size in bytes, crc of the text, shard, shard in the grown tree, and slot in the shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
        key.alias("key"),
    )
    shards = len(topology.leaves)
    groups = max(1, -(-docs.count() // (shards * SLOT_GROUP_ROWS)))
    placed = keyed.select(
        "doc_id",
        F.md5(F.concat_ws("|", "key", F.lit("slot"))).alias("rank"),
        (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"),
        shard_of(F.col("key"), topology).alias("shard"),
        (shard_of(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("part", F.floor(unit(F.col("rank")) * groups).cast("int"))
    return _with_slots(placed)


def _with_slots(placed: DataFrame) -> DataFrame:
    """Gapless numbers in each shard: sizes of its groups give the group's first number, a sort in the group the rest."""
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("rank", "doc_id", "text_crc32", "size")
    return (
        placed.join(starts, ["shard", "part"])
        .withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"), "grown_shard")
    )
