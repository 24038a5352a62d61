"""Sharding by a hierarchical weighted hash tree.

A topology is regions of racks of weighted shards. A row descends it level by
level: every child of the node reached draws an exponential variate from the
hash of (child, key), divided by the child's weight, and the smallest draw wins.
A child is chosen in proportion to its weight, and a change of one weight only
moves rows into or out of the subtrees whose weights change: all other draws
stay as they were. A shard added as a region of its own takes rows only into
itself.

Defined results: a null key is hashed like any other value (all null keys meet
in one shard); null text has 0 bytes, so size 1 and CRC 0; repeated rows go to
the same shard and get slots of their own; an empty table gives an empty table.
Extra columns are not carried, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import running_total


@dataclass(frozen=True)
class Topology:
    """regions: {region: {rack: {shard id: weight}}}; every weight is positive, names are unique by level."""

    regions: Mapping[str, Mapping[str, Mapping[int, float]]]

    def __post_init__(self) -> None:
        weights = [w for racks in self.regions.values() for shards in racks.values() for w in shards.values()]
        if not weights or min(weights) <= 0:
            raise ValueError("a topology needs shards, all of positive weight")

    @classmethod
    def even(cls, shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Topology:
        """Shards 0 to shards-1 of weight 1, filled rack by rack."""
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for shard in range(shards):
            rack = shard // per_rack
            region = f"region{rack // racks_per_region}"
            regions.setdefault(region, {}).setdefault(f"{region}/rack{rack}", {})[shard] = 1.0
        return cls(regions)

    def with_new_region(self, shard: int, weight: float = 1.0) -> Topology:
        """One more shard in a region of its own, so that no old subtree changes its weight."""
        region = f"region-of-{shard}"
        return Topology({**self.regions, region: {f"{region}/rack": {shard: weight}}})

    def children(self, level: int) -> dict[str, list[tuple[str, float]]]:
        """For each node of a level, its children and their weights; level 0 is the root."""
        total = lambda racks: sum(sum(s.values()) for s in racks.values())
        if level == 0:
            return {"": [(name, total(racks)) for name, racks in self.regions.items()]}
        if level == 1:
            return {r: [(k, sum(s.values())) for k, s in racks.items()] for r, racks in self.regions.items()}
        return {k: [(str(s), w) for s, w in shards.items()] for racks in self.regions.values() for k, shards in racks.items()}


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """An exponential variate of rate `weight`, decided by (node, key) alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(node, key), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(uniform) / weight


def _step(key: Column, node: Column, children: dict[str, list[tuple[str, float]]]) -> Column:
    pairs = []
    for parent, kids in children.items():
        pairs += [F.lit(parent), F.array(*[F.struct(F.lit(k).alias("node"), F.lit(float(w)).alias("weight")) for k, w in kids])]
    draws = F.transform(F.element_at(F.create_map(*pairs), node), lambda c: F.struct(_draw(key, c["node"], c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(draws)["node"]


def place(df: DataFrame, key: str, topology: Topology, name: str) -> DataFrame:
    """Adds `name`, the shard id of each row."""
    df = df.withColumn("_node", F.lit(""))
    for level in range(3):
        df = df.withColumn("_node", _step(F.col(key), F.col("_node"), topology.children(level)))
    return df.withColumn(name, F.col("_node").cast("int")).drop("_node")


def shard_documents(docs: DataFrame, topology: Topology, grown: Topology | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, under a second topology, grown_shard.

    Slots number a shard's rows from 0 in order of (doc_id, CRC, size). Texts are
    read once and never shuffled; what is dealt out is a few numbers a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = place(slim, "doc_id", topology, "shard")
    slim = place(slim, "doc_id", grown, "grown_shard") if grown else slim.withColumn("grown_shard", F.lit(None).cast("int"))
    numbered = running_total(slim.withColumn("_one", F.lit(1).cast("long")), ["doc_id", "text_crc32", "size"], "_one", "slot", ["shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
