"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

On every level a document draws a number for each child from a hash of its key and the child's name, scaled
by the child's weight, and descends to the smallest.  A weight that grows can only win documents for its own
subtree, so a new shard in a new region takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, table
from parlance.sizing import number_rows


@dataclass(frozen=True)
class Leaf:
    """A shard and the names of the nodes above it."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Leaf]:
    """Two regions of two racks of two shards each; every further shard comes as a region of its own.

    Fewer than eight shards are regions of their own as well.
    """
    def place(k: int) -> Leaf:
        if shards >= 8 and k < 8:
            return Leaf(f"region{k // 4}", f"rack{k // 2}", k)
        return Leaf(f"region-of-{k}", f"rack-of-{k}", k)

    return [place(k) for k in range(shards)]


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight for u in (0, 1) from 52 bits of a hash of key and node name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _descend(key: Column, nodes: dict[str, float]) -> Column:
    """Name of the child with the smallest draw; equal draws go to the smaller name."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    return F.array_min(F.array(*[F.struct(draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(nodes.items())]))["n"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that a key descends to; the weight of a node is the sum of the weights below it."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    by_region = _descend(key, {r: sum(x.weight for k in racks.values() for x in k) for r, racks in regions.items()})
    out = None
    for region, racks in regions.items():
        inside = None
        by_rack = _descend(key, {r: sum(x.weight for x in k) for r, k in racks.items()})
        for rack, shards in racks.items():
            last = _descend(key, {f"{rack}/{x.shard}": x.weight for x in shards})
            number = F.substring_index(last, "/", -1).cast("int")
            inside = F.when(by_rack == rack, number) if inside is None else inside.when(by_rack == rack, number)
        out = F.when(by_region == region, inside) if out is None else out.when(by_region == region, inside)
    return out


def assign_shards(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, grown_shard and slot (gapless from 0 per shard).

    The key alone decides the shard, so repeated rows and NULL keys (one key of their own) stay together.  A NULL
    or empty text has size 1.  Slots follow the key, then the checksum.  They come from a range-partitioned
    sort, so a shard may be larger than a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(F.col(id_col), leaves).alias("shard"), shard_of(F.col(id_col), grown).alias("grown_shard"))
    return number_rows(placed, [F.col(id_col), F.col("text_crc32")], ["shard"], "slot")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards, and where nine would put them."""
    out = assign_shards(table(spark, folder, "documents"), topology(8), topology(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
