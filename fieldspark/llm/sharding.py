"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level with weighted hashes.

Every shard draws ``-ln(u) / weight`` from a hash of (key, shard). A rack's draw is the least of its shards', a region's
the least of its racks': the least of such draws is spread as one draw with the summed weight, so a child is chosen in
proportion to its weight at each level, and the descent to the least region, its least rack and that one's least shard
never leaves a subtree for another whose weights are as before. A key moves only out of a shard whose weight shrank or
into one whose weight grew, wherever a new shard stands in the tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import gapless_rank

#: Rows that one rank bucket holds on average.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """The first ``shards`` of a fixed sequence of equal shards, ``per_rack`` in each rack and ``racks`` in each region, so
    ``tree(n + 1)`` is ``grown(tree(n))``, whatever n is."""
    return [Shard(s, s // (racks * per_rack), s // per_rack) for s in range(shards)]


def grown(topology: Sequence[Shard], weight: float = 1.0, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """One more shard, in the last rack if it has room, else in a new rack of the last region if that has, else in a new
    region: all other weights stay, so rows move only into the new shard."""
    if not topology:
        return [Shard(0, 0, 0, weight)]
    last = topology[-1]
    shard = max(s.shard for s in topology) + 1
    if sum(s.rack == last.rack for s in topology) < per_rack:
        return [*topology, Shard(shard, last.region, last.rack, weight)]
    rack = max(s.rack for s in topology) + 1
    full = len({s.rack for s in topology if s.region == last.region}) >= racks
    return [*topology, Shard(shard, max(s.region for s in topology) + 1 if full else last.region, rack, weight)]


def reweighted(topology: Sequence[Shard], shard: int, weight: float) -> list[Shard]:
    """The topology with another weight for one shard."""
    return [replace(s, weight=weight) if s.shard == shard else s for s in topology]


def _draw(key: Column, s: Shard) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(s.shard)), 11)
    t = -F.ln((h.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(s.weight))
    return F.struct(t.alias("t"), *[F.lit(getattr(s, c)).alias(c) for c in ("region", "rack", "shard")])


def descend(key: Column, topology: Sequence[Shard]) -> Column:
    """Struct of draw, region, rack and shard of ``key``: the least shard of each rack, the least rack of each region, the
    least region. A null key is a key like others."""
    live = [s for s in topology if s.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")

    def least(rows: list[Shard], levels: tuple[str, ...]) -> Column:
        if not levels:
            draws = [_draw(key, s) for s in rows]
        else:
            draws = [least([s for s in rows if getattr(s, levels[0]) == child], levels[1:]) for child in sorted({getattr(s, levels[0]) for s in rows})]
        return draws[0] if len(draws) == 1 else F.array_min(F.array(*draws))

    return least(live, ("region", "rack"))


def place(key: Column, topology: Sequence[Shard]) -> Column:
    """The shard of ``key``."""
    return descend(key, topology)["shard"].cast("int")


def assign_shards(df: DataFrame, key: str, topology: Sequence[Shard], grown_topology: Sequence[Shard] | None = None) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (null without a grown topology); no shuffle, all other columns stay."""
    out = df.withColumn("shard", place(F.col(key), topology))
    return out.withColumn("grown_shard", place(F.col(key), grown_topology) if grown_topology else F.lit(None).cast("int"))


def shard_rows(df: DataFrame, key: str, order: list[str], topology: Sequence[Shard], grown_topology: Sequence[Shard] | None, buckets: int) -> DataFrame:
    """``assign_shards`` and ``slot``, the gapless place within the shard.

    Slots follow hash buckets, then ``key`` (null first) and ``order``; rows that are equal in all of these take
    neighbouring slots in any order. An empty table gives no rows. A hot key goes to one shard, as the law says, but
    to several buckets, as the bucket hash takes ``order`` too.
    """
    placed = assign_shards(df, key, topology, grown_topology).withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), key, *order), F.lit(buckets)))
    return gapless_rank(placed, ["shard"], "_bucket", [F.asc_nulls_first(key), *[F.asc_nulls_first(c) for c in order]], "slot").drop("_bucket")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of ``documents`` under law ``key``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty: size 1 and crc32 0. Columns other than doc_id and text are not read.
    """
    topology = tree(shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    buckets = max(1, docs.select("doc_id").count() // (BUCKET_ROWS * shards))
    out = shard_rows(rows, "doc_id", ["text_crc32", "size"], topology, grown(topology), buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
