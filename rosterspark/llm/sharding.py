"""Deterministic placement of rows by a hierarchical weighted hash tree: region, rack, shard.

Every region has a place for each rack it may ever hold, every rack one for each shard.  For a key, hashes draw the
times at which it arrives at a region: exponential gaps, as many arrivals as the region has places.  An arrival goes
down the tree: a hash draws the rack, a hash the shard, and the shard takes it with the chance of its weight to the
greatest weight there may be.  So the time of a region's first taken arrival is exponential at a rate of the region's
weight, whatever its racks weigh, and the region where that comes first is where the key goes: shards get keys in
proportion to their weights, from one draw for each region and one for each level below.

What an arrival draws depends on the key, the region and its own number, on no weight.  So a weight that changes moves
keys only out of its shard or into it, a rack's only out of that rack or into it, and a new shard takes keys only into
itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]
#: The multipliers of a common 64-bit mixer.
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def topology(shards: int, per_rack: int = 5, racks: int = 4, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards ``0 .. shards - 1`` filled into racks and regions in order; weight 1 unless given."""
    weights = weights or {}
    return [(s // (per_rack * racks), s // per_rack, s, float(weights.get(s, 1.0))) for s in range(shards)]


def mixed(keys: np.ndarray, region: int, arrival: int, what: int) -> np.ndarray:
    """64 bits for each key, region, arrival and purpose."""
    start = (region * 0x1000003 + arrival) * 2 + what + 1
    x = keys + np.uint64(start * _STEP & (1 << 64) - 1)
    for shift, by in zip((30, 27), _MIX):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def descend(keys: np.ndarray, leaves: list[Leaf], per_rack: int = 5, racks: int = 4, most: float = 1.0) -> np.ndarray:
    """The shard of each key (64-bit hashes)."""
    trees: dict[int, np.ndarray] = {}
    weights: dict[int, np.ndarray] = {}
    for region, rack, shard, weight in leaves:
        if not 0 <= weight <= most:
            raise ValueError(f"weights are from 0 to {most}")
        trees.setdefault(region, np.full((racks, per_rack), -1))[rack % racks, shard % per_rack] = shard
        weights.setdefault(region, np.zeros((racks, per_rack)))[rack % racks, shard % per_rack] = weight
    first, into = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int32)
    for region in sorted(trees):
        if not weights[region].any():
            continue
        time, waiting, arrival = np.zeros(len(keys)), np.arange(len(keys)), 0
        while len(waiting):
            own = keys[waiting]
            gap = ((mixed(own, region, arrival, 0) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            time[waiting] -= np.log(gap) / (racks * per_rack * most)
            early = time[waiting] < first[waiting]  # later ones cannot be the first any more
            waiting, own = waiting[early], own[early]
            drawn = mixed(own, region, arrival, 1)
            rack = ((drawn >> np.uint64(48)) * np.uint64(racks) >> np.uint64(16)).astype(np.int64)
            place_ = ((drawn >> np.uint64(32) & np.uint64(0xFFFF)) * np.uint64(per_rack) >> np.uint64(16)).astype(np.int64)
            chance = ((drawn & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / float(1 << 32) * most
            taken = chance < weights[region][rack, place_]
            hit = waiting[taken]
            first[hit], into[hit] = time[hit], trees[region][rack[taken], place_[taken]]
            waiting, arrival = waiting[~taken], arrival + 1
    return into


def place(rows: DataFrame, leaves: list[Leaf], key: str, into: str = "shard", per_rack: int = 5, racks: int = 4, most: float = 1.0) -> DataFrame:
    """``rows`` with the shard of column ``key`` in ``into``.  Rows with equal keys (null too) get the same shard.
    Weights are at most ``most``, which, like the numbers of places, is not to change while rows stay where they are."""
    if not any(weight > 0 for *_, weight in leaves):
        raise ValueError("no shard has a weight")

    @F.pandas_udf(T.IntegerType())
    def shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(descend(hashes.to_numpy(np.int64).view(np.uint64), leaves, per_rack, racks, most))

    return rows.withColumn(into, shard(F.xxhash64(key)))


def with_slots(rows: DataFrame, key: str, ties: tuple[str, ...] = (), chunks: int = 64) -> DataFrame:
    """``slot``: 0, 1, 2 ... within each ``shard``.  A shard is numbered in ``chunks`` parts by hash, so no task sorts a
    whole shard; the parts' sizes (shards x chunks counts, however many rows there are) give the offsets.  Within a
    part rows go by ``key`` and then ``ties``; rows equal in all of these are interchangeable."""
    chunked = rows.withColumn("__chunk", F.pmod(F.xxhash64(key, *ties), F.lit(chunks)).cast("int"))
    sizes = chunked.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("shard", "__chunk").orderBy(key, *ties)
    numbered = chunked.withColumn("__at", F.row_number().over(within) - 1)
    # shards x chunks bounds the broadcast table
    joined = numbered.join(F.broadcast(offsets), ["shard", "__chunk"])
    return joined.withColumn("slot", (F.col("__before") + F.col("__at")).cast("long")).drop("__chunk", "__at", "__before")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None, most: float = 1.0) -> DataFrame:
    """Per row of ``docs``: id, size (UTF-8 bytes and 16 for the row; null text has none), text_crc32, law, shard,
    slot and the shard with one more shard of weight 1.

    Law ``key``: the id and the tree decide, nothing else; rows with one id (or with none) share a shard, repeated
    rows get slots of their own, in order of id, size and checksum within a part.  Texts of any length count whole.  An
    empty table gives an empty one; further columns, whatever their names, are ignored."""
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(bytes_) + 16).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(rows, topology(shards, weights=weights), id_col, most=most)
    placed = place(placed, topology(shards + 1, weights=weights), id_col, "grown_shard", most=most)
    return with_slots(placed, id_col, ("size", "text_crc32")).select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards; see :func:`shard_documents`."""
    return shard_documents(table(spark, sf_dir, "documents"))
