"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, (offset + k * skip) modulo the prime table size, as its
order of preference. The shards take turns, each claiming the first free slot that it prefers, until the
table is full; a shard of weight w gets w turns a round. A key's place is its hash modulo the table size:
one look into a broadcast table whose size is fixed. Slots differ between shards by at most one per weight,
and when shards come or go few keys move between the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; at least a hundred slots for each shard keep the shares within one percent.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], weights: Sequence[int] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot. Shard names must differ, weights be positive whole numbers."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1 or sum(weights) > slots:
        raise ValueError("weights must be positive, one for each shard, and sum to at most the slots")
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    taken = 0
    while True:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                taken += 1
                if taken == slots:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hex digits of md5(key as text), modulo the slots. Null counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: Sequence[str], weights: Sequence[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (columns of these names are replaced, all others stay). Equal keys share a shard.

    A null key counts as the text ''. An empty table gives an empty table; other columns are not read.
    """
    table = lookup_table(shards, weights, slots)
    spark = rows.sparkSession
    placed = spark.createDataFrame(list(zip(range(slots), (shards[k] for k in table.tolist()), strict=True)), "number long, shard string")
    kept = rows.select(*(c for c in rows.columns if c not in ("slot", "shard")), slot_of(F.col(key), slots).alias("slot"))
    both = kept.join(F.broadcast(placed), kept["slot"] == placed["number"])  # the table has `slots` rows whatever the data
    return both.select(*(kept[c] for c in kept.columns), placed["shard"])


def write_shards(rows: DataFrame, path: str, key: str, shards: Sequence[str], weights: Sequence[int] | None = None, files: int = 1) -> None:
    """Write one folder for each shard, ``files`` files in each, rows dealt to them by their slot."""
    placed = place(rows, key, shards, weights)
    part = F.pmod(F.xxhash64("slot"), F.lit(files))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
