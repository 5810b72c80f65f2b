"""Sharding by a permutation-filled lookup table.

Each shard walks the table's slots in an order of its own (an offset and a skip,
both hashes of its name, modulo the prime size), and the shards take turns
claiming the next slot of their order that is free. The table is of fixed size,
so it is broadcast; placing a row is one hash and one lookup. When a shard comes
or goes few rows but its own move.

Defined results: a null key is a key of its own; repeated keys go to one shard;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the lookup table; a prime. Bounds what is broadcast (16 bytes an entry).
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The shard (its index) of each slot. A shard of weight w claims w slots a turn."""
    if not _is_prime(slots):
        raise ValueError(f"{slots} slots: the size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be some, distinct and no more than the slots")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one positive weight for each shard")
    at = [zlib.crc32(b"offset:" + s.encode()) % slots for s in shards]
    skip = [zlib.crc32(b"skip:" + s.encode()) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
    return table


def assign_shards(
    df: DataFrame,
    key_col: str,
    shards: Sequence[str],
    slots: int = SLOTS,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """(key, slot, shard) of every row of ``df``."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots, weights))), "slot int, shard int")
    slot = F.pmod(F.xxhash64(F.col(f"`{key_col}`").cast("string")), F.lit(slots)).cast("int")
    keyed = df.select(F.col(f"`{key_col}`").alias(key_col), slot.alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard")
