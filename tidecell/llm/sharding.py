"""Sharding by a permutation-filled lookup table.

Shards take turns; at its turn a shard claims the next free slot of its own preference order, until a table of prime
size is full. A key's hash picks a slot and the slot names the shard, so placement is one look-up in a table of fixed
size, whatever the number of rows, and few keys move when a shard comes or goes.

Edge cases: a null key is placed by its text; a null key and null text go to one slot; rows that repeat go to the same
shard; an empty table stays empty. Further columns are kept, but for ``slot`` and ``shard``, which are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE, SHARDS = 65_537, 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for each slot."""
    if not _is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest]
    slots, turn, left = [-1] * size, [0] * len(shards), size
    while left:
        for i in range(len(shards)):
            while slots[at := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            slots[at] = i
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 15 hexadecimal digits of the key's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, size))), "slot long, shard int")


def assign(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot and shard. What is broadcast has ``size`` rows, a constant."""
    names = [f"shard-{i:05d}" for i in range(n_shards)]
    text = F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))) if "text" in docs.columns else F.lit("text:")
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), text), size))
    return placed.join(F.broadcast(lookup(docs.sparkSession, names, size)), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 4) -> None:
    """One folder per shard. A hash of the slot deals each shard over several files, so no writer holds a whole shard."""
    assigned.repartition("shard", F.col("slot") % files_per_shard).write.partitionBy("shard").parquet(path)
