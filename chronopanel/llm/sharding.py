"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order of all slots of a prime-sized table (offset and skip from hashes of its name); the
shards take turns claiming their next free slot until the table is full. The table is as large as its prime, whatever the
data, so it is broadcast; a row is placed by one hash and one lookup. Adding or removing a shard moves few slots.

Defined cases: a null key has a slot of its own hash; repeated keys go to one shard; columns named slot or shard are
replaced, others are kept; rows are moved whole, by write_shards only, so texts may be long, and a key of very many rows is split
over tasks; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLOTS = 65537
MAX_SLOTS = 1_000_003


def _hash(name: str, kind: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{kind}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that claimed each slot."""
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, and fewer than slots")
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = fill(shards, slots)
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner)], "slot int, shard string")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard; slots bounds the broadcast."""
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot")


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What write_shards wrote; schema is that of place, so names of shards stay text."""
    return spark.read.schema(schema).parquet(path)


def write_shards(df: DataFrame, shards: list[str], path: str, key: str = "doc_id", rows_a_file: int = 1_000_000) -> StructType:
    """df as Parquet, a folder a shard; rows are brought together by shard, and large shards are split over tasks. Returns what to read."""
    placed = place(df, shards, key)
    placed.hint("rebalance", "shard").write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return StructType([*(f for f in placed.schema if f.name != "shard"), placed.schema["shard"]])


def sharded(df: DataFrame, shards: list[str], path: str, key: str = "doc_id") -> DataFrame:
    """The rows of df read back from the shards that they were written to."""
    return read_shards(df.sparkSession, path, write_shards(df, shards, path, key))
