"""Sharding by a permutation-filled lookup table.

A table with a prime number of slots is filled in turns: each shard walks its
own permutation of the slots (offset and skip hashed from its name) and claims
the next free one.  A row's shard is the table's entry at its key's hash, a
constant-time look-up in a table of fixed size, and adding or removing a shard
moves few keys beside its own.

A weight gives a shard that many claims in a round.  The table has ``slots``
entries whatever the data's size, so its broadcast is bounded by the parameter.
Everything on the rows' path is built-in SQL: a hash, a modulus, an array look-up.

Defined cases: a null key has a hash of its own and so one fixed shard; repeated
keys share a shard; empty tables give no rows; columns of the input named like
one of the output's, in whatever case, are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.workspace import absent

#: Prime; about 100 slots a shard keep the loads within a few percent.
SLOTS = 4099


def _hash(text: str) -> int:
    return int.from_bytes(sha256(text.encode()).digest()[:8], "big")


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """Entry by slot: the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given once each")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime of at least the number of shards")
    turns = [max(1, int((weights or {}).get(s, 1))) for s in shards]
    at = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                left -= 1
                if not left:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of the md5 of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row, without a shuffle."""
    spark = df.sparkSession
    table = lookup_table(shards, slots, weights)
    entries = spark.createDataFrame([(i, shards[t]) for i, t in enumerate(table)], "slot int, shard string")
    kept = [F.col(f"`{c}`") for c in absent(df.columns, ("slot", "shard"))]
    placed = df.select(*kept, slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return placed.join(F.broadcast(entries), "slot").select(*kept, "slot", "shard")


def write_shards(df: DataFrame, path: str, parts: int = 1, codec: str = "zstd") -> DataFrame:
    """One folder a shard; ``parts`` files of each, so that no shard is bound to a
    single task.  Rows are dealt by slot and by the partition that they come from,
    which splits copies of one row as well.  Returns the table as written."""
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), "slot"), F.lit(parts))
    df.repartition(F.col("shard"), salt).write.option("compression", codec).partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
