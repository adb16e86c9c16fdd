"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import whole_text

SMALLEST, LARGEST = 2, 1_000_003


def _hash(text: str, salt: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The shard (its number) of each slot.

    Each shard prefers the slots in the order offset, offset + skip, ... modulo the prime number of
    slots, both drawn from its name. The shards take turns, each claiming the first slot on its
    list that is still free, until none is left. So shards hold equally many slots, give or take
    one, and when a shard leaves or joins nearly all other slots stay where they are.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, at least one")
    if slots < len(shards) or slots > LARGEST or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots has to be a prime number, not below the number of shards and not above a million")
    step = [_hash(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    position = [_hash(s, "offset") % slots for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[position[shard]] >= 0:
                position[shard] = (position[shard] + step[shard]) % slots
            table[position[shard]] = shard
            free -= 1
            if not free:
                return table


@dataclass(frozen=True)
class Sharding:
    """``slots``: a prime well above the number of shards; the table has one small row for each, a million at most."""

    shards: tuple[str, ...]
    slots: int = 65537

    def slot(self, key: Column) -> Column:
        """From the first 15 hexadecimal digits of the key's MD5; a null key is an empty one."""
        digits = F.substring(F.md5(F.encode(whole_text(key.cast("string")), "UTF-8")), 1, 15)
        return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(self.slots)).cast("int")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s, self.shards[s]) for i, s in enumerate(fill_table(list(self.shards), self.slots))]
        return spark.createDataFrame(rows, T.StructType.fromDDL("slot int, shard int, shard_name string"))

    def place(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """All rows and columns of ``docs`` as struct ``row``, with slot, shard and shard_name. Rows never move:
        the table is broadcast, which its number of slots bounds."""
        placed = docs.select(F.struct("*").alias("row"), self.slot(F.col(id_col)).alias("slot"))
        return placed.join(F.broadcast(self.table(docs.sparkSession)), "slot")

    def write(self, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
        """One folder ``shard=N`` for each shard. Rows are balanced over the writing tasks, so large shards are split."""
        rows = self.place(docs, id_col).select("row.*", F.col("shard").alias("_shard"))
        rows.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)
