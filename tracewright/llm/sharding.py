"""Sharding (operator 10).

Method: a permutation-filled lookup table. Each shard has a preference order
over the slots of a table of prime size m (slot = offset + j * skip mod m, both
from a hash of its name); the shards take turns, each claiming the first slot
of its order that is still free. A document's slot is a hash of its key modulo
m, so placement is one lookup; adding or removing a shard moves few others'
slots. The table has m rows whatever the size of the data, so it is broadcast.

The key is doc_id; a document without one is placed by its text. Repeated rows
go to the same shard; a row with neither goes by the empty key; an empty table has
no rows. Other columns, whatever their names, are carried along, but for `slot`
and `shard`, which are replaced. doc_id may be of any type; very long texts and
ties make no difference. Any number of shards has `parts` partitions for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed, without

N_SHARDS = 64
#: A prime of a hundred times the shards and more keeps them even within 1 %.
TABLE_SIZE = 7_919
#: Partitions of a shard.
PARTS = 4


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], m: int = TABLE_SIZE) -> np.ndarray:
    """The shard (by place in names) of each slot."""
    if not is_prime(m) or len(names) > m or not names or len({*names}) < len(names):
        raise ValueError("a prime table size, of at least as many slots as there are distinct shards, is needed")
    offset = np.array([_number("offset " + s) % m for s in names])
    skip = np.array([_number("skip " + s) % (m - 1) + 1 for s in names]) if m > 2 else np.ones(len(names), int)
    at = np.zeros(len(names), dtype=np.int64)
    table = np.full(m, -1)
    left = m
    while True:
        for i in range(len(names)):
            slot = (offset[i] + at[i] * skip[i]) % m
            while table[slot] >= 0:
                at[i] += 1
                slot = (offset[i] + at[i] * skip[i]) % m
            table[slot] = i
            at[i] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, m: int) -> Column:
    """60 bits of the key's MD5, modulo m: the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(m).cast("long"))


def _placed(df: DataFrame, names: list[str], m: int) -> DataFrame:
    """The columns of df by place, then slot, shard and the shard's number."""
    spark = df.sparkSession
    table = spark.createDataFrame([(int(s), names[i], int(i)) for s, i in enumerate(lookup_table(names, m))], "slot long, shard string, __number int")
    rows = renamed(df, "doc_id", "text")
    placed = rows.withColumn("slot", slot_of(F.coalesce(F.col("doc_id").cast("string"), "text"), m))
    return placed.join(F.broadcast(table), "slot", "left").select(*rows.columns, "slot", "shard", "__number")


def place(df: DataFrame, names: list[str] | None = None, m: int = TABLE_SIZE) -> DataFrame:
    """All columns of df, then slot and shard; no row moves."""
    df = without(df, "slot", "shard")
    return _placed(df, names or shard_names(N_SHARDS), m).drop("__number").toDF(*df.columns, "slot", "shard")


def shards(df: DataFrame, names: list[str] | None = None, m: int = TABLE_SIZE, parts: int = PARTS) -> DataFrame:
    """place(), with every shard's rows in `parts` partitions of its own: the one
    shuffle that writing a shard's files takes, without a task for a whole shard."""
    names, df = names or shard_names(N_SHARDS), without(df, "slot", "shard")
    placed = _placed(df, names, m)
    part = F.col("__number") * parts + F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts)).cast("int")
    return placed.repartitionById(len(names) * parts, part).drop("__number").toDF(*df.columns, "slot", "shard")


def oracle_sql(names: list[str] | None = None, m: int = TABLE_SIZE) -> str:
    names = names or shard_names(N_SHARDS)
    numbers = ", ".join(str(int(i)) for i in lookup_table(names, m))
    return f"""
WITH placed AS (
    SELECT d.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) % {m} AS slot
    FROM documents AS d
), numbers AS (SELECT [{numbers}] AS shard_of)
SELECT placed.*, printf('shard-%05d', shard_of[slot + 1]) AS shard FROM placed, numbers"""
