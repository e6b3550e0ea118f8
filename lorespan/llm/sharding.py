"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size; the shards take turns,
each claiming the first free slot in its order, until the table is full. A key's slot gives its shard, so
placement takes constant time, shards differ by at most one slot, and adding or dropping a shard moves few
keys. The table's size is a parameter, not a function of the data; it is built once on the driver and
joined as a broadcast relation, with native expressions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound of the broadcast table, in slots.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The index of the shard that holds each slot.

    A shard's preferences are offset, offset + skip, offset + 2 skip, ... modulo slots, with offset the
    first and skip (at least 1) from the next eight hex digits of the MD5 of its name.
    """
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, no more than slots")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:8], 16) % slots for d in digests]
    skip = [int(d[8:16], 16) % (slots - 1) + 1 for d in digests]
    table = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while table[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % slots
        table[at[s]] = s
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 15 hex digits of the MD5 of its text, modulo slots. Null stays null."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place_on_shards(rows: DataFrame, shards: list[str], slots: int = 65537, key_col: str = "doc_id") -> DataFrame:
    """``key_col``, ``slot`` and ``shard`` of every row; a key that has one of these two names leaves as ``key``.

    Equal keys share a shard. A null key has null slot and shard. Repeated rows stay, other columns are left
    out, and an empty table gives no rows.
    """
    table = lookup_table(shards, slots)
    spark = rows.sparkSession
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    owners = (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")).alias("slot", "owner"))
        .select("slot", F.element_at(names, F.col("owner") + 1).alias("shard"))
    )
    keyed = rows.select(F.col(f"`{key_col}`").alias("k")).withColumn("slot", slot_of(F.col("k"), slots))
    name = "key" if key_col in ("slot", "shard") else key_col
    return keyed.join(F.broadcast(owners), "slot", "left").select(F.col("k").alias(name), "slot", "shard")


def duckdb_sql(shards: list[str], slots: int, table: str = "documents", key: str = "doc_id") -> str:
    """The same table, filled turn by turn in a recursive query, and the same placement."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
WITH RECURSIVE
names(s, name) AS (VALUES {names}),
preferences AS (
  SELECT s, ('0x' || substr(md5(name), 1, 8))::BIGINT % {slots} AS first,
         ('0x' || substr(md5(name), 9, 8))::BIGINT % {slots - 1} + 1 AS skip FROM names),
ordered AS (
  SELECT s, list((first + i * skip) % {slots} ORDER BY i) AS slots_in_order
  FROM preferences, range({slots}) t(i) GROUP BY s),
fill(turn, free, owner, slot) AS (
  SELECT 0, list_transform(range({slots}), lambda x: true), -1, -1::BIGINT
  UNION ALL
  SELECT f.turn + 1, list_concat(f.free[1:c.slot], [false], f.free[c.slot + 2:]), f.turn % {len(shards)}, c.slot
  FROM fill f, LATERAL (
    SELECT list_filter(o.slots_in_order, lambda x: f.free[x + 1])[1] AS slot
    FROM ordered o WHERE o.s = f.turn % {len(shards)}) c
  WHERE f.turn < {slots}),
keyed AS (
  SELECT {key}, (('0x' || substr(md5({key}::VARCHAR), 1, 15))::BIGINT % {slots})::INTEGER AS slot FROM {table})
SELECT k.{key}, k.slot, n.name AS shard
FROM keyed k LEFT JOIN fill f ON f.slot = k.slot LEFT JOIN names n ON n.s = f.owner
"""
