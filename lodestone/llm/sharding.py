"""Shard placement through a lookup table filled by preference permutations.

Shard ``i`` prefers the slots ``(offset + j * skip) mod m`` for j = 0, 1, ...;
``m`` is a prime, so each shard's preferences are a permutation of all slots.
The shards take turns, each claiming its first free preference, until the
table is full.  Adding or removing a shard moves few keys, and every shard
gets the same number of slots within one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4093
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))

#: The table is broadcast; this bounds its rows.
MOST_SLOTS = 1 << 20

_DIGITS = 5  # of a shard's number in the table's text form, in hex


def _number(text: str, first: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[first : first + 15], 16)


def fill(shards: list[str] | tuple[str, ...], slots: int) -> list[int]:
    """The table: the position in ``shards`` of each slot's owner.  It depends
    on the number of shards and slots alone and is made once, on the driver."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not len(shards) <= slots <= MOST_SLOTS or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no less than the shards and within the bound")
    offset = [_number(s, 0) % slots for s in shards]
    skip = [_number(s, 15) % (slots - 1) + 1 for s in shards]
    table, turn = [-1] * slots, [0] * len(shards)
    left = slots
    while True:
        for i in range(len(shards)):
            while table[at := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[at] = i
            left -= 1
            if not left:
                return table


def lookup_table(spark, shards: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard`` as a DataFrame of at most ``MOST_SLOTS`` rows."""
    text = "".join(f"{i:0{_DIGITS}x}" for i in fill(shards, slots))
    number = F.conv(F.substr(F.lit(text), (F.col("id") * _DIGITS + 1).cast("int"), F.lit(_DIGITS)), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), F.element_at(F.array(*map(F.lit, shards)), number + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its md5 modulo the table's size.  Null counts as the
    empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def assign(rows: DataFrame, key: str, shards: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` by the key column.

    No row is shuffled: the table is broadcast, bounded by ``MOST_SLOTS``.

    Defined cases: equal keys go to the same shard, null keys to that of the
    empty string; repeated rows stay; an empty table gives no rows; columns of
    ``rows`` that are named ``slot`` or ``shard`` are replaced.
    """
    placed = rows.withColumn("slot", slot_of(rows[key], slots)).drop("shard")
    return placed.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot")


def oracle(table: str, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """The same placement in DuckDB SQL; the table is filled turn by turn.

    Slots still free are kept as a list in each shard's turn, so this is for
    small tables of slots."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    n = len(shards)
    return f"""
WITH RECURSIVE names(i, shard) AS (VALUES {names}),
prefs AS (
  SELECT i, shard, ('0x' || substr(md5(shard), 1, 15))::BIGINT % {slots} AS off,
         ('0x' || substr(md5(shard), 16, 15))::BIGINT % ({slots} - 1) + 1 AS skip FROM names),
lists AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM prefs),
fill(step, taken, slot) AS (
  SELECT 0, repeat('0', {slots})::BITSTRING, -1::BIGINT
  UNION ALL
  SELECT step + 1, set_bit(taken, s::INTEGER, 1), s FROM (
    SELECT step, taken,
           list_filter(list_transform(range(0, {slots}), lambda j: (offs[step % {n} + 1] + j * skips[step % {n} + 1]) % {slots}),
                       lambda p: get_bit(taken, p::INTEGER) = 0)[1] AS s
    FROM fill, lists WHERE step < {slots}) AS turn),
lookup AS (SELECT slot, shard FROM fill JOIN names ON (step - 1) % {n} = i WHERE slot >= 0)
SELECT d.{key}, l.slot, l.shard
FROM (SELECT {key}, ('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM {table}) AS d
JOIN lookup AS l USING (slot)"""
