"""Sharding by a permutation-filled lookup table, in SQL alone.

Every shard has its own order of preference over the slots of a table of prime
size: slot offset + j * skip (mod size) for its j-th choice, offset and skip from a
digest of its name. Shards take turns, each claiming the free slot it likes best,
until all are taken; so shards get as many slots as one another, give or take one,
and few slots change hands when a shard leaves. A key's slot is its digest modulo
the size; the table, whose size is a parameter, is broadcast, and placement is one
lookup.

Rows: a null key is placed as the empty string; equal keys share a shard, so
repeated rows do; an empty table gives no rows; other columns are kept as they
are unless named slot or shard, which are replaced. A hot key's rows share one shard
by definition: placing them needs no shuffle, so no task gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards, and slots of the table: a prime, more than a hundred times the shards.
SHARDS, SIZE = 16, 2039


def _digest(text: Column, begin: int) -> Column:
    """Eight hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), begin, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard) for every slot.

    A shard's next choice is, among the free slots, the one of least rank in its
    permutation: (slot - offset) / skip modulo the size, with the skip's inverse by
    Fermat's theorem. The turns are a fold over the free slots.
    """
    if shards < 1 or shards > size or any(size % d == 0 for d in range(2, int(size**0.5) + 1)) or size < 2:
        raise ValueError("the table's size must be a prime, and shards at least 1 and at most that")
    power = [int(b) for b in bin(size - 2)[2:]]
    name = F.concat(F.lit("shard-"), F.col("shard").cast("string"))
    ids = spark.range(shards).select(F.col("id").alias("shard"))
    seeded = ids.select("shard", (_digest(name, 1) % size).alias("offset"), (_digest(name, 9) % (size - 1) + 1).alias("skip"))
    inverse = F.lit(1).cast("long")
    for bit in power:
        inverse = inverse * inverse % size
        if bit:
            inverse = inverse * F.col("skip") % size
    orders = seeded.select("shard", "offset", inverse.alias("inverse")).groupBy().agg(F.sort_array(F.collect_list(F.struct("shard", "offset", "inverse"))).alias("orders"))
    fill = f"""posexplode(aggregate(
        sequence(0, {size - 1}),
        named_struct('free', sequence(0L, {size - 1}L), 'taken', cast(array() AS array<bigint>)),
        (state, turn) -> transform(
            array(array_min(transform(state.free, s -> pmod((s - orders[turn % {shards}].offset) * orders[turn % {shards}].inverse, {size}) * {size} + s)) % {size}),
            best -> named_struct('free', filter(state.free, s -> s <> best), 'taken', array_append(state.taken, best)))[0],
        state -> state.taken)) AS (turn, slot)"""
    return orders.selectExpr(fill).select("slot", (F.col("turn") % shards).cast("int").alias("shard"))


def slot_of(key: str, size: int = SIZE) -> Column:
    return (_digest(F.coalesce(F.col(key).cast("string"), F.lit("")), 1) % size).alias("slot")


def place(rows: DataFrame, key: str, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """Adds slot and shard to rows; only the table, of ``size`` rows, is broadcast."""
    table = lookup_table(rows.sparkSession, shards, size)
    return rows.withColumn("slot", slot_of(key, size)).drop("shard").join(F.broadcast(table), "slot", "left").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


#: The same table by a recursive query, a turn a step, and the same placement.
ORACLE = f"""
WITH RECURSIVE names AS (
  SELECT i AS shard, ('0x' || substr(md5('shard-' || i), 1, 8))::BIGINT % {SIZE} AS o, ('0x' || substr(md5('shard-' || i), 9, 8))::BIGINT % {SIZE - 1} + 1 AS k
  FROM range({SHARDS}) t(i)),
orders AS (
  SELECT shard, list((o + j * k) % {SIZE} ORDER BY j) AS choice FROM names, range({SIZE}) r(j) GROUP BY shard),
every AS (SELECT list(choice ORDER BY shard) AS choices FROM orders),
fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, pick, list_append(taken, pick)
  FROM (SELECT turn, taken, list_filter(choices[turn % {SHARDS} + 1], lambda s: NOT list_contains(taken, s))[1] AS pick FROM fill, every WHERE turn < {SIZE}))
SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SIZE} AS slot, ((f.turn - 1) % {SHARDS})::INT AS shard
FROM documents JOIN fill f ON f.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SIZE}
"""
