"""Consistent sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in its own order, ``offset + j * skip``. The
shards take turns; each claims its first slot that is still free. A key's slot is its hash modulo the
size, so placing a row is one lookup in a table of fixed size, and adding or removing a shard moves
few keys between the shards that stay. Everything is SQL functions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A prime above 100 slots per shard keeps the shares within about one per cent of each other.
SLOTS = 8191


def _hash(text: Column) -> Column:
    """60 bits of the md5, as a long; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): ``slots`` rows. Repeated shard names count once; no shard is an error."""
    shards = sorted(set(shards))
    if not shards or not _prime(slots) or slots < len(shards):
        raise ValueError("sharding needs at least one shard and a prime number of slots not below their number")
    n = len(shards)
    names = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in shards)
    hashed = "CAST(conv(substring(md5(concat(s, '#{k}')), 1, 15), 16, 10) AS BIGINT)"
    slot = f"(offset[t.i] + j * skip[t.i]) % {slots}"
    # The next free slot of the shard's order: look a little ahead, then further, then at all of it.
    ahead = ", ".join(
        f"get(filter(sequence(t.at, least(t.at + {w}L, {slots - 1}L)), j -> substring(state.taken, CAST(2 * ({slot}) + 1 AS INT), 2) = X'0000'), 0)"
        for w in (7, 255, slots)
    )
    # The state is the table as two bytes a slot (0: free) and each shard's position in its order. The
    # one-element arrays only name values.
    step = f"""
        transform(transform(array(named_struct('i', CAST(turn % {n} AS INT), 'at', state.next[CAST(turn % {n} AS INT)])),
            t -> named_struct('i', t.i, 'j', coalesce({ahead}))),
          c -> named_struct(
            'taken', overlay(state.taken PLACING codes[c.i] FROM CAST(2 * ({slot.replace('t.i', 'c.i').replace('j *', 'c.j *')}) + 1 AS INT) FOR 2),
            'next', transform(state.next, (x, m) -> IF(m = c.i, c.j + 1, x))))[0]"""
    filled = spark.sql(f"""
        WITH orders AS (SELECT names,
            transform(names, s -> {hashed.format(k=1)} % {slots}) AS offset,
            transform(names, s -> {hashed.format(k=2)} % {slots - 1} + 1) AS skip,
            transform(sequence(1, {n}), k -> unhex(lpad(hex(k), 4, '0'))) AS codes
            FROM (SELECT array({names}) AS names))
        SELECT names, aggregate(sequence(0L, {slots - 1}L),
            named_struct('taken', unhex(repeat('0000', {slots})), 'next', array_repeat(0L, {n})),
            (state, turn) -> {step}, state -> state.taken) AS taken FROM orders""")
    return (
        filled.select("names", "taken", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        .select("slot", F.expr("names[CAST(conv(hex(substring(taken, 2 * slot + 1, 2)), 16, 10) AS INT) - 1]").alias("shard"))
    )


def place(rows: DataFrame, key: str, lookup: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``. The lookup table has ``slots`` rows, so it may be broadcast.

    Rows of one key share a shard; a null key counts as the empty text; repeated rows stay; columns
    already named slot or shard are replaced; an empty table stays empty.
    """
    slotted = rows.drop("slot", "shard").withColumn("slot", (_hash(F.col(key).cast("string")) % slots).cast("int"))
    return slotted.join(F.broadcast(lookup), "slot")
