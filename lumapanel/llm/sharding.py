"""Sharding by jump consistent hashing (Lamping and Veach), in Spark expressions.

A key and the number of shards alone decide the shard; no table of the ring is
kept, and appending a shard moves only the rows that the new shard takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered

# The generator's multiplier, fixed by the published algorithm, in limbs of 22 bits.
MULTIPLIER = 2862933555777941757
LIMB = 1 << 22
_M0, _M1, _M2 = MULTIPLIER % LIMB, (MULTIPLIER >> 22) % LIMB, MULTIPLIER >> 44

# Jumps that nearly every key needs at most; the others go on in a second round.
FIRST_JUMPS = 24


def _l(x: int) -> Column:
    return F.lit(x).cast("long")


def jump_shards(key: Column, shards: int, grown: int) -> Column:
    """Struct (shard, grown): the shard of an integer key among ``shards`` and among ``grown`` >= ``shards``.

    The 64-bit product wraps around, which Spark's integers don't, so the state
    is held in three limbs. Jumps only go up, so one walk serves both counts.
    A null key walks as key 0.
    """
    if not 0 < shards <= grown:
        raise ValueError("shards must be positive and not above grown")
    key = F.coalesce(key.cast("long"), _l(0))
    start = F.struct(
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.shiftrightunsigned(key, 22).bitwiseAND(LIMB - 1).alias("k1"),
        key.bitwiseAND(LIMB - 1).alias("k0"),
        _l(0).alias("shard"),
        _l(0).alias("grown"),
        _l(0).alias("next"),
    )

    def jump(s: Column, _: Column) -> Column:
        p0 = s["k0"] * _M0 + 1
        p1 = s["k0"] * _M1 + s["k1"] * _M0 + F.shiftright(p0, 22)
        p2 = s["k0"] * _M2 + s["k1"] * _M1 + s["k2"] * _M0 + F.shiftright(p1, 22)
        k1, k2 = p1.bitwiseAND(LIMB - 1), p2.bitwiseAND((1 << 20) - 1)
        top = F.shiftleft(k2, 11) + F.shiftright(k1, 11) + 1
        moved = F.struct(
            k2.alias("k2"),
            k1.alias("k1"),
            p0.bitwiseAND(LIMB - 1).alias("k0"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"),
            s["next"].alias("grown"),
            F.floor((s["next"] + 1).cast("double") * (2147483648.0 / top.cast("double"))).alias("next"),
        )
        return F.when(s["next"] < grown, moved).otherwise(s)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(grown, FIRST_JUMPS))), start, jump)
    if grown > FIRST_JUMPS:
        rest = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(grown - FIRST_JUMPS)), s, jump)
        # Bound to a lambda variable so that the first walk is made once.
        first = F.transform(F.array(first), lambda s: F.when(s["next"] < grown, rest(s)).otherwise(s))[0]
    return F.struct(first["shard"].cast("int").alias("shard"), first["grown"].cast("int").alias("grown"))


def shard_rows(df: DataFrame, key: str, order: list[str], shards: int) -> DataFrame:
    """Put every row into a shard.

    Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot``, the
    gapless place in the shard from 0 by key and ``order``. Keys that aren't
    integers are hashed first; a null key is key 0. Repeated rows keep their
    own slots; an empty table gives none. ``df`` must not have these names.
    """
    kind = dict(df.dtypes)[key]
    number = F.col(key) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    both = jump_shards(number, shards, shards + 1)
    placed = df.withColumn("_both", both).select(
        *df.columns, F.col("_both.shard").alias("shard"), F.col("_both.grown").alias("grown_shard")
    )
    return numbered(placed, ["shard"], [key, *order], "slot")
