"""Which blocks are there, as bitmaps that runs merge by OR.

One row holds the blocks of a key in a slice of ``SLICE`` blocks, four kilobytes however many runs saw them. Islands come
out of a bitmap by shifting it by one bit: a block begins an island where the bit before it is not set and ends one where
the bit after it is not. Only pieces at the edge of a slice, two per slice at most, are looked at beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.operators.coverage import joined_at_edges
from chainevents.operators.signatures import SLICE, slice_of


def presence(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slice, blocks) from rows of (keys, block_number); repeated blocks count once, null ones not at all."""
    seen = blocks.where("block_number IS NOT NULL")
    return seen.groupBy(*keys, slice_of("block_number").alias("slice")).agg(F.bitmap_construct_agg(F.col("block_number") % SLICE).alias("blocks"))


def merged_presence(known: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """What either table saw; the same run merged twice changes nothing."""
    return known.unionByName(more).groupBy(*keys, "slice").agg(F.bitmap_or_agg("blocks").alias("blocks"))


def present_counts(present: DataFrame, keys: list[str]) -> DataFrame:
    """How many different blocks each key has, without unpacking a bitmap."""
    return present.groupBy(*keys).agg(F.sum(F.bitmap_count("blocks")).alias("n_blocks"))


def _set_bits(bytes_: Column) -> Column:
    """Places of the set bits in an array of bytes, in ascending order; bytes without one are passed over."""
    numbered = F.filter(F.transform(bytes_, lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda x: x["v"] != 0)
    eight = F.sequence(F.lit(0), F.lit(7))
    bits = lambda x: F.filter(eight, lambda b: F.call_function("shiftright", x["v"], b).bitwiseAND(1) == 1)
    return F.flatten(F.transform(numbered, lambda x: F.transform(bits(x), lambda b: x["k"] * 8 + b)))


def islands(present: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal ranges (keys, from_block, to_block) of the blocks that are there."""
    places = F.sequence(F.lit(1), F.lit(SLICE // 8))
    one = lambda k: F.conv(F.hex(F.substring(F.col("blocks"), k, F.lit(1))), 16, 10).cast("int")
    unpacked = present.withColumn("_bytes", F.transform(places, one))
    byte = lambda k: F.coalesce(F.get("_bytes", k), F.lit(0))
    shift = lambda name, v, n: F.call_function(name, v, F.lit(n))
    before = lambda v, k: shift("shiftleft", v, 1).bitwiseOR(shift("shiftright", byte(k - 1), 7))
    after = lambda v, k: shift("shiftright", v, 1).bitwiseOR(shift("shiftleft", byte(k + 1).bitwiseAND(1), 7))
    alone = lambda v, other: v.bitwiseAND(F.bitwise_not(other))
    edges = unpacked.select(
        *keys,
        "slice",
        F.transform("_bytes", lambda v, k: alone(v, before(v, k))).alias("_begins"),
        F.transform("_bytes", lambda v, k: alone(v, after(v, k))).alias("_ends"),
    )
    ranges = F.arrays_zip(_set_bits(F.col("_begins")).alias("b"), _set_bits(F.col("_ends")).alias("e"))
    pieces = edges.select(*keys, "slice", F.explode(ranges).alias("_r")).select(
        *keys, (F.col("slice") * SLICE + F.col("_r.b")).alias("from_block"), (F.col("slice") * SLICE + F.col("_r.e")).alias("to_block")
    )
    return joined_at_edges(pieces, keys, SLICE)
