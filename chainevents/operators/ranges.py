"""Range joins as equi-joins.

A range becomes a few nodes of a tree over block buckets, or the fixed-width
buckets it touches, and a block meets it at the node that holds both. Such a join
can be shuffled, broadcast by size, or split on skew; no side is ever compared as
a whole with the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainevents.schemas import BUCKET


def bucket_of(block: Column | str) -> Column:
    return F.call_function("div", F.col(block) if isinstance(block, str) else block, F.lit(BUCKET))


def blocks_of(low: int, high: int) -> tuple[int, int]:
    """First and last block of the buckets ``low .. high``: those of a bucket lie on the side of 0 that it lies on, and on both sides in bucket 0."""
    return low * BUCKET if low > 0 else (low - 1) * BUCKET + 1, high * BUCKET if high < 0 else (high + 1) * BUCKET - 1


def clipped(ranges: DataFrame, blocks: DataFrame, column: str = "block_number") -> DataFrame:
    """Cut ranges to the span of the given blocks, so that an open-ended range stays small.

    Adds ``lo`` and ``hi``; ranges that touch no part of the span are dropped.
    """
    span = blocks.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    lo = F.greatest("from_block", span.select("first").scalar())
    hi = F.least("to_block", span.select("last").scalar())
    # A null bound (no blocks at all) must drop the range, not widen it.
    return (
        ranges.withColumn("lo", lo)
        .withColumn("hi", hi)
        .where((F.col("lo") <= F.col("hi")) & span.select("first").scalar().isNotNull())
    )


def exploded(ranges: DataFrame, lo: str = "from_block", hi: str = "to_block") -> DataFrame:
    """One row per (range, touched bucket); reversed ranges touch none."""
    return ranges.where(F.col(lo) <= F.col(hi)).withColumn(
        "bucket", F.explode(F.sequence(bucket_of(lo), bucket_of(hi)))
    )


#: A node of one level spans so many (as a power of two) of the level below; the lowest level are the buckets.
_STEP = 4
_LEVELS = range(0, 52, _STEP)


def covering(ranges: DataFrame, lo: str = "from_block", hi: str = "to_block") -> DataFrame:
    """Ranges cut into nodes (``level``, ``node``) of a tree over the buckets; reversed ranges give none.

    A node is used where it lies inside the range's buckets and its parent does not, so a range of any width gives at
    most thirty nodes per level: their number grows with the logarithm of the width.
    """
    first, last = bucket_of(lo), bucket_of(hi)
    inside = lambda level: (  # noqa: E731  first and last node of a level within the buckets
        F.call_function("shiftright", first + ((1 << level) - 1), F.lit(level)),
        F.call_function("shiftright", last + 1, F.lit(level)) - 1,
    )
    some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("array() :: array<bigint>"))
    levels = []
    for level in _LEVELS:
        (a, b), (up_a, up_b) = inside(level), inside(level + _STEP)
        width = 1 << _STEP
        nodes = F.when(up_a <= up_b, F.concat(some(a, up_a * width - 1), some((up_b + 1) * width, b))).otherwise(some(a, b))
        levels.append(F.arrays_zip(F.array_repeat(F.lit(level), F.size(nodes)).alias("level"), nodes.alias("node")))
    return ranges.where(F.col(lo) <= F.col(hi)).select("*", F.inline(F.concat(*levels)))


def with_nodes(blocks: DataFrame, cut: DataFrame) -> DataFrame:
    """Blocks once for each level that ``cut`` has nodes of, with the node that holds them."""
    used = cut.agg(F.collect_set("level").alias("levels")).scalar()
    leveled = blocks.withColumn("level", F.explode(used))
    return leveled.withColumn("node", F.call_function("shiftright", bucket_of("block_number"), F.col("level")))


def containing(blocks: DataFrame, ranges: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Pairs of a block and a range that holds it, both ends inclusive.

    ``span`` supplies the block numbers that bound the ranges; pass a cheap
    projection of the stored table when ``blocks`` itself is costly to compute.
    """
    cut = covering(clipped(ranges, blocks if span is None else span), "lo", "hi").drop("lo", "hi")
    inside = F.col("b.block_number").between(F.col("r.from_block"), F.col("r.to_block"))
    same = (F.col("b.level") == F.col("r.level")) & (F.col("b.node") == F.col("r.node"))
    joined = with_nodes(blocks, cut).alias("b").join(cut.alias("r"), same & inside)
    return joined.select(*[F.col(f"b.{c}") for c in blocks.columns], *[F.col(f"r.{c}") for c in ranges.columns])


def overlapping(items: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Items whose (from_block, to_block) overlaps at least one range; one row per ``key``.

    Two ranges overlap if one of them holds the other's first block.
    """
    sound = items.where(F.col("from_block") <= F.col("to_block"))
    wanted = ranges.where(F.col("from_block") <= F.col("to_block")).select("from_block", "to_block").distinct()
    begins = sound.select(key, F.col("from_block").alias("block_number"))
    held = containing(begins, wanted).select(key)
    holding = containing(wanted.select(F.col("from_block").alias("block_number")).distinct(), sound.select(key, "from_block", "to_block")).select(key)
    return sound.join(held.union(holding).distinct(), key, "left_semi").dropDuplicates([key])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, whose last column is an integer position.

    Rows are numbered inside chunks of positions, and a running sum over the chunk
    counts gives each chunk its offset, so no task ever holds a whole large group.
    """
    *lead, position = order
    chunked = rows.withColumn("_chunk", bucket_of(position))
    unit = [*group, *lead, "_chunk"]
    sizes = chunked.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*lead, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*unit, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(position)) - 1
    placed = chunked.withColumn("_place", place).join(offsets, unit)
    return placed.withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint")).select(*rows.columns, name)
