"""Gaps and islands over block numbers.

Work inside a bucket is bounded by the bucket width; only pieces that touch a
bucket edge (at most two per bucket) are looked at per scope, so one scope that
holds most of the data never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainevents.operators.ranges import bucket_of, clipped, exploded
from chainevents.schemas import BUCKET

_COVERED_KEY = ["contract", "from_block", "to_block", "source"]


def present_ranges(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the distinct blocks of each key into maximal ranges (keys, from_block, to_block)."""
    blocks = F.array_sort(F.collect_set("block_number"))
    per_bucket = pairs.withColumn("bucket", bucket_of("block_number")).groupBy(*keys, "bucket").agg(blocks.alias("blocks"))
    at = lambda i: F.get("blocks", i)
    starts = F.filter("blocks", lambda b, i: (i == 0) | (at(i - 1) != b - 1))
    ends = F.filter("blocks", lambda b, i: (i == F.size("blocks") - 1) | (at(i + 1) != b + 1))
    pieces = per_bucket.select(
        *keys, F.inline(F.arrays_zip(starts.alias("from_block"), ends.alias("to_block"))).alias("from_block", "to_block")
    )
    return joined_at_edges(pieces, keys, BUCKET)


def joined_at_edges(pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Ranges found within stretches of ``width`` blocks, those that meet across an edge as one."""
    at_edge = (F.col("from_block") % width == 0) | (F.col("to_block") % width == width - 1)
    in_order = Window.partitionBy(*keys).orderBy("from_block")
    opens = F.coalesce(F.col("from_block") != F.lag("to_block").over(in_order) + 1, F.lit(True)).cast("int")
    edge = pieces.where(at_edge).withColumn("opens", opens).withColumn("island", F.sum("opens").over(in_order))
    merged = (
        edge.groupBy(*keys, "island")
        .agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block"))
        .drop("island")
    )
    return pieces.where(~at_edge).unionByName(merged)


def clip_to_scopes(islands: DataFrame, scopes: DataFrame, keys: list[str], span: DataFrame) -> DataFrame:
    """Present ranges of every scope, cut out of the ranges present at all.

    All scopes read the same blocks, so blocks are merged once and only ranges are
    met with scopes; a pair is kept in the first bucket the two share.
    """
    held = exploded(islands.select("from_block", "to_block"))
    wanted = exploded(clipped(scopes.select(*keys, "from_block", "to_block"), span), "lo", "hi")
    meet = (
        (F.col("i.bucket") == F.col("s.bucket"))
        & (F.col("i.to_block") >= F.col("s.from_block"))
        & (F.col("i.from_block") <= F.col("s.to_block"))
        & (F.col("i.bucket") == F.greatest(bucket_of("i.from_block"), bucket_of("s.lo")))
    )
    return held.alias("i").join(wanted.alias("s"), meet).select(
        *[F.col(f"s.{k}") for k in keys],
        F.greatest("i.from_block", "s.from_block").alias("from_block"),
        F.least("i.to_block", "s.to_block").alias("to_block"),
    )


def missing_ranges(scopes: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-ranges of each scope's inclusive range that no present range covers."""
    wanted = scopes.select(*keys, F.col("from_block").alias("scope_from"), F.col("to_block").alias("scope_to"))
    placed = present.withColumn("bucket", bucket_of("from_block"))
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("from_block")
    firsts = placed.groupBy(*keys, "bucket").agg(F.min("from_block").alias("first"))
    over_buckets = Window.partitionBy(*keys).orderBy("bucket")
    following = firsts.withColumn("first_after", F.lead("first").over(over_buckets)).drop("first")
    inner = (
        placed.withColumn("next_here", F.lead("from_block").over(in_bucket))
        .join(following, [*keys, "bucket"])
        .join(wanted, keys)
        .select(
            *keys,
            (F.col("to_block") + 1).alias("gap_from"),
            (F.coalesce("next_here", "first_after", F.col("scope_to") + 1) - 1).alias("gap_to"),
        )
    )
    lowest = firsts.groupBy(*keys).agg(F.min("first").alias("lowest"))
    leading = wanted.join(lowest, keys, "left").select(
        *keys, F.col("scope_from").alias("gap_from"), F.coalesce(F.col("lowest") - 1, "scope_to").alias("gap_to")
    )
    return leading.unionByName(inner).where(F.col("gap_from") <= F.col("gap_to"))


def first_gap(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Only the lowest gap of each key is reported."""
    return gaps.groupBy(*keys).agg(
        F.min("gap_from").alias("gap_from"), F.min_by("gap_to", "gap_from").alias("gap_to")
    )


def range_covered(requests: DataFrame, covered: DataFrame) -> DataFrame:
    """Requests (contract, from_block, to_block) that ONE recorded range contains.

    Of the recorded ranges that start no later than a request, the one that reaches furthest decides; this holds for
    open-ended ranges and reversed requests as well. Starts and requests of a contract are put in order together, the
    furthest reach so far runs along, and what earlier stretches of blocks reached is carried in, so that a contract
    with a long history is worked on in parts.
    """
    starts = covered.select("contract", F.col("from_block").alias("at"), F.lit(0).alias("kind"), F.col("to_block").alias("reach"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("bigint").alias("until"))
    probes = requests.select("contract", F.col("from_block").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("reach"), "request_id", F.col("to_block").alias("until"))
    points = starts.unionByName(probes).withColumn("stretch", bucket_of("at"))
    furthest = points.groupBy("contract", "stretch").agg(F.max("reach").alias("reached"))
    earlier = Window.partitionBy("contract").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = furthest.select("contract", "stretch", F.max("reached").over(earlier).alias("carried"))
    so_far = Window.partitionBy("contract", "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = points.withColumn("here", F.max("reach").over(so_far)).where("kind = 1").join(carried, ["contract", "stretch"])
    held = running.where(F.greatest("here", "carried") >= F.col("until"))
    return held.select("request_id", "contract", F.col("at").alias("from_block"), F.col("until").alias("to_block")).dropDuplicates(["request_id"])


def new_coverage(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming ranges that insert-or-ignore would add: one record of each, and none that is recorded already."""
    sourced = incoming.withColumn("source", F.lit("era1"))
    added = sourced.groupBy(*_COVERED_KEY).agg(F.min("recorded_at").alias("recorded_at"))
    return added.join(existing.select(*_COVERED_KEY), _COVERED_KEY, "left_anti")
