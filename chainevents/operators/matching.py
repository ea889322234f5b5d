"""Matching blocks and logs to scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.functions.expressions import bloom_bit, bloom_digit, bloom_digit_set
from chainevents.operators.ranges import bucket_of, clipped, containing, exploded, numbered

_PROBES = range(6)


def scope_blocks(blocks: DataFrame, scopes: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """(scope, block) pairs: every block with each scope whose inclusive range holds it."""
    return containing(blocks, scopes, span)


# --- Bloom -----------------------------------------------------------------------


def bloom_words(values: DataFrame) -> DataFrame:
    """Fold (block_number, digest) rows into 32-bit Bloom words: (block_number, word, bits).

    Partial aggregation keeps at most 64 words per block and task, whatever the number of rows.
    """
    bit = F.explode(F.array(*[bloom_bit("digest", i) for i in range(3)])).alias("bit")
    return (
        values.select("block_number", bit)
        .groupBy("block_number", F.call_function("div", F.col("bit"), F.lit(32)).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % 32)).alias("bits"))
    )


def with_probes(targets: DataFrame, address_digest: str, topic_digest: str) -> DataFrame:
    """Turn the digests of a target's address and topic0 into six Bloom digit tests."""
    bits = [bloom_bit(d, i) for d in (address_digest, topic_digest) for i in range(3)]
    columns = {f"digit{i}": bloom_digit(b) for i, b in enumerate(bits)}
    columns |= {f"digits{i}": bloom_digit_set(b) for i, b in enumerate(bits)}
    return targets.withColumns(columns)


def bloom_hit(bloom: Column, target: str = "t") -> Column:
    """True when all six bits of a probed target are set in the Bloom text."""
    hit = F.lit(True)
    for i in _PROBES:
        digit = F.substring(bloom, F.col(f"{target}.digit{i}"), F.lit(1))
        hit = hit & (F.instr(F.col(f"{target}.digits{i}"), digit) > 0)
    return hit


def bloom_prefilter(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(scope, block) pairs whose ``bloom`` may hold any target of the scope.

    A scope without targets never matches.
    """
    same_scope = F.col("p.scope_id") == F.col("t.scope_id")
    return pairs.alias("p").join(targets.alias("t"), same_scope & bloom_hit(F.col("p.bloom")), "left_semi")


def bloom_candidates(blocks: DataFrame, targets: DataFrame, span: DataFrame) -> DataFrame:
    """Whole block rows that some target may hold, by range and ``bloom``.

    The targets carry their scope's range; they are the small side, so the wide
    block rows are filtered where they are read.
    """
    # Scopes that look for the same event in the same blocks are one target.
    probed = [c for c in targets.columns if c.startswith("digit")]
    cut = exploded(clipped(targets.select("from_block", "to_block", *probed).distinct(), span), "lo", "hi")
    inside = F.col("b.block_number").between(F.col("t.from_block"), F.col("t.to_block"))
    probe = (F.col("b.bucket") == F.col("t.bucket")) & inside & bloom_hit(F.col("b.bloom"))
    numbered = blocks.withColumn("bucket", bucket_of("block_number"))
    return numbered.alias("b").join(cut.alias("t"), probe, "left_semi").drop("bucket")


# --- logs ------------------------------------------------------------------------


def block_log_index(logs: DataFrame) -> DataFrame:
    """Number every log of a block in (tx_index, pos) order, matched or not."""
    return numbered(logs, ["block_number"], ["tx_index", "pos"], "log_index")


def zip_tx_hashes(receipts: DataFrame, hashes: DataFrame, zero: Column) -> DataFrame:
    """Receipts with the hash at their position; a list that is too short gives ``zero``.

    ``receipts`` has (block_number, tx_index), ``hashes`` has (block_number, tx_hashes).
    """
    joined = receipts.join(hashes, "block_number", "left")
    picked = F.coalesce(F.get("tx_hashes", F.col("tx_index").cast("int")), zero)
    return joined.withColumn("tx_hash", picked).drop("tx_hashes")


def match_logs(logs: DataFrame, registry: DataFrame) -> DataFrame:
    """Logs whose address and first topic are known to the registry, with its columns."""
    known = logs.where(F.col("topic0").isNotNull())
    return known.join(registry, ["address", "topic0"])
