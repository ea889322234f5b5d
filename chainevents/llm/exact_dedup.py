"""Exact dedup by a heavy-hitter split; DataFrame functions only.

A frequent-items sketch (Misra-Gries with bounded counters) per salt names digests that may be frequent. Their exact
winners come from one partial aggregation, are at most ``SALTS * CANDIDATES`` rows, and are broadcast: copies of a
heavy text meet their winner on the map side and are never shuffled. All other digests, each of which is rare, go
through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, narrow, packed, query, table

#: Counters of a sketch, items taken from it, and sketches: bounds of what is broadcast.
COUNTERS, CANDIDATES, SALTS = 4096, 256, 16


def heavy_winners(digests: DataFrame) -> DataFrame:
    """``digest, heavy_keep, heavy_size`` of the digests that the sketches name; exact, and at most SALTS * CANDIDATES rows."""
    salt = F.pmod(F.xxhash64("id", "digest"), F.lit(SALTS))
    named = (
        digests.groupBy(salt.alias("salt"))
        .agg(F.expr(f"approx_top_k(digest, {CANDIDATES}, {COUNTERS})").alias("items"))
        .select(F.expr("inline(items)"))
        .select(F.col("item").alias("digest"))
        .distinct()
    )
    return (
        digests.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("heavy_keep"), F.count(F.lit(1)).alias("heavy_size"))
        .where("heavy_size > 1")
    )


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("text", 256)).drop("text")


def dedup_report(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Of equal texts the row with the largest id stays, null ids lose to all others; of rows
    that repeat id and text one stays. An empty table gives an empty result; other columns are ignored.
    """
    digests = scratch.write(_digested(narrow(docs, id_col, text_col)), "digests")
    winners = scratch.write(heavy_winners(digests), "winners")
    met = digests.join(F.broadcast(winners), "digest", "left")
    beaten = F.col("heavy_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("heavy_keep"))
    copies = met.where(beaten).select("id", "heavy_keep", "heavy_size", F.lit(False).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    rest = (
        met.where(~beaten)
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("keep", F.max("id").over(group))
        .withColumn("place", F.row_number().over(group.orderBy(F.col("id").desc_nulls_last())))
        .select("id", F.coalesce("heavy_keep", "keep").alias("heavy_keep"), F.coalesce("heavy_size", "n").alias("heavy_size"), (F.col("place") == 1).alias("kept"), "digest")
    )
    return copies.unionByName(rest).select(
        F.col("id").alias("doc_id"), F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in :func:`dedup_report`."""
    winners = scratch.write(heavy_winners(_digested(narrow(docs, id_col, text_col))), "winners")
    rows = _digested(packed(docs, id_col, text_col)).join(F.broadcast(winners), "digest", "left")
    rows = rows.where(F.col("heavy_size").isNull() | F.col("id").eqNullSafe(F.col("heavy_keep")))
    first = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")


@query(
    "SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, "
    "sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
