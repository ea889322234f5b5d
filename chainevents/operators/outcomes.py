"""Block outcomes, failures per scope, the coverage decision and the run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.functions.expressions import reason_text
from chainevents.operators.ranges import bucket_of, clipped, containing, exploded
from chainevents.schemas import BUCKET


def block_outcome(scopes_in_range: Column, bloom_hits: Column, root_ok: Column, decode_failed: Column) -> Column:
    """Outcome class of one block; the first rule that applies wins."""
    return (
        F.when(F.coalesce(scopes_in_range, F.lit(0)) == 0, "OutsideRange")
        .when(F.coalesce(bloom_hits, F.lit(0)) == 0, "NoBloomMatch")
        .when(~root_ok, "VerifyFailed")
        .when(F.coalesce(decode_failed, F.lit(False)), "DecodeFailed")
        .otherwise("Evaluated")
    )


def failure_reason(outcome: Column) -> Column:
    return F.when(outcome == "VerifyFailed", "VerifyFailure").when(outcome == "DecodeFailed", "DecodeFailure")


def taint(failures: DataFrame, scopes: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """A failed block taints every scope whose range holds it, Bloom hit or not."""
    return containing(failures.select("block_number", "reason"), scopes.select("scope_id", "from_block", "to_block"), span)


def first_failure(failures: DataFrame, scopes: DataFrame, span: DataFrame) -> DataFrame:
    """(scope_id, failed_block, reason): each scope's first failure in block order.

    Buckets that lie wholly inside a scope answer with their own first failure;
    single blocks are looked at only in the buckets at the scope's ends.
    """
    kinds = {"VerifyFailure": "verify", "DecodeFailure": "decode"}
    firsts = [F.min(F.when(F.col("reason") == r, F.col("block_number"))).alias(c) for r, c in kinds.items()]
    numbered = failures.withColumn("bucket", bucket_of("block_number"))
    by_block = numbered.groupBy("bucket", "block_number").agg(*firsts)
    by_bucket = numbered.groupBy("bucket").agg(*firsts)
    pieces = exploded(clipped(scopes.select("scope_id", "from_block", "to_block"), span), "lo", "hi")
    start = F.col("bucket") * BUCKET
    pieces = pieces.withColumn("whole", (start >= F.col("lo")) & (start + (BUCKET - 1) <= F.col("hi")))
    inside = pieces.where("whole").join(by_bucket, "bucket").select("scope_id", *kinds.values())
    ends = (
        pieces.where("NOT whole").join(by_block, "bucket")
        .where(F.col("block_number").between(F.col("lo"), F.col("hi")))
        .select("scope_id", *kinds.values())
    )
    both = inside.unionByName(ends).groupBy("scope_id").agg(F.min("verify").alias("verify"), F.min("decode").alias("decode"))
    verify_first = F.coalesce(F.col("verify") <= F.col("decode"), F.col("verify").isNotNull())
    return both.select(
        "scope_id",
        F.least("verify", "decode").alias("failed_block"),
        F.when(verify_first, "VerifyFailure").otherwise("DecodeFailure").alias("reason"),
    )


def run_failure(flags: DataFrame) -> DataFrame:
    """One row from (source_failed, store_failed) flags: a source failure outranks a store failure."""
    return flags.agg(
        F.when(F.coalesce(F.bool_or("source_failed"), F.lit(False)), "SourceFailure")
        .when(F.coalesce(F.bool_or("store_failed"), F.lit(False)), "StoreFailure")
        .alias("run_reason")
    )


def coverage_decision(
    scopes: DataFrame,
    failures: DataFrame,
    gaps: DataFrame,
    run_reason: Column,
    coverage_write_failed: Column,
) -> DataFrame:
    """(scope_id, contract, reason, gap_from, gap_to, records): what a run may record per scope.

    Order of precedence: the scope's first block failure, the run-wide failure, a
    failed coverage write, then the first gap. ``records`` tells whether the
    present ranges count as covered; a gap alone does not withhold them.
    """
    joined = scopes.join(failures, "scope_id", "left").join(gaps, "scope_id", "left")
    withheld = F.coalesce("reason", run_reason)
    reason = (
        F.when(withheld.isNotNull(), withheld)
        .when(coverage_write_failed, "CoverageWriteFailed")
        .when(F.col("gap_from").isNotNull(), "NoSourceData")
    )
    in_gap = reason == "NoSourceData"
    return joined.select(
        "scope_id",
        F.col("address").alias("contract"),
        reason.alias("reason"),
        F.when(in_gap, F.col("gap_from")).alias("gap_from"),
        F.when(in_gap, F.col("gap_to")).alias("gap_to"),
        (withheld.isNull() & ~coverage_write_failed).alias("records"),
    )


def sync_report(decisions: DataFrame, failed_preparation: DataFrame) -> DataFrame:
    """One row per scope: covered, or incomplete with its reason and text."""
    prepared = decisions.select("scope_id", F.col("contract").alias("label"), "reason", "gap_from", "gap_to")
    unprepared = failed_preparation.select(
        "scope_id",
        F.coalesce("name", "address").alias("label"),
        F.lit("PreparationFailed").alias("reason"),
        F.lit(None).cast("bigint").alias("gap_from"),
        F.lit(None).cast("bigint").alias("gap_to"),
    )
    rows = prepared.unionByName(unprepared)
    return rows.withColumn("covered", F.col("reason").isNull()).withColumn(
        "reason_text", reason_text("reason", "gap_from", "gap_to")
    )


def report_summary(report: DataFrame) -> DataFrame:
    """One row: covered and incomplete counts, and whether the run is complete."""
    return report.agg(
        F.count_if("covered").alias("covered"),
        F.count_if(~F.col("covered")).alias("incomplete"),
        (F.count_if(~F.col("covered")) == 0).alias("complete"),
    )
