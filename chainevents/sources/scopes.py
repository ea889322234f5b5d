"""Scope tables: clean-up of bounds and events, and the union range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.schemas import BUCKET

FIELDS = ("name", "address", "events", "from_block", "to_block", "abi_override", "impl_address")
_LARGEST = float((1 << 63) - BUCKET)


def block_bound(text: Column | str) -> Column:
    """``12376729``, ``16.5M`` or ``12.3K`` to a block number; NULL when malformed or negative."""
    text = F.col(text).cast("string") if isinstance(text, str) else text
    scale = F.when(F.endswith(text, F.lit("M")), 1_000_000.0).when(F.endswith(text, F.lit("K")), 1_000.0)
    scaled = F.regexp_replace(text, "[MK]$", "").try_cast("double")
    whole = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    rounded = F.when((scaled >= 0) & (scaled * scale < _LARGEST), F.round(scaled * scale).cast("bigint"))
    return F.when(scale.isNull(), whole).otherwise(rounded)


def validate_scopes(requested: DataFrame) -> DataFrame:
    """Parse the bounds of every scope row and add ``error`` (NULL when the row is usable)."""
    unknown = set(requested.columns) - set(FIELDS) - {"scope_id"}
    if unknown:
        raise ValueError(f"unknown scope fields: {', '.join(sorted(unknown))}")
    raw_from, raw_to = F.col("from_block").cast("string"), F.col("to_block").cast("string")
    parsed = requested.withColumn("_from", block_bound(raw_from)).withColumn("_to", block_bound(raw_to))
    bad_bound = F.col("_from").isNull() | (raw_to.isNotNull() & F.col("_to").isNull())
    stars = F.exists("events", lambda e: e == "*")
    error = (
        F.when(bad_bound, "InvalidBlock")
        .when(F.col("_to").isNull(), "ToBlockRequired")
        .when(F.col("_to") < F.col("_from"), "InvalidRange")
        .when(F.coalesce(F.size("events"), F.lit(0)) < 1, "NoEvents")
        .when(stars & (F.size("events") > 1), "WildcardMixed")
    )
    return (
        parsed.withColumn("error", error)
        .drop("from_block", "to_block")
        .withColumnsRenamed({"_from": "from_block", "_to": "to_block"})
    )


def union_range(scopes: DataFrame) -> DataFrame:
    """One row: the span that covers every scope (0 and the largest block when there is none)."""
    return scopes.agg(
        F.coalesce(F.min("from_block"), F.lit(0)).cast("bigint").alias("from_block"),
        F.coalesce(F.max("to_block"), F.lit((1 << 63) - 1)).cast("bigint").alias("to_block"),
    )
