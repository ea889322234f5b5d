"""Counts and ranges over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainevents.functions.expressions import hex_quantity


def latest_block(events: DataFrame) -> DataFrame:
    """Highest stored block (NULL when empty), its served number and its hex form."""
    top = events.agg(F.max("block_number").alias("latest_block"))
    served = F.coalesce("latest_block", F.lit(0).cast("bigint"))
    return top.select("latest_block", served.alias("served_block"), hex_quantity(served).alias("hex_block"))


def indexed_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("block_number").alias("min_block"), F.max("block_number").alias("max_block"))


def count_events(events: DataFrame, contract: str | None = None) -> DataFrame:
    rows = events if contract is None else events.where(F.col("contract") == contract)
    return rows.agg(F.count(F.lit(1)).alias("event_count"))


def totals(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: all events and all contracts."""
    n_contracts = contracts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return events.agg(F.count(F.lit(1)).alias("event_count")).withColumn("contract_count", n_contracts)


def event_breakdown(events: DataFrame, contract: str) -> DataFrame:
    """Events of one contract per event name, by name."""
    rows = events.where(F.col("contract") == contract)
    return rows.groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count")).orderBy("event_name")


def counts_by_name(events: DataFrame) -> DataFrame:
    """The one grouped pass over the events that every count of the status comes from."""
    return events.groupBy("contract", "event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("block_number").alias("min_block"),
        F.max("block_number").alias("max_block"),
    )


def contract_counts(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Event count of every registered contract, zeros included, by address."""
    counts = events.groupBy("contract").agg(F.count(F.lit(1)).alias("n"))
    joined = contracts.join(counts, contracts.address == counts.contract, "left")
    return joined.select("address", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("event_count")).orderBy("address")


def rolled_counts(rollup: DataFrame) -> DataFrame:
    """The same, from a store's roll-up instead of its events."""
    return rollup.groupBy("contract", "event_name").agg(F.sum("n").alias("n"), F.min("min_block").alias("min_block"), F.max("max_block").alias("max_block"))


def rolled_totals(rollup: DataFrame, contracts: DataFrame) -> DataFrame:
    """``totals`` and ``indexed_range`` in one row, from the roll-up."""
    n_contracts = contracts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rollup.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("event_count"), F.min("min_block").alias("min_block"), F.max("max_block").alias("max_block")
    ).withColumn("contract_count", n_contracts)


def status_summary(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per contract: totals and the breakdown by event name, beside the dataset-wide facts.

    The events are aggregated once to one row per (contract, event name); all
    figures are rolled up from that small table.
    """
    return summary_of(counts_by_name(events), contracts)


def rolled_summary(rollup: DataFrame, contracts: DataFrame) -> DataFrame:
    """``status_summary`` from a store's roll-up; only counts by name are moved, the dataset-wide facts fold per task."""
    return summary_of(rolled_counts(rollup), contracts, rolled_totals(rollup, contracts).withColumnRenamed("max_block", "latest_block"))


def summary_of(by_name: DataFrame, contracts: DataFrame, overall: DataFrame | None = None) -> DataFrame:
    """The status from one row per (contract, event name): ``counts_by_name`` or ``rolled_counts``.

    ``overall`` has the dataset-wide ``event_count``, ``min_block`` and ``latest_block`` in one row, where they are known
    without the counts by name.
    """
    entries = F.array_sort(F.collect_list(F.struct("event_name", "n")))
    per_contract = by_name.groupBy("contract").agg(F.sum("n").alias("total_events"), entries.alias("event_breakdown"))
    overall = overall or by_name.agg(
        F.max("max_block").alias("latest_block"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"),
        F.min("min_block").alias("min_block"),
    )
    rows = contracts.join(per_contract, contracts.address == per_contract.contract, "left")
    return rows.select(
        "address",
        "name",
        F.coalesce("total_events", F.lit(0)).cast("bigint").alias("total_events"),
        "event_breakdown",
        overall.select("event_count").scalar().alias("event_count"),
        overall.select("min_block").scalar().alias("min_block"),
        overall.select("latest_block").scalar().alias("latest_block"),
        contracts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("contract_count"),
    ).orderBy("address")
