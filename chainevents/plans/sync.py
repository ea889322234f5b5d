"""The sync run: archive files in, events, coverage and a report out.

Every costly stage is written once to the run's folder on the shared file
system and read back, so that a lost executor repeats only its own tasks and no
file is decoded twice.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.functions.abi import checksum_address, keccak_hex
from chainevents.functions.expressions import hex_text
from chainevents.operators import blocks as block_ops
from chainevents.operators import coverage, decode, matching, outcomes
from chainevents.sources import checksums, registry
from chainevents.sources.scopes import validate_scopes
from chainevents.sources.store import Store
from chainevents.sources.work import Work

Audit = str | Callable[[DataFrame], DataFrame]
_KEYS = ["scope_id"]
_ADDRESS = r"\A0x[0-9a-fA-F]{40}\z"
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SyncResult:
    """``report`` has one row per scope; ``total_events`` counts the rows that the store took; ``faults`` are the texts
    of failed writes."""

    total_events: int
    report: DataFrame
    faults: tuple[str, ...] = ()

    @property
    def is_complete(self) -> bool:
        return self.report.where("NOT covered").limit(1).isEmpty()


def checked_scopes(requested: DataFrame) -> DataFrame:
    """Valid scopes with checksummed addresses; any unusable row is an error for the whole run."""
    rows = validate_scopes(requested)
    malformed = ~F.coalesce(F.col("address").rlike(_ADDRESS), F.lit(False))
    rows = rows.withColumn("error", F.when(malformed, "InvalidAddress").otherwise(F.col("error")))
    bad = rows.where("error IS NOT NULL").select("scope_id", "address", "error").limit(1).collect()
    if bad:
        raise ValueError(f"scope {bad[0].scope_id} ({bad[0].address}): {bad[0].error}")
    text = lambda c: checksum_address(F.unhex(F.substring(c, 3, 40)))
    blank = F.lit(None).cast("string")
    for optional in ("name", "abi_override", "impl_address"):
        if optional not in rows.columns:
            rows = rows.withColumn(optional, blank)
    implementation = F.when(F.col("impl_address").isNotNull(), text(F.coalesce("impl_address", "address")))
    return rows.drop("error").withColumn("address", text(F.col("address"))).withColumn("impl_address", implementation)


def prepare(scopes: DataFrame, store: Store, overrides: DataFrame, snapshot: DataFrame, run: Work) -> tuple[DataFrame, DataFrame]:
    """Resolve and compile the events of every scope: (registry, scopes with ``error``).

    Newly resolved ABIs are saved first and resolution is repeated, so that a
    second scope on the same contract finds the first one's ABI in the cache.
    """
    first = run.keep("abi_first", registry.resolve_abis(scopes, store.contracts, overrides, snapshot))
    earliest = Window.partitionBy("address").orderBy("scope_id")
    saved = first.where("to_save").withColumn("rank", F.row_number().over(earliest)).where("rank = 1")
    if not saved.limit(1).isEmpty():
        store.upsert_contracts(saved.select("address", "name", registry.normalized_abi("abi_json").alias("abi_json")))
    resolved = run.keep("abi", registry.resolve_abis(scopes, store.contracts, overrides, snapshot))
    events = registry.abi_events(resolved.where("error IS NULL").select("scope_id", "abi_json"))
    wanted = registry.wanted_events(resolved.where("error IS NULL"), events)
    known = wanted.where("error IS NULL").drop("error", "requested")
    described = run.keep("described", registry.with_signatures(known))
    blank = F.lit(None).cast("string")
    faults = (
        wanted.where("error IS NOT NULL").select("scope_id", "error", blank.alias("layout_error"))
        .unionByName(described.select("scope_id", blank.alias("error"), "layout_error"))
    )
    errors = registry.scope_preparation(resolved, faults)
    prepared = run.keep("scopes", scopes.join(errors, "scope_id"))
    last = Window.partitionBy("scope_id", "topic0").orderBy(F.desc("position"))
    ready = prepared.where("error IS NULL").select("scope_id", F.col("address").alias("contract"), "from_block", "to_block")
    compiled = (
        described.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank", "position")
        .join(ready, "scope_id")
        .withColumn("address", F.unhex(F.substring("contract", 3, 40)))
        .withColumn("address_digest", keccak_hex("address"))
        .withColumn("topic_digest", keccak_hex(F.unhex(F.substring("topic0", 3, 64))))
    )
    return run.keep("registry", matching.with_probes(compiled, "address_digest", "topic_digest")), prepared


def read_selected(files: DataFrame) -> DataFrame:
    """Decode the selected files, one task each."""
    count = max(files.count(), 1)
    slot = (F.row_number().over(Window.orderBy("path")) - 1).cast("int")
    return block_ops.read_blocks(files.withColumn("slot", slot).repartitionById(count, "slot"))


def audited(candidates: DataFrame, audit: Audit) -> DataFrame:
    """(path, block_number, root_ok) of the candidate blocks."""
    if callable(audit):
        return audit(candidates).select("path", "block_number", "root_ok")
    if audit == "none":
        return candidates.select("path", "block_number", F.lit(True).alias("root_ok"))
    if audit != "receipt_root":
        raise ValueError(f"unknown audit: {audit}")
    return block_ops.audit_receipts(candidates).select("path", "block_number", "root_ok")


def sync(
    spark: SparkSession,
    directory: str,
    scopes: DataFrame,
    store: Store,
    overrides: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    audit: Audit = "receipt_root",
    network: str | None = None,
    folder: str | None = None,
) -> SyncResult:
    """Index the events of every scope from the archive files of a directory.

    ``scopes`` needs a ``scope_id`` beside the scope fields. ``overrides`` holds
    (path, content) of local ABI files and ``snapshot`` (address, abi_json) of
    remotely published ones.
    """
    run = Work(spark, "sync", folder)
    overrides = spark.createDataFrame([], "path string, content string") if overrides is None else overrides
    snapshot = spark.createDataFrame([], "address string, abi_json string") if snapshot is None else snapshot
    known, prepared = _prepared(scopes, store, overrides, snapshot, run)
    ready, failed = prepared.where("error IS NULL"), prepared.where("error IS NOT NULL")

    files = run.keep("files", checksums.checked_manifest(spark, directory, ready, network))
    return run_blocks(run, read_selected(files), known, ready, failed, store, audit)


def _prepared(scopes, store, overrides, snapshot, run) -> tuple[DataFrame, DataFrame]:
    checked = run.keep("checked", checked_scopes(scopes))
    known, prepared = prepare(checked, store, overrides, snapshot, run)
    labels = prepared.select("address", "error").limit(2).collect()
    if len(labels) == 1 and labels[0].error:
        raise ValueError(f"{labels[0].error}: {labels[0].address}")
    return known, prepared


def run_blocks(
    run: Work, decoded: DataFrame, known: DataFrame, ready: DataFrame, failed: DataFrame, store: Store, audit: Audit
) -> SyncResult:
    written = run.keep("blocks", decoded)
    source_failed = not written.where("error IS NOT NULL").limit(1).isEmpty()
    good = written.where("error IS NULL").drop("error")
    span = good.select("block_number")
    ranges = ready.select("scope_id", "address", "from_block", "to_block")

    # Bloom first: only candidate blocks are audited and have their logs unpacked.
    candidates = matching.bloom_candidates(good.withColumn("bloom", hex_text("logs_bloom")), known, span)
    checks = run.keep("audit", audited(candidates.drop("bloom"), audit))
    events = run.keep("events", _events(candidates, checks, known))
    total, low, high = events.agg(F.count(F.lit(1)), F.min("block_number"), F.max("block_number")).first()
    store_failed, faults = False, []
    if total:
        try:
            store.append_events(events, low, high)
        except Exception as fault:  # any failed write withholds coverage; a rerun recovers
            _log.exception("events were not stored")
            faults.append(f"events were not stored: {fault}")
            store_failed = True

    verify = checks.where("NOT root_ok").select("block_number", F.lit("VerifyFailure").alias("reason"))
    broken = events.where("decode_failed").select("block_number", F.lit("DecodeFailure").alias("reason"))
    failures = verify.unionByName(broken).distinct()
    firsts = run.keep("first_failures", outcomes.first_failure(failures, ranges, span))
    islands = run.keep("islands", coverage.present_ranges(span, []))
    present = run.keep("present", coverage.clip_to_scopes(islands, ranges, _KEYS, span))
    gaps = run.keep("gaps", coverage.first_gap(coverage.missing_ranges(ranges, present, _KEYS), _KEYS))

    run_reason = F.lit("SourceFailure" if source_failed else "StoreFailure" if store_failed else None).cast("string")
    decided = outcomes.coverage_decision(ranges, firsts, gaps, run_reason, F.lit(False))
    recorded = present.join(decided.where("records").select("scope_id", "contract"), "scope_id")
    try:
        store.append_coverage(recorded.select("contract", "from_block", "to_block"))
    except Exception as fault:  # events are in place; without their coverage the ranges stay unanswered
        _log.exception("coverage was not recorded")
        faults.append(f"coverage was not recorded: {fault}")
        had_ranges = F.lit(True)
        failed_write = outcomes.coverage_decision(ranges, firsts, gaps, run_reason, had_ranges)
        touched = present.select("scope_id").distinct()
        decided = failed_write.join(touched, "scope_id", "left_semi").unionByName(decided.join(touched, "scope_id", "left_anti"))
    report = run.keep("report", outcomes.sync_report(decided, failed.select("scope_id", "name", "address")))
    run.drop_all_but("report")
    return SyncResult(0 if store_failed else total, report, tuple(faults))


def _events(candidates: DataFrame, checks: DataFrame, known: DataFrame) -> DataFrame:
    """Decoded events of verified candidate blocks, once per scope whose range and Bloom test hold."""
    logs = block_ops.explode_logs(candidates).withColumn("topic0", F.concat(F.lit("0x"), hex_text(F.get("topics", F.lit(0)))))
    ruled = known.select("scope_id", "contract", "event_name", "inputs", "compiled", "repeated", "address", "topic0", "from_block", "to_block")
    verified = checks.where("root_ok").select("path", "block_number")
    matched = (
        matching.match_logs(logs, ruled)
        .where(F.col("block_number").between(F.col("from_block"), F.col("to_block")))
        .join(verified, ["path", "block_number"], "left_semi")
    )
    # Only blocks with a matching log are tested against the scopes it matched.
    place = ["scope_id", "path", "block_number"]
    met = matched.select(*place).distinct().join(candidates.select("path", "block_number", "bloom"), ["path", "block_number"])
    hits = matching.bloom_prefilter(met, known).select(*place).distinct()
    decoded = decode.decode_logs(matched.join(hits, place, "left_semi"), decode.needs_arrow(known))
    return decode.stored_rows(decoded, extra=["scope_id", "path", "decode_failed"])
