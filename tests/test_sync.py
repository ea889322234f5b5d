"""Whole runs over synthetic archives."""

import json

from pathlib import Path

import pytest
from archives import OTHER, OTHER_TEXT, TOKEN, TOKEN_TEXT, TRANSFER_ABI, archive, block, transfer, word, write
from pyspark.sql import functions as F

from chainevents.plans.query import EventQuery, query_events
from chainevents.plans.sync import sync
from chainevents.sources.store import Store

FIRST, SECOND = "mainnet-00000-5ec1ffb8.era1", "mainnet-00001-5ec1ffb8.ere"
FIELDS = "scope_id bigint, name string, address string, events array<string>, from_block bigint, to_block bigint, abi_override string, impl_address string"


def scope(scope_id, low, high, address=TOKEN, events=("Transfer",), name="Token", override="abi.json"):
    return (scope_id, name, "0x" + address.hex(), list(events), low, high, override, None)


class World:
    def __init__(self, spark, folder):
        import os

        self.spark, self.folder = spark, folder
        for sub in ("archive", "store", "work"):
            os.mkdir(f"{folder}/{sub}")
        self.store = Store(spark, f"{folder}/store")

    def put(self, name, content):
        write(f"{self.folder}/archive", name, content)

    def run(self, *scopes, overrides=(("abi.json", TRANSFER_ABI),), store=None, **options):
        frame = self.spark.createDataFrame(list(scopes), FIELDS)
        files = self.spark.createDataFrame(list(overrides), "path string, content string")
        result = sync(self.spark, f"{self.folder}/archive", frame, store or self.store, files, folder=f"{self.folder}/work", **options)
        self.report = {r.scope_id: r for r in result.report.collect()}
        return result

    def covered(self):
        return sorted((r.contract, r.from_block, r.to_block) for r in self.store.covered_ranges.collect())

    def blocks(self):
        return sorted(r.block_number for r in self.store.events.collect())


@pytest.fixture
def world(spark, folder):
    return World(spark, folder)


def test_events_are_indexed_and_covered(world):
    world.put(FIRST, archive([block(n, [[transfer(n, OTHER)], [transfer(n), transfer(n + 1)]] if n % 2 else []) for n in range(100, 106)]))
    result = world.run(scope(1, 100, 105))
    assert result.is_complete and result.total_events == 6
    assert world.covered() == [(TOKEN_TEXT, 100, 105)]
    row = world.store.events.orderBy("block_number", "log_index").first()
    assert (row.contract, row.event_name, row.block_number, row.tx_index, row.log_index) == (TOKEN_TEXT, "Transfer", 101, 1, 1)
    assert json.loads(row.decoded) == {"from": "0x" + "00" * 19 + "01", "to": "0x" + "00" * 19 + "02", "value": "101"}
    assert row.raw_data == word(101).hex() and json.loads(row.raw_topics)[2] == "0x" + word(2).hex()
    # An eventless covered range is Empty, an uncovered one is not.
    events, contracts, covered = world.store.events, world.store.contracts, world.store.covered_ranges
    ask = lambda **k: query_events(events, contracts, covered, EventQuery(contract=k.pop("contract", TOKEN_TEXT), **k))[0]
    assert ask(from_block=100, to_block=100) == "Empty"
    assert ask(from_block=100, to_block=105) == "Results"
    assert ask(from_block=100, to_block=106) == "MissingCoverage"
    assert ask(contract=OTHER_TEXT) == "NotIndexed"
    assert ask(from_block=100, to_block=105, event_name="Approval") == "Empty"
    # A rerun finds the ABI in the cache, hands everything over again and changes nothing.
    again = world.run(scope(1, 100, 105), overrides=())
    assert again.is_complete and again.total_events == 6 and world.store.events.count() == 6 and len(world.covered()) == 1


def test_gap_is_reported_and_later_filled(world):
    world.put(FIRST, archive([block(n, [[transfer()]]) for n in range(100, 106)]))
    world.run(scope(1, 100, 110))
    r = world.report[1]
    assert (r.reason, r.gap_from, r.gap_to, r.covered) == ("NoSourceData", 106, 110, False)
    assert r.reason_text == "no backing source data for blocks 106-110"
    assert world.covered() == [(TOKEN_TEXT, 100, 105)] and world.blocks() == list(range(100, 106))
    world.put("mainnet-00000-5ec1ffb9.era1", archive([block(n, [[transfer()]]) for n in range(106, 111)]))
    assert world.run(scope(1, 100, 110)).is_complete
    assert world.covered() == [(TOKEN_TEXT, 100, 105), (TOKEN_TEXT, 100, 110)]
    assert world.blocks() == list(range(100, 111))


def test_no_files_at_all(world):
    world.run(scope(1, 5, 9))
    assert (world.report[1].gap_from, world.report[1].gap_to) == (5, 9) and world.covered() == []


def test_wrong_root_withholds_coverage_of_every_scope_that_holds_the_block(world):
    good = [block(n, [[transfer()]]) for n in (10, 11)]
    world.put(FIRST, archive([*good, block(12, [[transfer()]], root=bytes(32)), block(13, [[transfer(1, OTHER)]])]))
    world.run(scope(1, 10, 13), scope(2, 10, 11), scope(3, 12, 13, OTHER))
    assert {k: r.reason for k, r in world.report.items()} == {1: "VerifyFailure", 2: None, 3: "VerifyFailure"}
    assert world.covered() == [(TOKEN_TEXT, 10, 11)] and world.blocks() == [10, 11, 13]


def test_wrong_root_without_bloom_hit_goes_unverified(world):
    world.put(FIRST, archive([block(10, [[transfer(1, OTHER)]], root=bytes(32)), block(11, [[transfer()]])]))
    assert world.run(scope(1, 10, 11)).is_complete and world.blocks() == [11]


def test_empty_bloom_hides_logs(world):
    world.put(FIRST, archive([block(10, [[transfer()]], bloom=bytes(256))]))
    assert world.run(scope(1, 10, 10)).is_complete and world.blocks() == []


def test_decode_failure_keeps_the_event_but_not_the_coverage(world):
    world.put(FIRST, archive([block(10, [[transfer()]]), block(11, [[transfer(data=b"\x01\x02\x03")]])]))
    result = world.run(scope(1, 10, 11), scope(2, 10, 10))
    assert result.total_events == 3 and world.store.events.count() == 2
    assert {k: r.reason for k, r in world.report.items()} == {1: "DecodeFailure", 2: None}
    decoded = json.loads(world.store.events.where("block_number = 11").first().decoded)
    assert decoded["_raw_data"] == "010203" and decoded["_decode_error"] and "value" not in decoded


def test_empty_data_and_missing_topics_are_no_error(world):
    bare = transfer(data=b"")
    bare["topics"] = bare["topics"][:2]
    world.put(FIRST, archive([block(10, [[bare]])]))
    assert world.run(scope(1, 10, 10)).is_complete
    assert json.loads(world.store.events.first().decoded) == {"from": "0x" + "00" * 19 + "01"}


def test_source_failure_withholds_all_coverage(world):
    world.put(FIRST, archive([block(10, [[transfer()]]), block(11, [[transfer()]])], lose_last=True))
    world.put(SECOND, archive([block(8192, [[transfer(1, OTHER)]], slim=True)], slim=True))
    world.run(scope(1, 10, 10), scope(2, 8192, 8192, OTHER))
    assert {r.reason for r in world.report.values()} == {"SourceFailure"} and world.covered() == []
    assert world.blocks() == [10, 8192]


def test_block_failure_outranks_source_failure(world):
    world.put(FIRST, archive([block(10, [[transfer()]], root=bytes(32)), block(11, header=b"junk"), block(12)]))
    world.run(scope(1, 10, 10), scope(2, 12, 12))
    assert {k: r.reason for k, r in world.report.items()} == {1: "VerifyFailure", 2: "SourceFailure"}


def test_unreadable_body_is_no_failure(world):
    world.put(FIRST, archive([block(10, [[transfer()]], body=b"junk")]))
    assert world.run(scope(1, 10, 10)).is_complete
    assert world.store.events.first().tx_hash == "0x" + "00" * 32


def test_two_scopes_on_one_contract_store_one_row(world):
    world.put(FIRST, archive([block(10, [[transfer()]])]))
    result = world.run(scope(1, 10, 10), scope(2, 10, 10, override=None))
    assert result.total_events == 2 and world.store.events.count() == 1 and result.is_complete


def test_preparation_failure_is_isolated_unless_alone(world):
    world.put(FIRST, archive([block(10, [[transfer()]])]))
    world.run(scope(1, 10, 10), scope(2, 10, 10, OTHER, events=("Nope",), name="Other"), scope(3, 10, 10, b"\x01" * 20, override=None, name=None))
    assert {k: r.reason for k, r in world.report.items()} == {1: None, 2: "PreparationFailed", 3: "PreparationFailed"}
    assert world.report[2].label == "Other" and world.report[1].label == TOKEN_TEXT
    with pytest.raises(ValueError, match="EventNotFound"):
        world.run(scope(1, 10, 10, events=("Nope",)))


def test_event_with_plain_tuple_input_fails_preparation(world):
    abi = '[{"type":"event","name":"T","inputs":[{"name":"p","type":"tuple","indexed":false,"components":[{"name":"a","type":"bool","indexed":false}]}]}]'
    with pytest.raises(ValueError, match="BadEventType"):
        world.run(scope(1, 10, 10, events=("*",)), overrides=(("abi.json", abi),))


def test_wildcard_without_events_matches_nothing(world):
    world.put(FIRST, archive([block(10, [[transfer()]])]))
    assert world.run(scope(1, 10, 10, events=("*",)), overrides=(("abi.json", "[]"),)).is_complete
    assert world.blocks() == [] and world.covered() == [(TOKEN_TEXT, 10, 10)]


def test_bad_scope_row_stops_the_run(world):
    with pytest.raises(ValueError, match="InvalidRange"):
        world.run(scope(1, 10, 9))
    with pytest.raises(ValueError, match="InvalidAddress"):
        world.run((1, "x", "0x12", ["*"], 1, 2, None, None))


class FailingStore(Store):
    broken = ()

    def append_events(self, *args):
        if "events" in self.broken:
            raise OSError("disk full")
        super().append_events(*args)

    def append_coverage(self, *args):
        if "coverage" in self.broken:
            raise OSError("disk full")
        super().append_coverage(*args)


@pytest.mark.parametrize("part, reason", [("events", "StoreFailure"), ("coverage", "CoverageWriteFailed")])
def test_failed_writes(world, part, reason):
    world.put(FIRST, archive([block(10, [[transfer()]])]))
    store = FailingStore(world.spark, f"{world.folder}/store")
    store.broken = (part,)
    result = world.run(scope(1, 10, 10), scope(2, 50, 60), store=store)
    assert world.report[1].reason == reason and world.covered() == []
    # A scope without any present range has no coverage to write.
    assert world.report[2].reason == ("StoreFailure" if part == "events" else "NoSourceData")
    # Events that were not stored do not count.
    assert result.total_events == (0 if part == "events" else 1)
    assert len(result.faults) == 1 and "disk full" in result.faults[0]
    # Of the run's written tables only the report, which the result reads, stays.
    left = [p.name for run in Path(world.folder).rglob("sync-*") for p in run.iterdir()]
    assert left == ["report"]


def test_contracts_versions(world):
    rows = lambda name: world.spark.createDataFrame([("0xa", name, "[]")], "address string, name string, abi_json string")
    for name in ("one", "two", "three"):
        world.store.upsert_contracts(rows(name))
        assert [r.name for r in world.store.contracts.collect()] == [name]
    # A version that was begun and never completed is not read.
    Path(f"{world.folder}/store/contracts/v4").mkdir()
    assert [r.name for r in world.store.contracts.collect()] == ["three"]
    world.store.upsert_contracts(rows("four"))
    assert [r.name for r in world.store.contracts.collect()] == ["four"]


def test_audit_choices(world):
    world.put(FIRST, archive([block(10, [[transfer()]], root=bytes(32))]))
    fails = lambda c: c.select("path", "block_number", F.lit(False).alias("root_ok"))
    world.run(scope(1, 10, 10), audit=fails)
    assert world.report[1].reason == "VerifyFailure"
    assert world.run(scope(1, 10, 10), audit="none").is_complete and world.blocks() == [10]


def test_snapshot_by_implementation_address(world):
    world.put(FIRST, archive([block(10, [[transfer()]])]))
    remote = world.spark.createDataFrame([(OTHER_TEXT, TRANSFER_ABI)], "address string, abi_json string")
    proxied = (1, None, "0x" + TOKEN.hex(), ["Transfer"], 10, 10, None, "0x" + OTHER.hex())
    assert world.run(proxied, overrides=(), snapshot=remote).is_complete
    assert world.store.contracts.first().address == TOKEN_TEXT
