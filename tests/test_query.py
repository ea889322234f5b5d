"""Request outcomes, pages, projections and registry rules on small tables."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainevents.functions.expressions import topics_array
from chainevents.operators import coverage, decode, projection, status
from chainevents.plans import query as Q
from chainevents.schemas import BUCKET, CONTRACTS, COVERED_RANGES, EVENTS
from chainevents.sources import registry, scopes
from chainevents.sources.store import Store

TOKEN = "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48"
TOPIC = "0x" + "ab" * 32


def event(block, log=0, **change):
    row = dict(
        contract=TOKEN, event_name="Transfer", topic0=TOPIC, block_number=block, block_hash="0x" + "11" * 32, tx_hash="0x" + "22" * 32,
        tx_index=0, log_index=log, raw_topics=json.dumps([TOPIC]), raw_data="00", decoded='{"value":"1"}', source="era1", timestamp=1,
    )
    return tuple({**row, **change}.values())


def events_of(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


@pytest.fixture(scope="module")
def tables(spark):
    many = spark.range(10_001).select(*[F.lit(v).alias(c) for c, v in zip([f.split()[0] for f in EVENTS.split(", ")], event(0))])
    many = many.withColumn("block_number", F.monotonically_increasing_id() % 1 + 50).withColumn("log_index", F.row_number().over(__import__("pyspark").sql.Window.orderBy(F.lit(1))).cast("bigint"))
    contracts = spark.createDataFrame([(TOKEN, "Token", "[]")], CONTRACTS)
    covered = spark.createDataFrame([(TOKEN, 0, 60, "era1", None), (TOKEN, 61, 100, "era1", None)], COVERED_RANGES)
    return many.cache(), contracts, covered


def test_cap_only_at_the_hard_limit(tables):
    events, contracts, covered = tables
    ask = lambda cap=10_000, **k: Q.query_events(events, contracts, covered, Q.EventQuery(**k), cap)
    outcome, rows = ask(limit=10_000)
    assert outcome == "Capped" and rows.count() == 10_000
    assert ask(limit=10_000, offset=1)[0] == "Results"
    assert ask(limit=9_999)[0] == "Results"
    outcome, rows = ask(limit=0)
    assert outcome == "Results" and rows.count() == 10_001
    assert ask(limit=100, offset=20_000)[0] == "Empty"
    # Without a cap nothing is cut and nothing is reported as cut.
    outcome, rows = ask(cap=None, limit=10_000)
    assert outcome == "Results" and rows.count() == 10_000


def test_stored_layout_is_pruned(spark, folder):
    from chainevents.sources.store import Store

    store = Store(spark, folder)
    store.append_events(events_of(spark, *[event(b * 9000, 0) for b in range(8)]), 0, 63_000)
    wanted = Q.EventQuery(contract=TOKEN, topic0="0xt", from_block=9000, to_block=20_000)
    plan = Q.filter_events(store.events, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(contract,0x" in pushed and "IsNotNull(topic0)" in pushed, pushed


def test_guards(tables):
    events, contracts, covered = tables
    ask = lambda cap=10_000, **k: Q.query_events(events, contracts, covered, Q.EventQuery(**k), cap)[0]
    assert ask(contract=TOKEN.lower()) == "NotIndexed"
    assert ask(contract=TOKEN, from_block=50, to_block=60) == "Results"
    # Two adjacent ranges do not add up, and the guard needs both bounds.
    assert ask(contract=TOKEN, from_block=50, to_block=70) == "MissingCoverage"
    assert ask(contract=TOKEN, from_block=50) == "Results"
    assert ask(contract=TOKEN, from_block=0, to_block=49) == "Empty"


@pytest.mark.parametrize("limit, offset", [(3, 0), (3, 4), (0, 5), (100, 2), (4, 50), (1, 6), (0, 0)])
def test_deep_page_equals_slice(spark, limit, offset):
    rows = [event(b * 3000, log) for b in range(6) for log in range(b % 3 + 1)]
    want = sorted((r[3], r[7]) for r in rows)[offset : offset + limit if limit else None]
    got = [(r.block_number, r.log_index) for r in Q.page(events_of(spark, *rows), limit, offset).collect()]
    assert got == want


def test_strict_and_flagged_reading(spark):
    rows = events_of(spark, event(1), event(2, raw_data="abc"), event(3, contract="bad", decoded="{"), event(4, decoded="null"), event(5, decoded="x"))
    flagged = {r.block_number: r.decode_quality and (r.decode_quality.quality, r.decode_quality.reason) for r in projection.read_flagged(rows).collect()}
    assert flagged == {
        1: None, 4: None,
        2: ("lossy", "raw_data hex decode failed"),
        3: ("invalid", "contract address parse failed"),
        5: ("lossy", "decoded JSON parse failed"),
    }
    with pytest.raises(projection.StoredRowError, match=r"block 2, log 0"):
        projection.read_strict(rows)
    assert projection.read_strict(rows.where("block_number IN (1, 4, 5)")).count() == 3


@pytest.mark.parametrize(
    "text, want",
    [('["a","b"]', ["a", "b"]), ("[]", []), ('[ "a" , "b" ]', ["a", "b"]), ("[1]", None), ('["a",null]', None), ("{}", None), ("x", None), ('["a",["b"]]', None), (r'["a\"b"]', ['a"b'])],
)
def test_topics(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(topics_array("t")).first()[0] == want


def test_empty_store_status(spark, folder):
    store = Store(spark, folder)
    top = status.latest_block(store.events).first()
    assert (top.latest_block, top.served_block, top.hex_block) == (None, 0, "0x0")
    assert status.indexed_range(store.events).first().min_block is None
    assert status.status_summary(store.events, store.contracts).count() == 0


def test_bounds(spark):
    texts = {"12376729": 12376729, "16M": 16_000_000, "16.5M": 16_500_000, "12.3K": 12_300, "16B": None, "-1M": None, "-3": None, "M": None, "": None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in frame.select("t", scopes.block_bound("t").alias("n")).collect()} == texts
    with pytest.raises(ValueError, match="unknown scope fields: oops"):
        scopes.validate_scopes(frame.withColumn("oops", F.lit(1)))


def test_signatures(spark):
    abi = (
        '[{"type":"event","name":"Transfer","inputs":[{"name":"f","type":"address","indexed":true},{"name":"t","type":"address","indexed":true},{"name":"v","type":"uint256","indexed":false}]},'
        '{"type":"event","name":"Deep","inputs":[{"name":"p","type":"tuple[2]","indexed":false,"components":[{"name":"a","type":"tuple","indexed":false,'
        '"components":[{"name":"y","type":"bool","indexed":false}]},{"name":"z","type":"address","indexed":false}]}]}]'
    )
    rows = registry.with_signatures(registry.abi_events(spark.createDataFrame([(abi,)], "abi_json string"))).collect()
    assert rows[0].signature == "Transfer(address,address,uint256)" and rows[0].layout_error is None
    assert rows[0].topic0 == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert rows[1].signature == "Deep(((bool),address)[2])" and rows[1].layout_error


def test_indexed_rules_and_repeated_names(spark):
    topic = "0x" + "00" * 30 + "0a0b"
    inputs = [("bytes4", "a"), ("bytesX", "b"), ("uint256[]", "a")]
    abi = json.dumps([{"type": "event", "name": "E", "inputs": [{"name": n, "type": t, "indexed": True} for t, n in inputs] + [{"name": "b", "type": "bool", "indexed": False}]}])
    known = registry.with_signatures(registry.abi_events(spark.createDataFrame([(abi,)], "abi_json string")))
    raw = bytes.fromhex(topic[2:])
    decoded = lambda data: json.loads(decode.decode_logs(known.withColumn("topics", F.array(*[F.lit(raw)] * 4)).withColumn("data", F.lit(data))).first().decoded)
    assert decoded(bytes(31) + b"\x01") == {"a": "0xa0b", "b": True}
    assert decoded(b"") == {"b": topic, "a": "0xa0b"}
    assert decoded(b"\x01")["b"] == topic


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(BUCKET - 4, BUCKET + 4) | st.integers(2 * BUCKET - 3, 2 * BUCKET + 3) | st.integers(3 * BUCKET - 2, 3 * BUCKET), max_size=25))
def test_present_and_missing_partition_the_scope(spark, blocks):
    low, high = BUCKET - 5, 3 * BUCKET + 1
    pairs = spark.createDataFrame([(1, b) for b in blocks], "scope_id bigint, block_number bigint")
    wanted = spark.createDataFrame([(1, low, high)], "scope_id bigint, from_block bigint, to_block bigint")
    present = coverage.present_ranges(pairs, ["scope_id"])
    got = sorted((r.from_block, r.to_block) for r in present.collect())
    gaps = sorted((r.gap_from, r.gap_to) for r in coverage.missing_ranges(wanted, present, ["scope_id"]).collect())
    covered = [b for a, z in got for b in range(a, z + 1)]
    assert covered == sorted(set(blocks))
    assert sorted(covered + [b for a, z in gaps for b in range(a, z + 1)]) == list(range(low, high + 1))
    assert all(z + 1 < a for (_, z), (a, _) in zip(got, got[1:]))  # ranges are maximal
