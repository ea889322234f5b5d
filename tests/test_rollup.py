"""The store's roll-up follows its events through appends, reruns and broken runs."""

import re
from collections import Counter

from test_query import TOKEN, TOPIC, event, events_of

from chainevents.operators import ranks, status
from chainevents.plans import query as Q
from chainevents.schemas import BUCKET, COVERED_RANGES
from chainevents.sources.store import Store

OTHER = "0x" + "cd" * 20


def counted(store):
    return sorted(((r.contract, r.event_name, r.topic0, r.block_bucket, r.n, r.min_block, r.max_block) for r in store.rollup.collect()), key=repr)


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1], r[2], r[3] // BUCKET), []).append(r[3])
    return sorted(((*k, len(v), min(v), max(v)) for k, v in groups.items()), key=repr)


def test_rollup_follows_the_events(spark, folder):
    store = Store(spark, folder)
    assert counted(store) == [] and status.rolled_totals(store.rollup, store.contracts).first().event_count == 0
    first = [event(b, log, contract=c, topic0=t) for b in (1, 5, BUCKET, 4 * BUCKET) for log, (c, t) in enumerate([(TOKEN, TOPIC), (OTHER, TOPIC), (TOKEN, None)])]
    store.append_events(events_of(spark, *first), 1, 4 * BUCKET)
    assert counted(store) == plain(first)
    store.append_events(events_of(spark, *first), 1, 4 * BUCKET)
    assert counted(store) == plain(first)
    more = [event(6, 0, event_name="Approval"), event(BUCKET + 7, 0, contract=OTHER), first[0]]
    store.append_events(events_of(spark, *more), 1, BUCKET + 7)
    assert counted(store) == plain(first + more[:2])
    # A run that broke off behind its events is mended by the next one over the same blocks.
    broken = events_of(spark, event(9, 0)).withColumn("block_bucket", __import__("pyspark").sql.functions.lit(0).cast("bigint"))
    broken.write.mode("append").partitionBy("block_bucket").parquet(f"{folder}/events")
    store.append_events(events_of(spark, event(9, 0)), 9, 9)
    assert counted(store) == plain(first + more[:2] + [event(9, 0)])


def test_status_reads_no_event_file(spark, folder):
    store = Store(spark, folder)
    rows = [event(b, 0, contract=c) for b, c in ((1, TOKEN), (2, TOKEN), (9000, OTHER))]
    store.append_events(events_of(spark, *rows), 1, 9000)
    store.upsert_contracts(spark.createDataFrame([(TOKEN, "a", "[]"), (OTHER, None, None), ("0x" + "11" * 20, None, None)], "address string, name string, abi_json string"))
    summary = status.summary_of(status.rolled_counts(store.rollup), store.contracts)
    assert "/events" not in summary._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in summary.collect()] == [tuple(r) for r in status.status_summary(store.events, store.contracts).collect()]
    assert Counter({r.address: r.total_events for r in summary.collect()}) == Counter({TOKEN: 2, OTHER: 1, "0x" + "11" * 20: 0})


def test_requests_count_by_the_rollup(spark, folder):
    store = Store(spark, folder)
    rows = [event(b * 700, 0, contract=TOKEN if b % 3 else OTHER) for b in range(60)]
    store.append_events(events_of(spark, *rows), 0, 60 * 700)
    kept = sorted((r.contract, r.event_name, r.topic0, r.bucket, r.n) for r in store.bucket_counts.collect())
    assert kept == sorted((r.contract, r.event_name, r.topic0, r.bucket, r.n) for r in ranks.bucket_counts(store.events).collect())
    asked = spark.createDataFrame([(1, TOKEN, None, None, 700, 30_000, 0, 0), (2, None, None, None, None, None, 5, 50)], "request_id bigint, contract string, event_name string, topic0 string, from_block bigint, to_block bigint, page_limit bigint, page_offset bigint")
    got = {r.request_id: r.matches for r in Q.count_matches(asked, store.events, store.bucket_counts).collect()}
    assert got == {1: sum(1 for r in rows if r[0] == TOKEN and 700 <= r[3] <= 30_000), 2: 60}
    contracts, covered = spark.createDataFrame([(TOKEN, None, None)], "address string, name string, abi_json string"), spark.createDataFrame([(TOKEN, 0, 99_999, "era1", None)], COVERED_RANGES)
    page = Q.query_rows(asked, store.events, contracts, covered, store.bucket_counts).where("request_id = 2").orderBy("position").collect()
    assert [(r.position, r.block_number) for r in page] == [(50 + k, (50 + k) * 700) for k in range(5)]


def test_status_moves_counts_by_name_once(spark, folder):
    """The dataset-wide facts come from the roll-up itself, not from a second set of counts by name."""
    store = Store(spark, folder)
    rows = [event(b, 0, contract=c) for b, c in ((1, TOKEN), (2, TOKEN), (9000, OTHER))]
    store.append_events(events_of(spark, *rows), 1, 9000)
    store.upsert_contracts(spark.createDataFrame([(TOKEN, "a", "[]"), ("0x" + "11" * 20, None, None)], "address string, name string, abi_json string"))
    summary = status.rolled_summary(store.rollup, store.contracts)
    dealt = lambda table: len(re.findall(r"Exchange hashpartitioning\(contract#\d+, event_name#\d+", table._jdf.queryExecution().executedPlan().toString()))
    assert dealt(status.summary_of(status.rolled_counts(store.rollup), store.contracts)) > 1 and dealt(summary) == 1
    assert [tuple(r) for r in summary.collect()] == [tuple(r) for r in status.status_summary(store.events, store.contracts).collect()]
    nothing = status.rolled_summary(Store(spark, f"{folder}/none").rollup, store.contracts).collect()
    assert [(r.event_count, r.min_block, r.latest_block, r.contract_count) for r in nothing] == [(0, None, None, 2)] * 2
