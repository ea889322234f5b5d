"""Requests by rank and select, against plain filtering and slicing."""

import random
import re

import pytest
from test_query import TOKEN, TOPIC, event, events_of

from chainevents.operators import ranks
from chainevents.plans import query as Q
from chainevents.schemas import BUCKET, CONTRACTS, COVERED_RANGES
from chainevents.sources.store import first_per_key, in_buckets
from chainevents.sources.work import Work

OTHER, UNKNOWN = "0x" + "cd" * 20, "0x" + "ee" * 20
REQUEST = "request_id bigint, contract string, event_name string, topic0 string, from_block bigint, to_block bigint, page_limit bigint, page_offset bigint"


def sample_events(seed=1):
    chance = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < 300:
        block, log = chance.choice([chance.randrange(60), BUCKET - 1, BUCKET, 3 * BUCKET + chance.randrange(40), 9 * BUCKET]), chance.randrange(9)
        if (block, log) in seen:
            continue
        seen.add((block, log))
        rows.append(event(block, log, contract=chance.choice([TOKEN, TOKEN, OTHER, None]), event_name=chance.choice(["Transfer", "Approval"]), topic0=chance.choice([TOPIC, "0xt", None])))
    return rows


def sample_requests(seed=2, n=80):
    chance = random.Random(seed)
    rows = []
    for k in range(n):
        low, high = chance.choice([None, 0, 30, BUCKET, 4 * BUCKET, 1 << 62]), chance.choice([None, 20, BUCKET, 3 * BUCKET + 10, (1 << 63) - 1])
        rows.append((k, chance.choice([None, TOKEN, OTHER, UNKNOWN]), chance.choice([None, "Transfer", "Nothing"]), chance.choice([None, TOPIC]), low, high, chance.choice([0, 1, 7, 500]), chance.choice([0, 0, 3, 290, 10_000])))
    return rows


def plain(rows, requests, indexed, covered):
    out = []
    for i, contract, name, topic, low, high, limit, offset in requests:
        if contract is not None and contract not in indexed:
            continue
        if None not in (contract, low, high) and not any(c == contract and a <= low and b >= high for c, a, b in covered):
            continue
        held = [r for r in rows if contract in (None, r[0]) and name in (None, r[1]) and topic in (None, r[2]) and r[3] >= (low or 0) and r[3] <= ((1 << 63) - 1 if high is None else high)]
        held.sort(key=lambda r: (r[3], r[7], r[6]))
        out += [(i, k, r[3], r[7], r[0]) for k, r in enumerate(held) if k >= offset and (limit == 0 or k < offset + limit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_query_rows(spark, stored, folder):
    rows, requests = sample_events(), sample_requests()
    events = events_of(spark, *rows)
    if stored:
        from chainevents.operators.ranges import bucket_of

        events.withColumn("block_bucket", bucket_of("block_number")).write.partitionBy("block_bucket").parquet(f"{folder}/events")
        events = spark.read.parquet(f"{folder}/events")
    contracts = spark.createDataFrame([(TOKEN, "a", "[]"), (OTHER, None, "[]")], CONTRACTS)
    held = [(TOKEN, 0, 5 * BUCKET), (OTHER, 30, BUCKET), (TOKEN, 6 * BUCKET, (1 << 63) - 1)]
    covered = spark.createDataFrame([(c, a, b, "era1", None) for c, a, b in held], COVERED_RANGES)
    asked = spark.createDataFrame(requests, REQUEST)
    got = Q.query_rows(asked, events, contracts, covered)
    assert got.columns[:2] == ["request_id", "position"] and "block_bucket" not in got.columns
    found = sorted(((r.request_id, r.position, r.block_number, r.log_index, r.contract) for r in got.collect()), key=repr)
    want = plain(rows, requests, {TOKEN, OTHER}, held)
    assert found == want and len({r[0] for r in want}) > 12
    outcomes = {r.request_id: r.rows_returned for r in Q.query_outcome(asked, events, contracts, covered).collect()}
    assert outcomes == {i: sum(r[0] == i for r in want) for i, *_ in requests}


def test_query_rows_of_nothing(spark):
    contracts, covered = spark.createDataFrame([], CONTRACTS), spark.createDataFrame([], COVERED_RANGES)
    one = spark.createDataFrame([(1, None, None, None, None, None, 0, 0)], REQUEST)
    assert Q.query_rows(one, events_of(spark), contracts, covered).collect() == []
    assert Q.query_rows(one.limit(0), events_of(spark, event(1)), contracts, covered).collect() == []


def test_only_touched_buckets_are_sorted(spark):
    """A page in one bucket meets that bucket's events alone, however many buckets its request spans."""
    rows = [event(b * BUCKET + k, 0) for b in range(12) for k in range(5)]
    asked = spark.createDataFrame([(1, TOKEN, None, None, 0, 12 * BUCKET, 3, 31)], REQUEST)
    events = events_of(spark, *rows)
    wanted = ranks.with_kinds(asked)
    found = ranks.Ranks(wanted, events, ranks.bucket_counts(events), Work(spark, "test"))
    picked = found.select(wanted.selectExpr("request_id", "kind", "CAST(31 AS BIGINT) AS first", "CAST(34 AS BIGINT) AS last"))
    assert sorted(r.block_number for r in picked.collect()) == [6 * BUCKET + k for k in (1, 2, 3)]
    touched = spark.read.parquet(f"{found.work.folder}/touched")
    assert [r.bucket for r in touched.collect()] == [6]


def test_requests_at_one_block_are_looked_up_once(spark):
    rows = [event(k, 0) for k in range(50)]
    asked = spark.createDataFrame([(k, TOKEN if k % 2 else None, None, None, 10, 39, 0, 0) for k in range(400)], REQUEST)
    counts = Q.count_matches(asked, events_of(spark, *rows)).collect()
    assert len(counts) == 400 and {r.matches for r in counts} == {30}


def test_exploded_pages_do_not_pass_the_driver(spark):
    """A page's rows are met by runs of ranks, dealt on both sides: their table looks small by its file and is not."""
    rows = [event(k, 0) for k in range(3 * ranks.RUN)]
    events, asked = events_of(spark, *rows), spark.createDataFrame([(k, TOKEN, None, None, 0, 10**6, 0, 0) for k in range(50)], REQUEST)
    wanted = ranks.with_kinds(asked)
    found = ranks.Ranks(wanted, events, ranks.bucket_counts(events), Work(spark, "test"))
    picked = found.select(wanted.selectExpr("request_id", "kind", "CAST(60 AS BIGINT) AS first", "CAST(130 AS BIGINT) AS last"))
    joins = re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", picked._jdf.queryExecution().executedPlan().toString())
    assert joins[0] == "SortMergeJoin"
    assert sorted((r.request_id, r["rank"], r.block_number) for r in picked.collect()) == [(k, n, n) for k in range(50) for n in range(60, 130)]


def test_dealt_events_are_moved_by_touched_bucket(spark):
    """Events dealt by bucket are counted where they are, and a look-up moves the buckets of its bounds alone."""
    rows = [event(b * BUCKET + k, 0) for b in range(12) for k in range(5)]
    events = events_of(spark, *rows)
    dealt = first_per_key(in_buckets(events), ["contract"], ("block_bucket",))
    plan = lambda table: table._jdf.queryExecution().executedPlan().toString()
    assert plan(ranks.bucket_counts(dealt)).count("Exchange ") == 1
    asked = spark.createDataFrame([(1, TOKEN, None, None, 2 * BUCKET + 1, 2 * BUCKET + 3, 0, 0), (2, None, None, None, None, 5 * BUCKET, 0, 0)], REQUEST)
    assert {(r.request_id, r.matches) for r in Q.count_matches(asked, dealt).collect()} == {(1, 3), (2, 26)}
    found = ranks.Ranks(ranks.with_kinds(asked), dealt, ranks.bucket_counts(dealt), Work(spark, "test"))
    near = found._in_buckets(spark.createDataFrame([(1, 2), (1, 1 << 49)], "kind bigint, bucket bigint"))
    assert str(3 * BUCKET - 1) in plan(near)[plan(near).index("REPARTITION_BY_COL") :]
    assert sorted(r.block_number for r in near.collect()) == [2 * BUCKET + k for k in range(5)]
    assert found._in_buckets(spark.createDataFrame([(1, 1 << 49)], "kind bigint, bucket bigint")).count() == 0


def test_wide_requests_meet_events_by_whole_chunks(spark, monkeypatch):
    """What is dealt for a request grows with its chunks, not with its runs; its rows are the same."""
    monkeypatch.setattr(ranks, "RUN", 4)
    monkeypatch.setattr(ranks, "WIDE", 32)
    rows = [event(3 * k, k % 3, contract=TOKEN if k % 5 else OTHER) for k in range(700)]
    spans = [(0, 700), (5, 690), (32, 64), (31, 65), (33, 63), (600, 601), (64, 700), (700, 800)]
    asked = spark.createDataFrame([(i, None if i % 2 == 0 else TOKEN, None, None, None, None, b - a, a) for i, (a, b) in enumerate(spans)], REQUEST)
    events, contracts = events_of(spark, *rows), spark.createDataFrame([(TOKEN, "a", "[]")], CONTRACTS)
    got = Q.query_rows(asked, events, contracts, spark.createDataFrame([], COVERED_RANGES))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence(") == 2
    requests = [tuple(r) for r in asked.collect()]
    found = sorted(((r.request_id, r.position, r.block_number, r.log_index, r.contract) for r in got.collect()), key=repr)
    assert found == plain(rows, requests, {TOKEN}, [])
    bounds = spark.createDataFrame([(i, 0, 5, 695) for i in range(20)], "request_id long, kind long, first long, last long")
    wanted = ranks.with_kinds(asked.where("request_id = 0"))
    found = ranks.Ranks(wanted, events, ranks.bucket_counts(events), Work(spark, "test"))
    assert found.select(bounds).groupBy("request_id").count().where("count = 690").count() == 20
    assert [spark.read.parquet(f"{found.work.folder}/{name}").count() for name in ("touched", "touched_whole")] == [1, 1]  # one bucket, once for all requests
