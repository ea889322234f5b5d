"""What the sinks move: rows as they come in, not the columns that are derived from them."""

from pyspark.sql import functions as F
from test_query import event, events_of

from chainevents.schemas import EVENT_COLUMNS, EVENT_KEY
from chainevents.sources.store import Store, first_per_key, in_buckets

_ROWS = [(1, 0, 0, "b"), (1, 0, 0, "a"), (1, 0, 1, "c"), (2, 0, 0, None), (2, 0, 0, "z")]


def exchanged(table):
    """Plan texts from each exchange on."""
    return table._jdf.queryExecution().executedPlan().toString().split("Exchange")[1:]


def test_arrival_is_derived_behind_the_exchange(spark):
    rows = spark.createDataFrame(_ROWS, "block_number bigint, tx_index bigint, log_index bigint, seed string")
    wide = F.sha2("seed", 256)
    kept = first_per_key(rows, [wide])
    assert len(exchanged(kept)) == 1 and "sha2" not in exchanged(kept)[0]
    first = {}
    for row in rows.withColumn("wide", wide).collect():
        first.setdefault(tuple(row[k] for k in EVENT_KEY), []).append((row.wide is not None, row.wide or "", row.seed))
    assert {tuple(r[k] for k in EVENT_KEY): r.seed for r in kept.collect()} == {k: min(v)[2] for k, v in first.items()}


def test_append_takes_shape_where_it_is_written(spark, folder):
    store = Store(spark, folder)
    rows = [event(b, log) for b in (3, 9000) for log in range(3)]
    narrow = events_of(spark, *rows).select(*EVENT_KEY, F.col("contract").alias("of"), *[c for c in EVENT_COLUMNS if c not in (*EVENT_KEY, "contract")])
    shape = {c: F.upper("of") if c == "contract" else F.col(c) for c in EVENT_COLUMNS}
    for _ in range(2):
        store.append_events(narrow, 3, 9000, shape)
        stored = store.events.collect()
        assert len(stored) == 6 and {r.contract for r in stored} == {rows[0][0].upper()}
    assert {r.block_bucket for r in store.events.collect()} == {0, 1}


def test_first_per_key_sorts_once(spark):
    """One sort by key, whatever the order of arrival; rows that are dealt by bucket are not moved again."""
    rows = spark.createDataFrame(_ROWS, "block_number bigint, tx_index bigint, log_index bigint, seed string")
    plain = lambda table: table._jdf.queryExecution().executedPlan().toString()
    moved, dealt = first_per_key(rows, ["seed"]), first_per_key(in_buckets(rows), ["seed"], ("block_bucket",))
    for kept in (moved, dealt):
        assert plain(kept).count("Sort [") == 1 and plain(kept).count("Exchange ") == 1
        assert sorted((r.block_number, r.log_index, r.seed or "") for r in kept.collect()) == [(1, 0, "a"), (1, 1, "c"), (2, 0, "")]
    again = spark.createDataFrame(_ROWS[:1] * 3, rows.schema)
    assert first_per_key(again, ["seed"]).count() == 1


def test_append_moves_rows_once(spark, folder):
    """The first append deals rows by bucket alone, and so does the roll-up; a bucket has one file of each."""
    store = Store(spark, folder)
    rows = [event(b * 100, log) for b in range(300) for log in range(2)] * 2
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    store.append_events(events_of(spark, *rows), 0, 30_000)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in set(tracker.getJobIdsForGroup(None)) - before for s in tracker.getJobInfo(j).stageIds}
    moved = [s for s in (spark._jsc.sc().statusStore().lastStageAttempt(s) for s in stages) if s.shuffleWriteRecords() > 0]
    assert sorted(s.shuffleWriteRecords() for s in moved) == [600, 1200]
    assert store.events.count() == 600 and store.events.select("block_bucket", F.input_file_name()).distinct().count() == 4
    assert store.rollup.agg(F.sum("n")).first()[0] == 600
