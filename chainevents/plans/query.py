"""Event queries: filter, order, pages, a cap where one is asked for, and explicit outcomes.

No function cuts a result by itself. ``cap`` is an argument of those that can report *Capped*; left out, there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainevents.operators.coverage import range_covered
from chainevents.operators.ranges import blocks_of, bucket_of
from chainevents.operators.ranks import DIMENSIONS, Ranks, bucket_counts, with_kinds
from chainevents.schemas import BUCKET
from chainevents.sources.work import Work

ORDER = ["block_number", "log_index", "tx_index"]
_LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class EventQuery:
    """One request. ``limit`` 0 means no cap."""

    contract: str | None = None
    event_name: str | None = None
    topic0: str | None = None
    from_block: int | None = None
    to_block: int | None = None
    limit: int = 0
    offset: int = 0


def filter_events(events: DataFrame, query: EventQuery) -> DataFrame:
    """Rows that match every given dimension; plain text equality, inclusive bounds.

    The block bounds are repeated on the bucket column where the table has one, so
    that whole partitions are skipped.
    """
    rows = events
    for column, value in (("contract", query.contract), ("event_name", query.event_name), ("topic0", query.topic0)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    low, high = query.from_block or 0, _LARGEST if query.to_block is None else query.to_block
    rows = rows.where(F.col("block_number").between(low, high))
    if "block_bucket" in events.columns:
        rows = rows.where(F.col("block_bucket").between(low // BUCKET, high // BUCKET)).drop("block_bucket")
    return rows


def event_query(events: DataFrame, query: EventQuery) -> DataFrame:
    """Matching rows in result order, paged."""
    return page(filter_events(events, query), query.limit, query.offset)


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of the result order; a limit of 0 means all that follow.

    A first job counts rows per bucket of blocks, and hands back in which buckets the page lies: three numbers. Rows are
    then read again in that range of blocks alone, where sources and keys allow it, and are numbered bucket by bucket. The
    one window without a partition runs over one row per bucket.
    """
    if offset == 0 and limit == 0:
        return rows.orderBy(*ORDER)
    last = F.lit(offset + limit if limit else _LARGEST)
    touched = _bucket_starts(rows).where((F.col("start") < last) & (F.col("start") + F.col("n") > offset))
    found = touched.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.min("start").alias("start")).first()
    if found.low is None:
        return rows.limit(0)
    near = rows.where(F.col("block_number").between(*blocks_of(found.low, found.high)))
    inside = Window.partitionBy("bucket").orderBy(*ORDER)
    numbered = near.withColumn("bucket", bucket_of("block_number"))
    if found.low == found.high:
        numbered = numbered.withColumn("start", F.lit(0))
    else:
        numbered = numbered.join(F.broadcast(_bucket_starts(near).drop("n")), "bucket")  # one row per bucket
    place = F.col("start") + F.row_number().over(inside) - 1 + found.start
    kept = numbered.withColumn("place", place).where((F.col("place") >= offset) & (F.col("place") < last))
    return kept.select(*rows.columns).orderBy(*ORDER)


def _bucket_starts(rows: DataFrame) -> DataFrame:
    """(bucket, n, start): the rows of every bucket of blocks, and those of the buckets before it."""
    per_bucket = rows.groupBy(bucket_of("block_number").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.where("bucket IS NOT NULL").withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def capped(rows: DataFrame, limit: int, offset: int, cap: int | None = None) -> tuple[DataFrame, bool]:
    """A page and whether it ended at the cap with rows left over.

    Only a limit of exactly ``cap`` can overflow, measured after the offset; counting stops one row above the cap.
    """
    if cap is None or limit != cap:
        return page(rows, limit, offset), False
    over = rows.select(F.lit(1)).limit(offset + cap + 1).count() > offset + cap
    return page(rows, cap, offset), over


def query_events(
    events: DataFrame, contracts: DataFrame, covered: DataFrame, query: EventQuery, cap: int | None = None
) -> tuple[str, DataFrame]:
    """Outcome and rows of one request; the small guards run before the events are touched."""
    none = events.limit(0)
    if query.contract is not None:
        if contracts.where(F.col("address") == query.contract).limit(1).isEmpty():
            return "NotIndexed", none
        if query.from_block is not None and query.to_block is not None:
            holding = covered.where(
                (F.col("contract") == query.contract)
                & (F.col("from_block") <= query.from_block)
                & (F.col("to_block") >= query.to_block)
            )
            if holding.limit(1).isEmpty():
                return "MissingCoverage", none
    rows, over = capped(filter_events(events, query), query.limit, query.offset, cap)
    if over:
        return "Capped", rows
    return ("Empty", rows) if rows.isEmpty() else ("Results", rows)


# --- request tables --------------------------------------------------------------


def filter_requests(requests: DataFrame, contracts: DataFrame, cap: int | None = None) -> DataFrame:
    """Clean up log filters (addresses, topics): add ``plan`` and ``reason`` and the usable fields.

    A usable filter has exactly one address, at most one first topic and nothing in later positions; its limit is
    ``cap``, or 0 (no limit). Addresses are the same whatever the case of their digits; the usable one is written as
    ``contracts`` has it, or as given where that table does not know it.
    """
    given = F.array_distinct(F.transform("addresses", F.lower))
    addresses = F.coalesce(F.size(given), F.lit(0))
    first = F.array_distinct(F.coalesce(F.get("topics", F.lit(0)), F.expr("array() :: array<string>")))
    later = F.exists(F.slice(F.coalesce("topics", F.expr("array() :: array<array<string>>")), 2, 1 << 30), lambda t: F.size(t) > 0)
    reason = (
        F.when(addresses > 1, "multiple address filters are not supported")
        .when(F.size(first) > 1, "topic0 OR filters are not supported")
        .when(later, "topic filters beyond topic0 are not supported")
    )
    plan = F.when(addresses == 0, "MissingAddress").when(reason.isNotNull(), "Unsupported").otherwise("Query")
    usable = lambda c: F.when(plan == "Query", c)
    known = contracts.groupBy(F.lower("address").alias("_lower")).agg(F.min("address").alias("_known"))
    placed = requests.withColumn("_lower", usable(F.get(given, F.lit(0)))).join(known, "_lower", "left")
    return placed.select(
        "request_id",
        plan.alias("plan"),
        F.when(plan == "Unsupported", reason).alias("reason"),
        usable(F.coalesce("_known", F.get("addresses", F.lit(0)))).alias("contract"),
        F.lit(None).cast("string").alias("event_name"),
        usable(F.get(first, F.lit(0))).alias("topic0"),
        "from_block",
        "to_block",
        usable(F.lit(cap or 0).cast("bigint")).alias("page_limit"),
        usable(F.lit(0).cast("bigint")).alias("page_offset"),
    )


def page_requests(requests: DataFrame, default_limit: int = 0, cap: int | None = None) -> DataFrame:
    """Fill in the page of every request; the contract text is left as given.

    A request without a limit gets ``default_limit`` (0: all rows). With a ``cap``, larger limits come down to it.
    """
    limit = F.coalesce("page_limit", F.lit(default_limit))
    return requests.withColumns(
        {
            "page_limit": (limit if cap is None else F.least(limit, F.lit(cap))).cast("bigint"),
            "page_offset": F.coalesce("page_offset", F.lit(0)).cast("bigint"),
        }
    )


def _bounds(requests: DataFrame, events: DataFrame, counts: DataFrame | None) -> tuple[Ranks, DataFrame]:
    """(request_id, kind, low_rank, high_rank): the ranks, in its kind, of the events that each request selects."""
    work = Work(events.sparkSession, "requests")
    counts = work.keep("counts", bucket_counts(events)) if counts is None else counts
    low, high = F.coalesce("from_block", F.lit(0).cast("bigint")), F.coalesce("to_block", F.lit(_LARGEST))
    usable = requests.select("request_id", *DIMENSIONS, (low - 1).alias("before"), high.alias("high")).where("before < high")
    wanted = work.keep("wanted", with_kinds(usable))
    ranks = Ranks(wanted, events, counts, work)
    ends = wanted.select("request_id", "kind", F.inline(F.array(*[F.struct(F.col(c).alias("at"), F.lit(c).alias("end")) for c in ("before", "high")])))
    known = ranks.rank(ends.select("kind", "at").distinct()).join(ends, ["kind", "at"])
    rank = lambda end: F.max(F.when(F.col("end") == end, F.col("rank")))
    return ranks, work.keep("bounds", known.groupBy("request_id", "kind").agg(rank("before").alias("low_rank"), rank("high").alias("high_rank")))


def count_matches(requests: DataFrame, events: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(request_id, matches): how many events each request selects; a reversed range selects none.

    The difference of two ranks. ``counts`` are the events' ``bucket_counts`` where they are kept.
    """
    return _bounds(requests, events, counts)[1].select("request_id", (F.col("high_rank") - F.col("low_rank")).alias("matches"))


def _checked(requests: DataFrame, contracts: DataFrame, covered: DataFrame) -> DataFrame:
    """Requests with ``refused``: why one is not looked at, or NULL."""
    known = contracts.select(F.col("address").alias("contract"), F.lit(True).alias("indexed"))
    guarded = F.col("contract").isNotNull() & F.col("from_block").isNotNull() & F.col("to_block").isNotNull()
    holding = range_covered(requests.where(guarded).select("request_id", "contract", "from_block", "to_block"), covered)
    why = F.when(F.col("contract").isNotNull() & F.col("indexed").isNull(), "NotIndexed").when(guarded & F.col("covered").isNull(), "MissingCoverage")
    return (
        requests.join(known, "contract", "left")
        .join(holding.select("request_id", F.lit(True).alias("covered")), "request_id", "left")
        .withColumn("refused", why)
    )


def query_rows(requests: DataFrame, events: DataFrame, contracts: DataFrame, covered: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(request_id, position, event columns): the rows of a whole table of requests, in one job.

    ``position`` counts from 0 in the result order of the whole request, so a page begins at its offset; a limit of 0
    means all rows that follow. Refused requests have no rows. Work grows with the requests, the buckets that their
    pages and bounds lie in, and the rows that come back.
    """
    checked = _checked(requests, contracts, covered).where(F.col("refused").isNull())
    ranks, bounds = _bounds(checked, events, counts)
    first = F.col("low_rank") + F.col("page_offset")
    last = F.when(F.col("page_limit") == 0, F.col("high_rank")).otherwise(F.least("high_rank", first + F.col("page_limit")))
    pages = bounds.join(checked.select("request_id", "page_limit", "page_offset"), "request_id")
    rows = ranks.select(pages.select("request_id", "kind", "low_rank", first.alias("first"), last.alias("last")))
    columns = [c for c in events.columns if c != "block_bucket"]
    return rows.select("request_id", (F.col("rank") - F.col("low_rank")).alias("position"), *columns)


def query_outcome(
    requests: DataFrame,
    events: DataFrame,
    contracts: DataFrame,
    covered: DataFrame,
    cap: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(request_id, outcome, rows_returned) for a whole table of requests in one job."""
    checked = _checked(requests, contracts, covered)
    found = count_matches(checked.where(F.col("refused").isNull()), events, counts)
    after = F.greatest(F.coalesce("matches", F.lit(0)) - F.col("page_offset"), F.lit(0))
    returned = F.when(F.col("page_limit") == 0, after).otherwise(F.least(after, "page_limit"))
    outcome: Column = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when((F.col("page_limit") == cap) & (after > cap) if cap is not None else F.lit(False), "Capped")
        .when(returned == 0, "Empty")
        .otherwise("Results")
    )
    return checked.join(found, "request_id", "left").select(
        "request_id",
        outcome.alias("outcome"),
        F.when(F.col("refused").isNull(), returned).otherwise(0).cast("bigint").alias("rows_returned"),
    )
