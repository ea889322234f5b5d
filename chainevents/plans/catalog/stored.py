"""Queries over stored events, contracts and status."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainevents.functions import expressions as X
from chainevents.operators import projection, status
from chainevents.plans import query as Q
from chainevents.plans.catalog.sample import ARRIVAL, DUCK, SPARK, Sample, address, duck, in_arrival, of_items, query, quote
from chainevents.session import shared_folder
from chainevents.sources import store

_KEYS = "block_number, tx_index, log_index"
_ROW = "contract, event_name, topic0, block_number, block_hash, tx_hash, tx_index, log_index, raw_topics, raw_data, decoded, source, timestamp"
_OLD = "timestamp < 946684800"
#: Arguments of the checked requests: the cap that reports Capped, and the page of a request without a limit.
CAP, PAGE = 10_000, 100


# --- sinks -----------------------------------------------------------------------


@query(duck(f"SELECT {_ROW} FROM stored", "logs", "stored"))
def event_dedup(s: Sample) -> DataFrame:
    return s.stored


@query(
    duck(
        f"SELECT {_ROW} FROM stored WHERE NOT EXISTS (SELECT 1 FROM logs o WHERE o.{_OLD} AND o.block_number = stored.block_number "
        "AND o.tx_index = stored.tx_index AND o.log_index = stored.log_index)",
        "logs", "stored",
    )
)
def event_append(s: Sample) -> DataFrame:
    existing = s.logs.where(_OLD).select("block_number", "tx_index", "log_index")
    return s.shaped(store.new_events(existing, s.unshaped, in_arrival()))


@query(
    duck(
        "SELECT (SELECT CAST(count(*) AS BIGINT) FROM logs) AS handed_over, (SELECT CAST(count(*) AS BIGINT) FROM stored "
        f"WHERE ({_KEYS}) NOT IN (SELECT ({_KEYS}) FROM logs WHERE {_OLD})) AS inserted",
        "logs", "stored",
    )
)
def run_totals(s: Sample) -> DataFrame:
    existing = s.logs.where(_OLD).select("block_number", "tx_index", "log_index")
    added = store.new_events(existing, s.unshaped, in_arrival()).agg(F.count(F.lit(1)).alias("inserted"))
    return s.logs.agg(F.count(F.lit(1)).alias("handed_over")).withColumn("inserted", added.scalar())


@query(
    duck(
        f"SELECT CAST(count(*) AS BIGINT) AS first_run, CAST(0 AS BIGINT) AS second_run FROM (SELECT DISTINCT {_KEYS} FROM logs)",
        "logs",
    )
)
def rerun_idempotent(s: Sample) -> DataFrame:
    stored = s.stored
    again = store.new_events(stored, s.unshaped, in_arrival()).agg(F.count(F.lit(1)).alias("n"))
    return stored.agg(F.count(F.lit(1)).alias("first_run")).withColumn("second_run", again.scalar())


_UPSERT_OLD, _UPSERT_NEW = "s_suppkey % 2 = 0", "s_suppkey % 3 = 0"


@query(
    duck(
        "SELECT coalesce(o.address, n.address) AS address, coalesce(n.name, o.name) AS name, "
        "CASE WHEN n.address IS NOT NULL THEN n.abi_json ELSE o.abi_json END AS abi_json FROM "
        f"(SELECT {DUCK.address('s_suppkey')} AS address, s_name AS name, 'old' AS abi_json FROM supplier WHERE {_UPSERT_OLD}) o FULL JOIN "
        f"(SELECT {DUCK.address('s_suppkey')} AS address, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'new ' || s_name END AS name, "
        f"CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'new' END AS abi_json FROM supplier WHERE {_UPSERT_NEW}) n ON o.address = n.address"
    )
)
def contract_upsert(s: Sample) -> DataFrame:
    supplier, key = s.table("supplier"), f"{SPARK.address('s_suppkey')} AS address"
    old = supplier.where(_UPSERT_OLD).selectExpr(key, "s_name AS name", "'old' AS abi_json")
    new = supplier.where(_UPSERT_NEW).selectExpr(
        key,
        "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'new ' || s_name END AS name",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'new' END AS abi_json",
    )
    return store.upsert_contracts(old, new)


@query(
    duck(
        f"SELECT q.address, c.abi_json, c.abi_json IS NOT NULL AS found FROM (SELECT {DUCK.address('c_custkey % 120')} AS address FROM customer) q "
        "LEFT JOIN registered c ON c.address = q.address",
        "contracts", "registered",
    )
)
def abi_lookup(s: Sample) -> DataFrame:
    asked = s.table("customer").selectExpr(f"{SPARK.address('c_custkey % 120')} AS address")
    return store.lookup_abi(asked, s.contracts)


@query()
def dataset_size(s: Sample) -> DataFrame:
    return store.dataset_size(s.table("lineitem"))


# --- filters, order, pages ---------------------------------------------------------

_ONE = address(3)
_RANGE = Q.EventQuery(contract=_ONE, event_name="AF", from_block=1000, to_block=12000)


@query(
    duck(
        f"SELECT {_ROW} FROM stored WHERE contract = {quote(_ONE)} AND event_name = 'AF' AND block_number BETWEEN 1000 AND 12000",
        "logs", "stored",
    )
)
def event_query(s: Sample) -> DataFrame:
    return Q.event_query(s.stored, _RANGE)


_TOPIC = Q.EventQuery(event_name="NO", limit=100, offset=250)


@query(
    duck(
        f"SELECT {_ROW} FROM stored WHERE event_name = 'NO' ORDER BY block_number, log_index, tx_index LIMIT 100 OFFSET 250",
        "logs", "stored",
    )
)
def event_page(s: Sample) -> DataFrame:
    return Q.event_query(s.stored, _TOPIC)


@query(
    duck(
        "SELECT block_number, log_index, tx_index, contract FROM stored ORDER BY block_number, log_index, tx_index LIMIT 3000 OFFSET 20000",
        "logs", "stored",
    )
)
def event_page_deep(s: Sample) -> DataFrame:
    return Q.page(s.stored, 3000, 20000).select("block_number", "log_index", "tx_index", "contract")


def _capped_sql(where: str, limit: str) -> str:
    return duck(
        f"SELECT block_number, log_index, tx_index, (SELECT count(*) > 10050 FROM stored WHERE {where}) AND {limit!r} <> '' AS capped FROM "
        f"(SELECT * FROM stored WHERE {where} ORDER BY block_number, log_index, tx_index {limit} OFFSET 50)",
        "logs", "stored",
    )


def _capped(s: Sample, wanted: Q.EventQuery, cap: int | None) -> DataFrame:
    rows, over = Q.capped(Q.filter_events(s.stored, wanted), cap or 0, 50, cap)
    return rows.select("block_number", "log_index", "tx_index", F.lit(over).alias("capped"))


@query(_capped_sql("event_name = 'AF'", "LIMIT 10000"))
def capped_query(s: Sample) -> DataFrame:
    return _capped(s, Q.EventQuery(event_name="AF"), CAP)


@query(_capped_sql("true", "LIMIT 10000"))
def capped_query_over(s: Sample) -> DataFrame:
    return _capped(s, Q.EventQuery(), CAP)


@query(_capped_sql("true", ""))
def uncapped_query(s: Sample) -> DataFrame:
    return _capped(s, Q.EventQuery(), None)


# --- the stored layout: partitions by block bucket, sorted by contract and topic -------

_kept: dict[tuple[str, str], store.Store] = {}


def stored_layout(s: Sample) -> store.Store:
    """The stored events written as the sync run writes them; once per application and data directory."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir)
    if key not in _kept:
        written = store.Store(s.spark, f"{shared_folder(s.spark)}/store-{uuid.uuid4().hex}")
        low, high = s.present.agg(F.min("block_number"), F.max("block_number")).first()
        written.append_events(s.unshaped, low or 0, high or 0, of_items())
        _kept[key] = written
    return _kept[key]


@query(
    duck(
        f"SELECT {_ROW} FROM stored WHERE contract = {quote(_ONE)} AND event_name = 'AF' AND block_number BETWEEN 1000 AND 12000",
        "logs", "stored",
    )
)
def stored_event_query(s: Sample) -> DataFrame:
    return Q.event_query(stored_layout(s).events, _RANGE)


@query(
    duck(
        f"SELECT {_ROW} FROM stored WHERE event_name = 'NO' ORDER BY block_number, log_index, tx_index LIMIT 100 OFFSET 250",
        "logs", "stored",
    )
)
def stored_event_page(s: Sample) -> DataFrame:
    return Q.event_query(stored_layout(s).events, _TOPIC)


@query(
    duck(
        "SELECT CAST(count(*) AS BIGINT) AS event_count, (SELECT CAST(count(*) AS BIGINT) FROM registered) AS contract_count FROM stored",
        "logs", "stored", "contracts", "registered",
    )
)
def stored_totals(s: Sample) -> DataFrame:
    return status.totals(stored_layout(s).events, s.contracts)


@query(
    duck(
        f"SELECT CAST(count(*) AS BIGINT) AS first_run, CAST(count(*) AS BIGINT) AS second_run FROM (SELECT DISTINCT {_KEYS} FROM logs)",
        "logs",
    )
)
def stored_rerun(s: Sample) -> DataFrame:
    """Rows of the stored table before and after the same events are handed over again."""
    written = stored_layout(s)
    first = written.events.agg(F.count(F.lit(1)).alias("first_run"))
    before = first.first().first_run
    low, high = s.present.agg(F.min("block_number"), F.max("block_number")).first()
    written.append_events(s.unshaped, low or 0, high or 0, of_items())
    return written.events.agg(F.lit(before).cast("bigint").alias("first_run"), F.count(F.lit(1)).alias("second_run"))


# --- requests ----------------------------------------------------------------------

_ADDRESSES = "CASE c_custkey % 5 WHEN 0 THEN {none} WHEN 1 THEN {two} WHEN 2 THEN {lower} WHEN 3 THEN {both} ELSE {one} END"
_FIRST = "CASE c_custkey % 6 WHEN 4 THEN {two} WHEN 5 THEN {one} ELSE {none} END"
_LATER = "CASE WHEN c_custkey % 10 = 3 THEN {one} ELSE {none} END"


def _filters(spark: bool) -> str:
    d = SPARK if spark else DUCK
    array = (lambda *xs: f"array({', '.join(xs)})") if spark else (lambda *xs: f"[{', '.join(xs)}]")
    none = "cast(array() as array<string>)" if spark else "CAST([] AS VARCHAR[])"
    topics = lambda t: t.format(none=none, one=array("'t1'"), two=array("'t1'", "'t2'"))
    own = f"'0xAb' || substr({d.address('c_custkey % 150')}, 5)"
    addresses = _ADDRESSES.format(none=none, one=array(own), two=array(own, "'0xother'"), lower=array(f"lower({own})"), both=array(own, f"lower({own})"))
    return f"c_custkey AS request_id, {addresses} AS addresses, {array(topics(_FIRST), topics(_LATER))} AS topics, c_custkey AS from_block, c_custkey + 100 AS to_block"


def _mixed_case(spark: bool) -> str:
    """Contracts whose addresses have capital digits; not every asked one is among them."""
    return f"SELECT '0xAb' || substr({(SPARK if spark else DUCK).address('s_suppkey')}, 5) AS address FROM {'{supplier}' if spark else 'supplier'}"


@query(
    f"""WITH f AS (SELECT {_filters(False)} FROM customer), known AS ({_mixed_case(False)}),
    p AS (SELECT *, CASE WHEN len(list_distinct(list_transform(addresses, lambda a: lower(a)))) > 1 THEN 'multiple address filters are not supported'
      WHEN len(topics[1]) > 1 THEN 'topic0 OR filters are not supported'
      WHEN len(topics[2]) > 0 THEN 'topic filters beyond topic0 are not supported' END AS why FROM f),
    q AS (SELECT *, CASE WHEN len(addresses) = 0 THEN 'MissingAddress' WHEN why IS NOT NULL THEN 'Unsupported' ELSE 'Query' END AS plan FROM p)
    SELECT request_id, plan, CASE WHEN plan = 'Unsupported' THEN why END AS reason, CASE WHEN plan = 'Query' THEN coalesce((SELECT min(address) FROM known WHERE lower(address) = lower(addresses[1])), addresses[1]) END AS contract,
      CAST(NULL AS VARCHAR) AS event_name, CASE WHEN plan = 'Query' THEN topics[1][1] END AS topic0, from_block, to_block,
      CAST(CASE WHEN plan = 'Query' THEN 10000 END AS BIGINT) AS page_limit, CAST(CASE WHEN plan = 'Query' THEN 0 END AS BIGINT) AS page_offset FROM q"""
)
def filter_requests(s: Sample) -> DataFrame:
    asked = s.spark.sql(f"SELECT {_filters(True)} FROM {{customer}}", customer=s.table("customer"))
    return Q.filter_requests(asked, s.spark.sql(_mixed_case(True), supplier=s.table("supplier")), CAP)


_RAW_LIMIT = "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN c_custkey * 50 ELSE 0 END"
_RAW_OFFSET = "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END"


@query(
    f"SELECT c_custkey AS request_id, CAST(least(coalesce({_RAW_LIMIT}, 100), 10000) AS BIGINT) AS page_limit, "
    f"CAST(coalesce({_RAW_OFFSET}, 0) AS BIGINT) AS page_offset FROM customer"
)
def page_requests(s: Sample) -> DataFrame:
    asked = s.table("customer").selectExpr("c_custkey AS request_id", f"{_RAW_LIMIT} AS page_limit", f"{_RAW_OFFSET} AS page_offset")
    return Q.page_requests(asked, PAGE, CAP)


_OUTCOME_SQL = (
    duck(
        """, matched AS (SELECT q.request_id, count(e.block_number) AS n FROM requests q LEFT JOIN stored e
          ON (q.contract IS NULL OR q.contract = e.contract) AND (q.event_name IS NULL OR q.event_name = e.event_name)
          AND (q.topic0 IS NULL OR q.topic0 = e.topic0) AND e.block_number >= coalesce(q.from_block, 0)
          AND e.block_number <= coalesce(q.to_block, 9223372036854775807) GROUP BY q.request_id),
        refused AS (SELECT q.request_id, CASE
          WHEN q.contract IS NOT NULL AND NOT EXISTS (SELECT 1 FROM registered r WHERE r.address = q.contract) THEN 'NotIndexed'
          WHEN q.contract IS NOT NULL AND q.from_block IS NOT NULL AND q.to_block IS NOT NULL AND NOT EXISTS (SELECT 1 FROM covered c
            WHERE c.contract = q.contract AND c.from_block <= q.from_block AND c.to_block >= q.to_block) THEN 'MissingCoverage' END AS why FROM requests q),
        counted AS (SELECT q.request_id, r.why, q.page_limit, greatest(m.n - q.page_offset, 0) AS after FROM requests q
          JOIN refused r ON r.request_id = q.request_id JOIN matched m ON m.request_id = q.request_id),
        sized AS (SELECT *, CASE WHEN page_limit = 0 THEN after ELSE least(after, page_limit) END AS got FROM counted)
        SELECT request_id, CASE WHEN why IS NOT NULL THEN why WHEN page_limit = 10000 AND after > 10000 THEN 'Capped'
          WHEN got = 0 THEN 'Empty' ELSE 'Results' END AS outcome,
          CAST(CASE WHEN why IS NULL THEN got ELSE 0 END AS BIGINT) AS rows_returned FROM sized""",
        "logs", "stored", "contracts", "registered", "covered_own", "covered", "requests",
    ).replace(") , matched", "), matched")
)


@query(_OUTCOME_SQL)
def query_outcome(s: Sample) -> DataFrame:
    return Q.query_outcome(s.view("requests"), s.bucketed, s.contracts, s.covered, CAP)


@query(_OUTCOME_SQL)
def stored_query_outcome(s: Sample) -> DataFrame:
    """Counts come from the roll-up; events are read only in the buckets where a request begins or ends."""
    written = stored_layout(s)
    return Q.query_outcome(s.view("requests"), written.events, s.contracts, s.covered, CAP, written.bucket_counts)


_ROWS_SQL = (
    duck(
        """, allowed AS (SELECT * FROM requests q WHERE NOT (q.contract IS NOT NULL AND NOT EXISTS (SELECT 1 FROM registered r WHERE r.address = q.contract))
          AND NOT (q.contract IS NOT NULL AND q.from_block IS NOT NULL AND q.to_block IS NOT NULL AND NOT EXISTS (SELECT 1 FROM covered c
            WHERE c.contract = q.contract AND c.from_block <= q.from_block AND c.to_block >= q.to_block))),
        placed AS (SELECT q.request_id, q.page_limit, q.page_offset, e.*, row_number() OVER (PARTITION BY q.request_id ORDER BY e.block_number, e.log_index, e.tx_index) - 1 AS position
          FROM allowed q JOIN stored e ON (q.contract IS NULL OR q.contract = e.contract) AND (q.event_name IS NULL OR q.event_name = e.event_name)
          AND (q.topic0 IS NULL OR q.topic0 = e.topic0) AND e.block_number >= coalesce(q.from_block, 0) AND e.block_number <= coalesce(q.to_block, 9223372036854775807))
        SELECT * EXCLUDE (page_limit, page_offset) FROM placed WHERE position >= page_offset AND (page_limit = 0 OR position < page_offset + page_limit)""",
        "logs", "stored", "contracts", "registered", "covered_own", "covered", "requests",
    ).replace(") , allowed", "), allowed")
)


@query(_ROWS_SQL)
def query_rows(s: Sample) -> DataFrame:
    return Q.query_rows(s.view("requests"), s.bucketed, s.contracts, s.covered)


@query(_ROWS_SQL.replace(", ".join(ARRIVAL), "contract, event_name, decoded"))
def stored_query_rows(s: Sample) -> DataFrame:
    """Of rows that share a key, the store keeps the first by contract, name and decoded text."""
    written = stored_layout(s)
    return Q.query_rows(s.view("requests"), written.events, s.contracts, s.covered, written.bucket_counts)


# --- projections and quality ---------------------------------------------------------

_QUALITY = r""", graded AS (SELECT *,
  CASE WHEN block_number < 0 OR tx_index < 0 OR log_index < 0
      THEN 'negative identity field (block ' || block_number || ', tx ' || tx_index || ', log ' || log_index || ')'
    WHEN NOT regexp_full_match(contract, '(0x)?[0-9a-fA-F]{40}') THEN 'contract address parse failed'
    WHEN NOT regexp_full_match(tx_hash, '(0x)?[0-9a-fA-F]{64}') THEN 'tx_hash parse failed'
    WHEN NOT regexp_full_match(block_hash, '(0x)?[0-9a-fA-F]{64}') THEN 'block_hash parse failed'
    WHEN NOT regexp_full_match(raw_topics, '\[("[^"]*"(,"[^"]*")*)?\]') THEN 'raw_topics JSON parse failed'
    WHEN NOT regexp_full_match(raw_topics, '\[("(0x)?[0-9a-fA-F]{64}"(,"(0x)?[0-9a-fA-F]{64}")*)?\]') THEN 'topic value parse failed'
    WHEN length(raw_topics) - length(replace(raw_topics, ',', '')) >= 4 THEN 'log shape invalid: more than four topics' END AS broken,
  CASE WHEN NOT regexp_full_match(raw_data, '(0x)?([0-9a-fA-F]{2})*') THEN 'raw_data hex decode failed' END AS bad_data,
  CASE WHEN NOT json_valid(decoded) THEN 'decoded JSON parse failed' END AS bad_json FROM damaged)"""


def _graded(body: str) -> str:
    return duck(_QUALITY + body, "logs", "damaged").replace(") , graded", "), graded")


@query(
    _graded(
        r""" SELECT block_number, tx_index, log_index, contract,
        CASE WHEN broken IS NOT NULL THEN 'invalid' WHEN bad_data IS NOT NULL OR bad_json IS NOT NULL THEN 'lossy' ELSE 'valid' END AS quality,
        coalesce(broken, CASE WHEN bad_data IS NOT NULL AND bad_json IS NOT NULL THEN bad_data || '; ' || bad_json ELSE coalesce(bad_data, bad_json) END)
          AS quality_reason FROM graded"""
    )
)
def row_quality(s: Sample) -> DataFrame:
    graded = projection.row_quality(s.view("damaged"))
    return graded.select("block_number", "tx_index", "log_index", "contract", "quality", "quality_reason")


@query(
    _graded(
        r""" SELECT block_number, tx_index, log_index, contract,
        CASE WHEN broken IS NOT NULL THEN 'invalid' WHEN bad_data IS NOT NULL THEN 'lossy' ELSE 'valid' END AS quality,
        coalesce(broken, bad_data) AS quality_reason,
        CASE WHEN bad_data IS NULL THEN lower(regexp_replace(raw_data, '^0x', '')) ELSE '' END AS data,
        CASE WHEN regexp_full_match(raw_topics, '\[("[^"]*"(,"[^"]*")*)?\]')
          THEN (CASE WHEN raw_topics = '[]' THEN 0 ELSE length(raw_topics) - length(replace(raw_topics, ',', '')) + 1 END) END AS n_topics FROM graded"""
    )
)
def log_shape(s: Sample) -> DataFrame:
    shaped = projection.log_shape(s.view("damaged"))
    return shaped.select(
        "block_number", "tx_index", "log_index", "contract", "quality", "quality_reason",
        X.hex_text("data").alias("data"), F.size("topics").cast("bigint").alias("n_topics"),
    )


@query(
    _graded(
        """ SELECT contract, event_name, topic0, block_number, block_hash, tx_hash, tx_index, log_index, source, timestamp,
        CASE WHEN bad_json IS NULL THEN json_extract_string(decoded, '$.quantity') END AS decoded_quantity,
        bad_json IS NOT NULL AS decoded_missing,
        CASE WHEN broken IS NOT NULL THEN 'invalid' WHEN bad_data IS NOT NULL OR bad_json IS NOT NULL THEN 'lossy' END AS quality FROM graded"""
    )
)
def event_shape(s: Sample) -> DataFrame:
    shaped = projection.event_shape(s.view("damaged"))
    plain = [c for c in projection.API_FIELDS if c != "decoded"]
    return shaped.select(
        *plain,
        F.try_variant_get("decoded", "$.quantity", "string").alias("decoded_quantity"),
        F.col("decoded").isNull().alias("decoded_missing"),
        F.col("decode_quality.quality").alias("quality"),
    )


@query(
    _graded(
        """ SELECT block_number, log_index, tx_index, CASE WHEN broken IS NOT NULL THEN 'invalid' ELSE 'lossy' END AS quality,
        coalesce(broken, bad_data) AS quality_reason FROM graded WHERE broken IS NOT NULL OR bad_data IS NOT NULL"""
    )
)
def strict_violations(s: Sample) -> DataFrame:
    return projection.strict_violations(s.view("damaged"))


@query(
    duck(
        "SELECT block_number, tx_index, log_index, contract FROM damaged WHERE json_valid(decoded) AND json_exists(decoded, '$._decode_error')",
        "logs", "damaged",
    )
)
def decode_errors(s: Sample) -> DataFrame:
    return s.view("damaged").where(X.has_decode_error("decoded")).select("block_number", "tx_index", "log_index", "contract")


# --- scalar expressions ----------------------------------------------------------------


@query(duck("SELECT block_number, '0x' || lower(to_hex(block_number)) AS quantity FROM headers", "headers"))
def hex_quantity(s: Sample) -> DataFrame:
    return s.headers.select("block_number", X.hex_quantity("block_number").alias("quantity"))


_PROPS = "CASE WHEN event_id % 50 = 0 THEN '{bad' WHEN event_id % 51 = 0 THEN 'null' ELSE props END"


@query(
    f"SELECT event_id, NOT json_valid({_PROPS}) AS unreadable, CASE WHEN json_valid({_PROPS}) THEN json_type({_PROPS}) = 'NULL' ELSE false END AS stored_null, "
    f"CASE WHEN json_valid({_PROPS}) THEN CAST(json_extract_string({_PROPS}, '$.k') AS BIGINT) END AS k FROM events"
)
def decoded_json(s: Sample) -> DataFrame:
    parsed = s.table("events").selectExpr("event_id", f"{_PROPS} AS text").withColumn("value", X.decoded_json("text"))
    return parsed.select(
        "event_id",
        F.col("value").isNull().alias("unreadable"),
        F.coalesce(F.is_variant_null("value"), F.lit(False)).alias("stored_null"),
        F.try_variant_get("value", "$.k", "bigint").alias("k"),
    )


@query(f"SELECT event_id, CASE WHEN json_valid({_PROPS}) THEN json_extract_string({_PROPS}, '$.k') END AS k FROM events")
def decoded_field(s: Sample) -> DataFrame:
    return s.table("events").selectExpr("event_id", f"{_PROPS} AS text").select("event_id", X.decoded_field("text", "k").alias("k"))


@query(
    duck(
        "SELECT block_number, tx_index, log_index, contract, CASE WHEN regexp_full_match(raw_data, '(0x)?([0-9a-fA-F]{2})*') "
        "THEN CAST(length(regexp_replace(raw_data, '^0x', '')) // 2 AS BIGINT) END AS n_bytes, "
        "CASE WHEN regexp_full_match(raw_data, '(0x)?([0-9a-fA-F]{2})*') THEN regexp_replace(raw_data, '^0x', '') END AS hex_again FROM damaged",
        "logs", "damaged",
    )
)
def raw_data_bytes(s: Sample) -> DataFrame:
    data = X.bytes_or_null("raw_data")
    return s.view("damaged").select(
        "block_number", "tx_index", "log_index", "contract",
        F.length(data).cast("bigint").alias("n_bytes"), X.hex_text(data).alias("hex_again"),
    )


@query(
    duck(
        r"""SELECT block_number, tx_index, log_index, contract,
        CASE WHEN regexp_full_match(raw_topics, '\[("[^"]*"(,"[^"]*")*)?\]') THEN replace(replace(replace(raw_topics, '[', ''), ']', ''), '"', '') END AS joined,
        CASE WHEN regexp_full_match(raw_topics, '\[("[^"]*"(,"[^"]*")*)?\]') THEN raw_topics END AS text_again FROM damaged""",
        "logs", "damaged",
    )
)
def topics_array(s: Sample) -> DataFrame:
    topics = X.topics_array("raw_topics")
    return s.view("damaged").select(
        "block_number", "tx_index", "log_index", "contract",
        F.array_join(topics, ",").alias("joined"), X.topics_text(topics).alias("text_again"),
    )


# --- status ----------------------------------------------------------------------------


@query(
    duck(
        "SELECT max(block_number) AS latest_block, coalesce(max(block_number), 0) AS served_block, "
        "'0x' || lower(to_hex(coalesce(max(block_number), 0))) AS hex_block FROM logs",
        "logs",
    )
)
def latest_block(s: Sample) -> DataFrame:
    return status.latest_block(s.logs)


@query(duck("SELECT min(block_number) AS min_block, max(block_number) AS max_block FROM logs", "logs"))
def indexed_range(s: Sample) -> DataFrame:
    return status.indexed_range(s.logs)


@query(
    duck(
        "SELECT CAST(count(*) AS BIGINT) AS event_count, (SELECT CAST(count(*) AS BIGINT) FROM registered) AS contract_count FROM stored",
        "logs", "stored", "contracts", "registered",
    )
)
def totals(s: Sample) -> DataFrame:
    return status.totals(s.stored, s.contracts)


@query(
    duck(
        f"SELECT event_name, CAST(count(*) AS BIGINT) AS event_count FROM stored WHERE contract = {quote(_ONE)} GROUP BY event_name",
        "logs", "stored",
    )
)
def event_breakdown(s: Sample) -> DataFrame:
    return status.event_breakdown(s.stored, _ONE)


@query(
    duck(
        "SELECT c.address, c.name, CAST(count(e.block_number) AS BIGINT) AS event_count FROM registered c "
        "LEFT JOIN stored e ON e.contract = c.address GROUP BY c.address, c.name",
        "logs", "stored", "contracts", "registered",
    )
)
def contract_counts(s: Sample) -> DataFrame:
    return status.contract_counts(s.stored, s.contracts)


_STATUS_SQL = (
    duck(
        ", by_name AS (SELECT contract, event_name, count(*) AS n FROM stored GROUP BY ALL) "
        "SELECT c.address, c.name, CAST(coalesce((SELECT sum(n) FROM by_name b WHERE b.contract = c.address), 0) AS BIGINT) AS total_events, "
        "(SELECT string_agg(event_name || ':' || n, ',' ORDER BY event_name) FROM by_name b WHERE b.contract = c.address) AS breakdown, "
        "(SELECT CAST(count(*) AS BIGINT) FROM stored) AS event_count, (SELECT min(block_number) FROM stored) AS min_block, "
        "(SELECT max(block_number) FROM stored) AS latest_block, (SELECT CAST(count(*) AS BIGINT) FROM registered) AS contract_count FROM registered c",
        "logs", "stored", "contracts", "registered",
    ).replace(") , by_name", "), by_name")
)


def _summary(summary: DataFrame) -> DataFrame:
    text = F.transform("event_breakdown", lambda e: F.concat(e["event_name"], F.lit(":"), e["n"].cast("string")))
    return summary.withColumn("breakdown", F.array_join(text, ",")).drop("event_breakdown")


@query(_STATUS_SQL)
def status_summary(s: Sample) -> DataFrame:
    return _summary(status.status_summary(s.stored, s.contracts))


@query(_STATUS_SQL)
def stored_status(s: Sample) -> DataFrame:
    """From the roll-up alone: no event file is read."""
    return _summary(status.rolled_summary(stored_layout(s).rollup, s.contracts))


@query(
    duck(
        "SELECT contract, event_name, topic0, CAST(block_number // 8192 AS BIGINT) AS block_bucket, CAST(count(*) AS BIGINT) AS n, min(block_number) AS min_block, max(block_number) AS max_block "
        "FROM stored GROUP BY ALL",
        "logs", "stored",
    )
)
def stored_rollup(s: Sample) -> DataFrame:
    return stored_layout(s).rollup.select("contract", "event_name", "topic0", "block_bucket", "n", "min_block", "max_block")
