"""Queries over present blocks, failures, coverage and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainevents.operators import coverage, outcomes, presence
from chainevents.operators.matching import scope_blocks
from chainevents.plans.catalog import scopes as scope_queries
from chainevents.plans.catalog.sample import Sample, duck, query

_KEYS = ["scope_id"]

_PRESENT_SQL = """, seen AS (SELECT s.scope_id, p.block_number FROM present p JOIN scopes s ON p.block_number BETWEEN s.from_block AND s.to_block),
    islands AS (SELECT scope_id, min(block_number) AS from_block, max(block_number) AS to_block FROM
      (SELECT scope_id, block_number, block_number - row_number() OVER (PARTITION BY scope_id ORDER BY block_number) AS g FROM seen) GROUP BY scope_id, g),
    edges AS (SELECT scope_id, to_block + 1 AS gap_from, lead(from_block) OVER (PARTITION BY scope_id ORDER BY from_block) - 1 AS gap_to FROM islands),
    gaps AS (SELECT e.scope_id, e.gap_from, coalesce(e.gap_to, s.to_block) AS gap_to FROM edges e JOIN scopes s ON s.scope_id = e.scope_id
      WHERE e.gap_from <= coalesce(e.gap_to, s.to_block)
      UNION ALL SELECT s.scope_id, s.from_block, coalesce(min(i.from_block) - 1, s.to_block) FROM scopes s LEFT JOIN islands i ON i.scope_id = s.scope_id
      GROUP BY s.scope_id, s.from_block, s.to_block HAVING s.from_block <= coalesce(min(i.from_block) - 1, s.to_block)),
    first_gaps AS (SELECT scope_id, min(gap_from) AS gap_from, arg_min(gap_to, gap_from) AS gap_to FROM gaps GROUP BY scope_id)"""
_FAILURE_SQL = """, failures AS (SELECT block_number, CASE WHEN block_number % 397 = 0 THEN 'VerifyFailure' ELSE 'DecodeFailure' END AS reason FROM present
      WHERE block_number % 397 = 0 OR block_number % 389 = 0),
    tainted AS (SELECT f.block_number, f.reason, s.scope_id, s.from_block, s.to_block FROM failures f JOIN scopes s ON f.block_number BETWEEN s.from_block AND s.to_block),
    firsts AS (SELECT scope_id, min(block_number) AS failed_block, arg_min(reason, block_number) AS reason FROM tainted GROUP BY scope_id)"""
# Blocks whose read or store failed, and scopes whose coverage could not be written, where a run has such.
_SOURCE, _STORE, _WRITE = "block_number % 997 = 5", "block_number % 991 = 6", "scope_id % 5 = 0"


def _decision_sql(source: str = "false", store: str = "false", write: str = "false") -> str:
    return f""", run AS (SELECT CASE WHEN bool_or({source}) THEN 'SourceFailure' WHEN bool_or({store}) THEN 'StoreFailure' END AS why FROM present),
    reasoned AS (SELECT s.scope_id, s.address, coalesce(f.reason, run.why) AS withheld, s.{write} AS unwritten, g.gap_from, g.gap_to FROM (SELECT *, false AS false FROM scopes) s
      CROSS JOIN run LEFT JOIN firsts f ON f.scope_id = s.scope_id LEFT JOIN first_gaps g ON g.scope_id = s.scope_id),
    decided AS (SELECT scope_id, address AS contract, CASE WHEN withheld IS NOT NULL THEN withheld WHEN unwritten THEN 'CoverageWriteFailed' WHEN gap_from IS NOT NULL THEN 'NoSourceData' END AS reason,
      CASE WHEN withheld IS NULL AND NOT unwritten THEN gap_from END AS gap_from, CASE WHEN withheld IS NULL AND NOT unwritten THEN gap_to END AS gap_to,
      withheld IS NULL AND NOT unwritten AS records FROM reasoned)"""


_DECISION_SQL = _decision_sql()


def _sql(*parts: str) -> str:
    return duck("".join(parts), "present", "scopes").replace(") , seen", "), seen").replace(") , failures", "), failures")


def _scopes(s: Sample) -> DataFrame:
    return s.view("scopes").select("scope_id", "name", "address", "from_block", "to_block")


def _present(s: Sample) -> DataFrame:
    return coverage.clip_to_scopes(coverage.present_ranges(s.present, []), _scopes(s), _KEYS, s.present)


def _failures(s: Sample) -> DataFrame:
    reason = F.expr("CASE WHEN block_number % 397 = 0 THEN 'VerifyFailure' WHEN block_number % 389 = 0 THEN 'DecodeFailure' END")
    return s.present.withColumn("reason", reason).where("reason IS NOT NULL").distinct()


@query(_sql(_PRESENT_SQL, " SELECT * FROM islands"))
def present_ranges(s: Sample) -> DataFrame:
    """The general form: any (scope, block) pairs."""
    pairs = scope_blocks(s.present.distinct(), _scopes(s).select("scope_id", "from_block", "to_block"), s.present)
    return coverage.present_ranges(pairs.select("scope_id", "block_number"), _KEYS)


@query(_sql(_PRESENT_SQL, " SELECT * FROM islands"))
def scope_present_ranges(s: Sample) -> DataFrame:
    """The form for scopes that share one block stream."""
    return _present(s)


@query(duck("SELECT block_number % 7 AS run, count(DISTINCT block_number) AS n_blocks FROM present GROUP BY ALL", "present"))
def presence_counts(s: Sample) -> DataFrame:
    """Different blocks of each of seven runs, counted on their bitmaps."""
    runs = s.present.withColumn("run", F.col("block_number") % 7)
    return presence.present_counts(presence.presence(runs, ["run"]), ["run"])


@query(duck("SELECT min(block_number) AS from_block, max(block_number) AS to_block FROM (SELECT block_number, block_number - row_number() OVER (ORDER BY block_number) AS g FROM present) GROUP BY g", "present"))
def present_ranges_one_scope(s: Sample) -> DataFrame:
    """One scope that holds every block: the islands of the whole table."""
    pairs = s.present.withColumn("scope_id", F.lit(0))
    return coverage.present_ranges(pairs, _KEYS).drop("scope_id")


def _two_runs(s: Sample) -> DataFrame:
    """Presence of two runs that each lack a third of the blocks, another one, and so share the last third; merged, all are there."""
    first, second = (s.present.where(F.col("block_number") % 3 != k) for k in (0, 1))
    return presence.merged_presence(presence.presence(first, []), presence.presence(second, []), [])


def _merged_present(s: Sample) -> DataFrame:
    return coverage.clip_to_scopes(presence.islands(_two_runs(s), []), _scopes(s), _KEYS, s.present)


@query(_sql(_PRESENT_SQL, " SELECT * FROM islands"))
def presence_ranges(s: Sample) -> DataFrame:
    """Islands of every scope out of the bitmaps of two runs that overlap."""
    return _merged_present(s)


@query(_sql(_PRESENT_SQL, " SELECT * FROM gaps"))
def presence_gaps(s: Sample) -> DataFrame:
    """Gaps of every scope out of the same bitmaps."""
    return coverage.missing_ranges(_scopes(s), _merged_present(s), _KEYS)


@query(_sql(_PRESENT_SQL, " SELECT * FROM gaps"))
def missing_ranges(s: Sample) -> DataFrame:
    return coverage.missing_ranges(_scopes(s), _present(s), _KEYS)


@query(_sql(_PRESENT_SQL, " SELECT * FROM first_gaps"))
def first_gap(s: Sample) -> DataFrame:
    return coverage.first_gap(coverage.missing_ranges(_scopes(s), _present(s), _KEYS), _KEYS)


@query(
    duck(
        "SELECT q.request_id, q.contract, q.from_block, q.to_block FROM requests q WHERE EXISTS (SELECT 1 FROM covered c WHERE c.contract = q.contract "
        "AND c.from_block <= q.from_block AND c.to_block >= q.to_block)",
        "covered_own", "covered", "requests",
    )
)
def range_covered(s: Sample) -> DataFrame:
    asked = s.view("requests").where("contract IS NOT NULL AND from_block IS NOT NULL AND to_block IS NOT NULL")
    return coverage.range_covered(asked.select("request_id", "contract", "from_block", "to_block"), s.covered)


@query(
    duck(
        "SELECT contract, from_block, to_block, source, CASE WHEN from_block % 200 = 0 THEN '2020-01-01' ELSE '2021-01-01' END AS recorded_on "
        "FROM (SELECT DISTINCT contract, from_block, to_block, source FROM covered)",
        "covered_own", "covered",
    )
)
def coverage_append(s: Sample) -> DataFrame:
    earlier = s.covered.where("from_block % 200 = 0").distinct().withColumn("recorded_at", F.lit("2020-01-01").cast("timestamp"))
    rerun = s.covered.withColumn("recorded_at", F.lit("2021-01-01").cast("timestamp"))
    appended = earlier.unionByName(coverage.new_coverage(earlier, rerun))
    return appended.withColumn("recorded_on", F.date_format("recorded_at", "yyyy-MM-dd")).drop("recorded_at")


@query(_sql(_FAILURE_SQL, " SELECT * FROM tainted"))
def scope_taint(s: Sample) -> DataFrame:
    return outcomes.taint(_failures(s), _scopes(s), s.present)


@query(_sql(_FAILURE_SQL, " SELECT * FROM firsts"))
def first_failure(s: Sample) -> DataFrame:
    return outcomes.first_failure(_failures(s), _scopes(s), s.present)


_OUTCOME_SQL = """, in_range AS (SELECT block_number, count(*) AS n FROM pairs GROUP BY 1),
    hit AS (SELECT block_number, count(*) AS n FROM hits GROUP BY 1)
    SELECT h.block_number, CASE WHEN r.n IS NULL THEN 'OutsideRange' WHEN t.n IS NULL THEN 'NoBloomMatch' WHEN h.block_number % 397 = 0 THEN 'VerifyFailed'
      WHEN h.block_number % 389 = 0 THEN 'DecodeFailed' ELSE 'Evaluated' END AS outcome
    FROM headers h LEFT JOIN in_range r ON r.block_number = h.block_number LEFT JOIN hit t ON t.block_number = h.block_number"""


@query(scope_queries._bits(scope_queries._HITS_SQL + _OUTCOME_SQL, "headers", "scopes"))
def block_outcome(s: Sample) -> DataFrame:
    pairs = scope_blocks(s.headers, s.view("scopes").select("scope_id", "from_block", "to_block"))
    counted = pairs.groupBy("block_number").agg(F.count(F.lit(1)).alias("in_range"))
    hits = scope_queries.bloom_hits(s).groupBy("block_number").agg(F.count(F.lit(1)).alias("hits"))
    joined = s.headers.join(counted, "block_number", "left").join(hits, "block_number", "left")
    outcome = outcomes.block_outcome(
        F.col("in_range"), F.col("hits"), F.col("block_number") % 397 != 0, F.col("block_number") % 389 == 0
    )
    return joined.select("block_number", outcome.alias("outcome"))


def _decided(s: Sample, source: str = "false", store: str = "false", write: str = "false") -> DataFrame:
    gaps = coverage.first_gap(coverage.missing_ranges(_scopes(s), _present(s), _KEYS), _KEYS)
    flags = s.present.select(F.expr(source).alias("source_failed"), F.expr(store).alias("store_failed"))
    run_reason = outcomes.run_failure(flags).scalar()
    return outcomes.coverage_decision(_scopes(s), outcomes.first_failure(_failures(s), _scopes(s), s.present), gaps, run_reason, F.expr(write))


@query(_sql(_PRESENT_SQL, _FAILURE_SQL, _decision_sql(_SOURCE, _STORE), " SELECT * FROM decided"))
def coverage_decision_source_failed(s: Sample) -> DataFrame:
    """A run whose source and store both failed: the source outranks."""
    return _decided(s, _SOURCE, _STORE)


@query(_sql(_PRESENT_SQL, _FAILURE_SQL, _decision_sql(store=_STORE, write=_WRITE), " SELECT * FROM decided"))
def coverage_decision_store_failed(s: Sample) -> DataFrame:
    return _decided(s, store=_STORE, write=_WRITE)


@query(_sql(_PRESENT_SQL, _FAILURE_SQL, _decision_sql(write=_WRITE), " SELECT * FROM decided"))
def coverage_decision_write_failed(s: Sample) -> DataFrame:
    return _decided(s, write=_WRITE)


@query(_sql(_PRESENT_SQL, _FAILURE_SQL, _DECISION_SQL, " SELECT * FROM decided"))
def coverage_decision(s: Sample) -> DataFrame:
    return _decided(s)


_REPORT_SQL = """ , report AS (SELECT scope_id, contract AS label, reason, gap_from, gap_to FROM decided WHERE scope_id % 17 <> 5
      UNION ALL SELECT scope_id, coalesce(name, address), 'PreparationFailed', NULL, NULL FROM scopes WHERE scope_id % 17 = 5)
    SELECT scope_id, label, reason, gap_from, gap_to, reason IS NULL AS covered, CASE reason WHEN 'PreparationFailed' THEN 'ABI resolution failure'
      WHEN 'VerifyFailure' THEN 'receipt verification failure' WHEN 'DecodeFailure' THEN 'event decode failure'
      WHEN 'NoSourceData' THEN 'no backing source data for blocks ' || gap_from || '-' || gap_to END AS reason_text FROM report"""


@query(_sql(_PRESENT_SQL, _FAILURE_SQL, _DECISION_SQL, _REPORT_SQL))
def sync_report(s: Sample) -> DataFrame:
    unprepared = _scopes(s).where("scope_id % 17 = 5")
    return outcomes.sync_report(_decided(s).where("scope_id % 17 <> 5"), unprepared)


@query(
    _sql(
        _PRESENT_SQL, _FAILURE_SQL, _DECISION_SQL,
        " SELECT CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS covered, CAST(count(*) FILTER (reason IS NOT NULL) AS BIGINT) AS incomplete, "
        "count(*) FILTER (reason IS NOT NULL) = 0 AS complete FROM decided",
    )
)
def report_summary(s: Sample) -> DataFrame:
    report = outcomes.sync_report(_decided(s), _scopes(s).where("false"))
    return outcomes.report_summary(report)
