"""Chain-shaped views over the given tables, in Spark and as DuckDB text.

Each view is a mapping from column to an SQL expression that both engines read
alike, apart from the few spellings in ``Dialect``. Spark gets it through
``selectExpr``, the checking SQL through a common table expression.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.schemas import EVENT_KEY
from chainevents.session import ship_package
from chainevents.sources.store import first_per_key, in_buckets

ARRIVAL = ["contract", "event_name", "raw_topics", "raw_data", "timestamp"]


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def hex(self, x: str) -> str:
        return f"lower(hex({x}))" if self.spark else f"lower(to_hex({x}))"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"CAST({a} // {b} AS BIGINT)"

    def seconds(self, x: str) -> str:
        days = f"datediff({x}, DATE '1970-01-01')" if self.spark else f"date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))"
        return f"CAST({days} AS BIGINT) * 86400"

    def word(self, x: str) -> str:
        return f"lpad({self.hex(x)}, 64, '0')"

    def line(self, x: str) -> str:
        """With a line break at its end."""
        return f"{x} || chr(10)"

    def address(self, key: str) -> str:
        return f"'0x' || substr({self.sha(f'{quote("c")} || CAST({key} AS STRING)')}, 1, 40)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPARK, DUCK = Dialect(True), Dialect(False)


def address(key: int) -> str:
    return "0x" + hashlib.sha256(f"c{key}".encode()).hexdigest()[:40]


def _logs(d: Dialect) -> dict[str, str]:
    tx = d.div("l_linenumber", 3)
    name = "l_returnflag || l_linestatus"
    topic0 = f"'0x' || {d.sha(name)}"
    return {
        "contract": d.address("l_suppkey"),
        "event_name": name,
        "topic0": topic0,
        "block_number": "l_orderkey",
        "block_hash": f"'0x' || {d.sha(quote('b') + ' || CAST(l_orderkey AS STRING)')}",
        "tx_hash": f"'0x' || {d.sha(quote('t') + f' || CAST(l_orderkey AS STRING) || {quote('-')} || CAST({tx} AS STRING)')}",
        "tx_index": f"CAST({tx} AS BIGINT)",
        "log_index": "CAST(l_linenumber AS BIGINT)",
        "raw_topics": f"""'["' || {topic0} || '","0x' || {d.word('l_partkey')} || '"]'""",
        "raw_data": d.word("CAST(l_quantity AS BIGINT)"),
        "decoded": """'{"part":"' || CAST(l_partkey AS STRING) || '","quantity":"' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '"}'""",
        "source": "'era1'",
        "timestamp": d.seconds("l_shipdate"),
    }


# Ways in which a stored row can be damaged; every 60th row or so gets each of them.
_DAMAGE = "(block_number * 7 + log_index) % 61"


def _damaged(d: Dialect) -> dict[str, str]:
    zeros = "0" * 64
    five = "[" + ",".join([f'"0x{zeros}"'] * 5) + "]"
    change = {
        "contract": {1: "'bad'", 20: d.line("contract")},
        "tx_hash": {2: "'0x12'", 21: d.line("tx_hash")},
        "block_hash": {11: "'zz' || substr(block_hash, 3)", 22: d.line("block_hash")},
        "log_index": {12: "CAST(-1 AS BIGINT)"},
        "raw_topics": {
            3: "'not json'",
            4: """'["0xzz"]'""",
            5: quote(five),
            14: "'[1]'",
            15: "'{}'",
            16: "'[]'",
            18: quote(f'["0x{zeros}",null]'),
        },
        "raw_data": {6: "'abc'", 7: "'zz'", 10: "'f'", 17: "'0x12ab'", 19: d.line("'ab1'")},
        "decoded": {8: "'{bad'", 9: "'null'", 10: "''", 13: """'{"_decode_error":"short","_raw_data":"00"}'"""},
    }
    out = {}
    for column in _logs(d):
        cases = "".join(f" WHEN {k} THEN {v}" for k, v in change.get(column, {}).items())
        out[column] = f"CASE {_DAMAGE}{cases} ELSE {column} END" if cases else column
    return out


def _contracts(d: Dialect) -> dict[str, str]:
    flat = '{"name":"%s","type":"%s","indexed":%s}'
    broken = "CASE WHEN s_suppkey % 11 = 5 THEN 'not json' WHEN s_suppkey % 11 = 6 THEN '{}' WHEN s_suppkey % 11 = 7 THEN '[]' ELSE "
    abi = (
        '[{"type":"event","name":"AF","inputs":[' + flat % ("part", "uint256", "true") + "," + flat % ("quantity", "uint256", "false") + "]},"
        '{"type":"function","name":"f","inputs":[]},{"type":"event","inputs":[]},{"type":"event","name":"Bare"},'
        '{"type":"event","name":"E'
    )
    tail = '","inputs":[' + flat % ("a", "address", "true") + ',{"type":"uint8","indexed":false},' + flat % ("b", "bytes32", "false") + "]},"
    last = '{"type":"event","name":"AF","inputs":[' + flat % ("part", "uint64", "true") + "]}]"
    return {
        "address": d.address("s_suppkey"),
        "name": "CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_name END",
        "abi_json": f"{broken}{quote(abi)} || CAST(s_suppkey % 5 AS STRING) || {quote(tail + last)} END",
    }


def _scopes(d: Dialect) -> dict[str, str]:
    return {
        "scope_id": "s_suppkey",
        "name": "CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_name END",
        "address": d.address("s_suppkey"),
        "from_block": "s_suppkey * 100",
        "to_block": "s_suppkey * 100 + 199",
    }


def _covered(d: Dialect) -> dict[str, str]:
    return {"contract": d.address("s_suppkey"), "from_block": "s_suppkey * 100", "to_block": "s_suppkey * 100 + 199", "source": "'era1'"}


def _requests(d: Dialect) -> dict[str, str]:
    start = "(c_custkey * 37) % 12000"
    return {
        "request_id": "c_custkey",
        "contract": f"CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE {d.address('c_custkey % 120')} END",
        "event_name": "CASE WHEN c_custkey % 5 = 2 THEN 'AF' END",
        "topic0": f"CASE WHEN c_custkey % 5 = 3 THEN '0x' || {d.sha(quote('NO'))} END",
        "from_block": f"CASE WHEN c_custkey % 29 = 11 THEN {_FAR} WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 3 = 1 THEN (c_custkey % 120) * 100 + 20 ELSE {start} END",
        "to_block": (
            f"CASE WHEN c_custkey % 58 = 11 THEN {_FAR + 50} WHEN c_custkey % 58 = 40 THEN CAST(0 AS BIGINT) WHEN c_custkey % 11 = 5 THEN NULL WHEN c_custkey % 3 = 1 THEN (c_custkey % 120) * 100 + 90 "
            f"WHEN c_custkey % 23 = 8 THEN {start} - 40 ELSE {start} + (c_custkey % 13) * 50 END"
        ),
        "page_limit": "CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 10000 ELSE 5 END AS BIGINT)",
        "page_offset": "CAST(CASE WHEN c_custkey % 6 = 1 THEN 3 WHEN c_custkey % 6 = 2 THEN 100000 ELSE 0 END AS BIGINT)",
    }


_BASE = {
    "logs": ("lineitem", _logs),
    "damaged": ("logs", _damaged),
    "contracts": ("supplier", _contracts),
    "scopes": ("supplier", _scopes),
    "covered_own": ("supplier", _covered),
    "requests": ("customer", _requests),
}


def select(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def of_items() -> dict[str, Column]:
    """The columns of a log as expressions over line items."""
    return {column: F.expr(expression) for column, expression in _logs(SPARK).items()}


def in_arrival() -> list[Column]:
    return [of_items()[c] for c in ARRIVAL]


class Sample:
    """The views as DataFrames of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        source, columns = _BASE[name]
        parent = self.view(source) if source in _BASE else self.table(source)
        return parent.selectExpr(*select(columns(SPARK)))

    @property
    def logs(self) -> DataFrame:
        return self.view("logs")

    @property
    def unshaped(self) -> DataFrame:
        """Line items with the key of their log; ``shaped`` makes logs of them."""
        return self.table("lineitem").selectExpr("*", *select({c: _logs(SPARK)[c] for c in EVENT_KEY}))

    @staticmethod
    def shaped(rows: DataFrame) -> DataFrame:
        """Key columns that the rows hold are taken as they are: filters on them then pass the windows over the key."""
        dealt = [c for c in rows.columns if c == "block_bucket"]
        return rows.selectExpr(*select({c: c if c in EVENT_KEY and c in rows.columns else x for c, x in _logs(SPARK).items()}), *dealt)

    @property
    def stored(self) -> DataFrame:
        return self.shaped(first_per_key(self.unshaped, in_arrival()))

    @property
    def bucketed(self) -> DataFrame:
        """``stored`` with ``block_bucket``, dealt by it: counts per bucket need no second exchange, and look-ups move their buckets only."""
        return self.shaped(first_per_key(in_buckets(self.unshaped), in_arrival(), ("block_bucket",)))

    @property
    def headers(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS block_number", f"{SPARK.seconds('o_orderdate')} AS timestamp")

    @property
    def present(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("block_number"))

    @property
    def contracts(self) -> DataFrame:
        """Registered contracts: not every log's contract is among them."""
        return self.view("contracts").join(
            self.table("supplier").where("s_suppkey % 10 <> 7").selectExpr(f"{SPARK.address('s_suppkey')} AS address"), "address", "left_semi"
        )

    @property
    def scopes(self) -> DataFrame:
        return self.view("scopes").withColumn("events", F.array(F.lit("AF"), F.lit("NO")))

    @property
    def covered(self) -> DataFrame:
        wide = self.table("supplier").where("s_suppkey % 3 = 0").selectExpr(*select(_wide(SPARK)))
        return self.view("covered_own").unionByName(wide)


# The end of an open-ended range, and a block that no table reaches.
_OPEN, _FAR = (1 << 63) - 1, 1 << 62


def _wide(d: Dialect) -> dict[str, str]:
    return {"contract": d.address("s_suppkey"), "from_block": "CAST(0 AS BIGINT)", "to_block": f"CASE WHEN s_suppkey % 6 = 0 THEN {_OPEN} ELSE CAST(20000 AS BIGINT) END", "source": "'era1'"}


def _cte(name: str) -> str:
    source, columns = _BASE[name]
    return f"{name} AS (SELECT {', '.join(select(columns(DUCK)))} FROM {source})"


def duck(body: str, *views: str) -> str:
    """``body`` behind the common table expressions it needs."""
    ctes = {name: _cte(name) for name in _BASE}
    ctes["stored"] = (
        "stored AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY block_number, tx_index, log_index "
        f"ORDER BY {', '.join(ARRIVAL)}) AS rn FROM logs) WHERE rn = 1)"
    )
    ctes["headers"] = f"headers AS (SELECT o_orderkey AS block_number, {DUCK.seconds('o_orderdate')} AS timestamp FROM orders)"
    ctes["present"] = "present AS (SELECT DISTINCT l_orderkey AS block_number FROM lineitem)"
    ctes["registered"] = (
        f"registered AS (SELECT * FROM contracts WHERE address IN (SELECT {DUCK.address('s_suppkey')} FROM supplier WHERE s_suppkey % 10 <> 7))"
    )
    ctes["covered"] = (
        "covered AS (SELECT * FROM covered_own UNION ALL "
        f"SELECT {', '.join(select(_wide(DUCK)))} FROM supplier WHERE s_suppkey % 3 = 0)"
    )
    used = [ctes[v] for v in views]
    return f"WITH {', '.join(used)} {body}" if used else body


REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def register(function):
        REGISTRY[function.__name__] = (lambda spark, sf_dir: function(Sample(spark, sf_dir)), sql)
        return function

    return register
