"""Static words of event data in column expressions, against the plain decoder."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chainevents.functions.abi import OVERRUN, _sequence, compile_layout, parse_type
from chainevents.functions.words import decimal_text
from chainevents.operators import decode
from chainevents.sources import registry

w = lambda n: (n % (1 << 256)).to_bytes(32, "big")


def events_of(spark, *layouts):
    """One registry row per list of (name, type)."""
    abi = json.dumps([{"type": "event", "name": f"E{k}", "inputs": [{"name": n, "type": t, "indexed": False} for n, t in fields]} for k, fields in enumerate(layouts)])
    return registry.with_signatures(registry.abi_events(spark.createDataFrame([(abi,)], "abi_json string")))


def decoded(spark, known, rows, arrow=True):
    """``rows`` are (event number, data)."""
    logs = spark.createDataFrame([(k, f"E{e}", bytearray(d)) for k, (e, d) in enumerate(rows)], "k int, event_name string, data binary")
    found = decode.decode_logs(logs.join(known, "event_name").withColumn("topics", F.expr("array() :: array<binary>")), arrow)
    return found, [(json.loads(r.decoded), r.decode_failed) for r in found.orderBy("k").collect()]


def test_decimal_text(spark):
    chance = random.Random(8)
    numbers = [0, 1, 9, 10**9 - 1, 10**9, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 1 << 64, 10**18, 10**27, 10**77, (1 << 255) - 1, 1 << 255, (1 << 256) - 1]
    numbers += [(1 << 256) - k for k in (1, 2, 1 << 63, (1 << 63) + 1, 1 << 64, 10**30)] + [chance.getrandbits(chance.randrange(1, 257)) for _ in range(60)]
    words = spark.createDataFrame([(k, w(n).hex()) for k, n in enumerate(numbers)], "k int, word string")
    rows = words.select("k", decimal_text(F.col("word"), F.lit(False)).alias("plain"), decimal_text(F.col("word"), F.lit(True)).alias("signed")).orderBy("k").collect()
    assert [r.plain for r in rows] == list(map(str, numbers))
    assert [r.signed for r in rows] == [str(n - (1 << 256) if n >> 255 else n) for n in numbers]


STATIC = [
    [("a", "uint256"), ("b", "int256"), ("c", "bool"), ("d", "bytes4"), ("e", "bytes32")],
    [("a", "uint8[3]"), ("b", "(bool,int16[2],bytes1)"), ("c\"é", "function"), ("d", "uint256[0]")],
    [("a", "uint256"), ("a", "bool"), ("b", "(uint8,(uint8,bool)[2])[2]")],
    [],
]
MIXED = [
    [("a", "uint256"), ("who", "address"), ("s", "string"), ("n", "uint8[]"), ("z", "int8")],
    [("a", "address[2]"), ("b", "(string,uint8)"), ("a", "bytes"), ("c", "uint8[100]")],
]


def plain_members(fields, data):
    """The plain decoder's JSON object, or None where it fails."""
    if not data or not fields:
        return {}
    try:
        values = _sequence([parse_type(t) for _, t in fields], data, 0)
    except (ValueError, OverflowError):
        return None

    def named(v):
        return "0x" + v.hex() if isinstance(v, bytes) else [named(x) for x in v] if isinstance(v, list) else v

    return {n: named(v) for (n, _), v in zip(fields, values)}


def lowered(value):
    """Addresses compare without the case of their digits."""
    if isinstance(value, list):
        return [lowered(v) for v in value]
    return value.lower() if isinstance(value, str) and len(value) == 42 and value.startswith("0x") else value


@pytest.mark.parametrize("layouts, arrow", [(STATIC, False), (STATIC + MIXED, True)])
def test_members_equal_the_plain_decoder(spark, layouts, arrow):
    chance = random.Random(4)
    rows = []
    for e, fields in enumerate(layouts):
        size = compile_layout(fields)["size"] if fields else 0
        for k in range(25):
            words = [w(chance.choice([0, 1, 32, 64, 96, 128, 160, 192, 3600, chance.getrandbits(8), chance.getrandbits(256), -chance.getrandbits(60)])) for _ in range(size // 32 + chance.choice([0, 0, 1, 6]))]
            data = b"".join(words)
            rows.append((e, [data, data[: size - 1] if size else data, b"", data + b"hello"][k % 4 if k < 8 else 0]))
    known = events_of(spark, *layouts)
    assert decode.needs_arrow(known) == arrow
    frame, found = decoded(spark, known, rows, arrow)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert arrow == ("decode_others" in plan)
    for (e, data), (members, failed) in zip(rows, found):
        want = plain_members(layouts[e], data)
        assert failed == (want is None), (layouts[e], data.hex())
        if want is None:
            assert members["_raw_data"] == data.hex() and members["_decode_error"]
        else:
            assert {k: lowered(v) for k, v in members.items()} == want, (layouts[e], data.hex())


def test_huge_fixed_array_is_an_overrun_without_being_made(spark):
    known = events_of(spark, [("a", "uint8"), ("b", "uint8[1000000000]")], [("a", "uint8[1000000000][1000000000][1000000000]")])
    rows = [(0, w(1) * 3), (1, w(1)), (0, b"")]
    found = decoded(spark, known, rows, decode.needs_arrow(known))[1]
    assert [f for _, f in found] == [True, True, False]
    assert all(m["_decode_error"] == OVERRUN for m, f in found if f)


def test_addresses_keep_their_mixed_case(spark):
    known = events_of(spark, MIXED[0])
    raw = bytes.fromhex("a0b86991c6218b36c1d19d4a2e9eb0ce3606eb48")
    data = w(5) + bytes(12) + raw + w(160) + w(224) + w(-3) + w(2) + b"hi".ljust(32, b"\0") + w(1) + w(9)
    assert decoded(spark, known, [(0, data)])[1] == [({"a": "5", "who": "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48", "s": "hi", "n": ["9"], "z": "-3"}, False)]


def test_a_large_number_takes_one_fold(spark):
    """No fold within a fold: each of nine pieces is carried once, for either sign."""
    rows = spark.createDataFrame([(f"{n % (1 << 256):064x}", s, str(n)) for n, s in [(10**76 + 7, False), (-(1 << 255), True), ((1 << 256) - 1, False), (10**27, True), (-(10**36), True)]], "word string, signed boolean, want string")
    got = rows.withColumn("got", decimal_text(F.col("word"), F.col("signed")))
    assert [r.got for r in got.collect()] == [r.want for r in got.collect()]
    assert got._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2
