"""What decoding logs costs: narrow rows are moved, JSON is parsed once, an address is hashed once per worker."""

import re

from pyspark.sql import functions as F

from chainevents.functions import abi
from chainevents.functions.expressions import json_string
from chainevents.functions.keccak import checksum_addresses, keccak256_many
from chainevents.operators.decode import indexed_value
from chainevents.plans.catalog.archives import log_decode
from chainevents.plans.catalog.sample import Sample


def test_line_items_are_moved_before_they_are_encoded_and_json_is_parsed_once(spark):
    plan = log_decode(Sample(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == 1
    below = plan[plan.index("RepartitionByExpression") :]
    moved = below[: below.index("Relation")]
    assert "unhex" not in moved and "rpad" not in moved


def test_checksummed_addresses():
    known = ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB", "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb"]
    assert checksum_addresses([bytes.fromhex(t[2:]) for t in known]) == known
    assert checksum_addresses([]) == []
    many = keccak256_many([bytes([k, k >> 3]) for k in range(200)])
    for raw, text in zip((d[:20] for d in many), checksum_addresses([d[:20] for d in many])):
        digits = keccak256_many([raw.hex().encode()])[0].hex()
        assert text == "0x" + "".join(c.upper() if int(n, 16) > 7 else c for c, n in zip(raw.hex(), digits))


def test_addresses_are_hashed_once_and_few_are_kept(monkeypatch):
    asked = []
    monkeypatch.setattr(abi, "checksum_addresses", lambda raw: asked.extend(raw) or checksum_addresses(raw))
    monkeypatch.setattr(abi, "_NAMES", {})
    monkeypatch.setattr(abi, "_KEPT_NAMES", 3)
    one, two, three, four = (bytes([k]) * 20 for k in range(1, 5))
    for found in ({one, two}, {two, three}, {four, one}, {one, two, three, four}):
        assert abi._named(found) == dict(zip(found, checksum_addresses(list(found))))
    assert asked.count(two) == 2 and len(asked) == 3 + 2 + 4


def test_numbers_and_names(spark):
    words = ["0" * 64, "0" * 63 + "a", "0" * 48 + "f" * 16, "0" * 47 + "1" + "0" * 16, "f" * 64]
    rows = spark.createDataFrame([(w,) for w in words], "topic string").coalesce(1).select("topic", indexed_value(F.lit("uint256"), F.col("topic")).alias("got"))
    assert {r.topic: r.got for r in rows.collect()} == {w: f'"0x{int(w, 16):x}"' for w in words}
    names = ["part", "", 'a"b', "a\\b", "é", "a b", "a\n", "$_9"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", json_string("name").alias("got"), F.expr("to_json(struct(name AS s))").alias("whole"))
    assert all(r.got == re.fullmatch(r'\{"s":(.*)\}', r.whole, re.S)[1] for r in rows.collect())
