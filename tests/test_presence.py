"""Presence bitmaps: islands, merges and counts against plain sets."""

from __future__ import annotations

import random

import pytest

from chainevents.operators import presence
from chainevents.operators.signatures import SLICE

_SCHEMA = "k string, block_number long"


def plain_islands(blocks: set[int]) -> list[tuple[int, int]]:
    begins = sorted(b for b in blocks if b - 1 not in blocks)
    ends = sorted(b for b in blocks if b + 1 not in blocks)
    return list(zip(begins, ends, strict=True))


def found(frame, key="a") -> list[tuple[int, int]]:
    return sorted((r.from_block, r.to_block) for r in frame.collect() if r.k == key)


CHANCE = random.Random(5)
SETS = {
    "single": {0},
    "edges of bytes": {7, 8, 15, 17, 23, 24, 25},
    "edges of slices": {SLICE - 1, SLICE, 2 * SLICE - 1, 2 * SLICE + 1, 5 * SLICE},
    "whole slices": set(range(SLICE - 3, 3 * SLICE + 2)),
    "scattered": {CHANCE.randrange(3 * SLICE) for _ in range(4000)},
    "beyond 32 bits": {(1 << 40) + k for k in (0, 1, 2, 9)},
}


@pytest.mark.parametrize("blocks", SETS.values(), ids=list(SETS))
def test_islands(spark, blocks):
    rows = [("a", b) for b in blocks] + [("a", min(blocks)), ("b", 3), ("a", None)]
    frame = spark.createDataFrame(rows, _SCHEMA)
    present = presence.presence(frame, ["k"])
    assert found(presence.islands(present, ["k"])) == plain_islands(blocks)
    assert {r.k: r.n_blocks for r in presence.present_counts(present, ["k"]).collect()} == {"a": len(blocks), "b": 1}


def test_runs_merge(spark):
    first, second = set(range(100, SLICE)) - {700}, set(range(600, SLICE + 50)) | {2 * SLICE}
    one, two = (presence.presence(spark.createDataFrame([("a", b) for b in s], _SCHEMA), ["k"]) for s in (first, second))
    merged = presence.merged_presence(one, two, ["k"])
    assert found(presence.islands(merged, ["k"])) == plain_islands(first | second)
    again = presence.merged_presence(merged, two, ["k"])
    rows = lambda frame: sorted((r.k, r.slice, bytes(r.blocks)) for r in frame.collect())
    assert rows(again) == rows(merged)


def test_nothing_is_there(spark):
    none = spark.createDataFrame([], _SCHEMA)
    assert presence.islands(presence.presence(none, ["k"]), ["k"]).collect() == []
    assert presence.present_counts(presence.presence(none, ["k"]), ["k"]).collect() == []
