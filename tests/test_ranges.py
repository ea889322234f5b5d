"""Range joins over the tree of buckets, against plain comparison."""

import random

import pytest

from chainevents.operators.ranges import containing, covering, overlapping
from chainevents.schemas import BUCKET

OPEN = (1 << 63) - 1


def ranges_of(spark, rows):
    return spark.createDataFrame(rows, "id int, from_block bigint, to_block bigint")


def test_nodes_grow_with_the_logarithm(spark):
    asked = [(start, width) for start in (0, 5, 15, 16, 4097) for width in (1, 2, 17, 300, 2441, 10**6, 10**9)]
    found = covering(ranges_of(spark, [(k, start * BUCKET + 3, (start + width) * BUCKET - 1) for k, (start, width) in enumerate(asked)])).collect()
    for k, (start, width) in enumerate(asked):
        rows = [r for r in found if r.id == k]
        spans = sorted((r.node << r.level, (r.node + 1 << r.level) - 1) for r in rows)
        assert spans[0][0] == start and spans[-1][1] == start + width - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        assert len(rows) <= 30 * (1 + len(f"{width:b}") // 4)


def test_reversed_and_open_ranges(spark):
    assert covering(ranges_of(spark, [(1, 9, 8)])).collect() == []
    assert len(covering(ranges_of(spark, [(1, 0, OPEN - BUCKET), (2, 77, OPEN - BUCKET)])).collect()) < 800


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_and_overlapping(spark, seed):
    chance = random.Random(seed)
    place = lambda: chance.choice([0, chance.randrange(40 * BUCKET), chance.randrange(700 * BUCKET), BUCKET * chance.randrange(700), BUCKET * chance.randrange(700) - 1])
    blocks = sorted({max(0, place()) for _ in range(150)})
    ranges = [(k, *chance.choice([(a, b), (min(a, b), max(a, b)), (a, a), (a, OPEN), (0, OPEN)])) for k, (a, b) in enumerate((max(0, place()), max(0, place())) for _ in range(60))]
    frame = spark.createDataFrame([(b, f"x{b}") for b in blocks], "block_number bigint, other string")
    got = sorted((r.block_number, r.id, r.other) for r in containing(frame, ranges_of(spark, ranges)).collect())
    assert got == sorted((b, k, f"x{b}") for b in blocks for k, low, high in ranges if low <= b <= high)
    items = [(k, a, a + chance.choice([0, 1, BUCKET - 1, 50 * BUCKET, -1])) for k, a in enumerate(blocks)]
    asked = [r for r in ranges if chance.random() < 0.15]
    found = sorted(r.id for r in overlapping(ranges_of(spark, items), ranges_of(spark, asked), "id").collect())
    assert found == [k for k, a, b in items if a <= b and any(low <= high and a <= high and b >= low for _, low, high in asked)]


def test_nothing_meets_nothing(spark):
    none = ranges_of(spark, [])
    blocks = spark.createDataFrame([(5,)], "block_number bigint")
    assert containing(blocks, none).collect() == [] and containing(blocks.limit(0), ranges_of(spark, [(1, 0, OPEN)])).collect() == []
    assert overlapping(none, ranges_of(spark, [(1, 0, 9)]), "id").collect() == []
