"""Pages read the blocks that they lie in, also behind the first row of every key."""

import pytest
from test_query import event, events_of

from chainevents.plans import query as Q
from chainevents.plans.catalog.sample import Sample
from chainevents.schemas import BUCKET

BLOCKS = [-2 * BUCKET, -BUCKET, -5, 0, 7, BUCKET - 1, BUCKET, 3 * BUCKET, 3 * BUCKET + 1, 9 * BUCKET]


@pytest.mark.parametrize("limit, offset", [(1, 0), (3, 1), (2, 4), (0, 3), (0, 9), (5, 8), (4, 30)])
def test_a_page_is_a_slice_of_the_order(spark, limit, offset):
    rows = [event(b, log) for b in BLOCKS for log in (0, 1)]
    got = [(r.block_number, r.log_index) for r in Q.page(events_of(spark, *rows), limit, offset).collect()]
    whole = [(b, log) for b in BLOCKS for log in (0, 1)]
    assert got == whole[offset : offset + limit if limit else None]


def test_rows_outside_the_page_are_not_read_again(spark):
    stored = Sample(spark, "/root/testdata/sf0.01").stored
    plan = Q.page(stored, 10, 40_000)._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "GreaterThanOrEqual(l_orderkey," in scan and "LessThanOrEqual(l_orderkey," in scan
