"""Compare registered queries with their DuckDB SQL: python tests/check_oracles.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(con, spark, sf_dir, function, sql):
    """None when equal, else a short account of the difference."""
    frame = function(spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got == want:
        return None
    left, right = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows vs {len(want)}; only spark {list(left - right)[:2]}; only duckdb {list(right - left)[:2]}"


if __name__ == "__main__":
    from chainevents.plans.catalog import REGISTRY
    from chainevents.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(REGISTRY)
    session = local_session()
    connection = duck(sf)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            fault = compare(connection, session, sf, *REGISTRY[name])
        except Exception as error:  # report and go on with the next query
            fault = f"{type(error).__name__}: {str(error)[:600]}"
        bad += fault is not None
        print(f"{'ok ' if fault is None else 'BAD'} {time.time() - start:6.2f}s {name} {fault or ''}", flush=True)
    print("failed:", bad)
