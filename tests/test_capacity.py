import random

import pytest
from pyspark.sql import functions as F

from sparktap.operators import capacity

KIND = "conn_id long, timestamp_ns long, event_id long, direction int, pos string"


def replayed(rows, places):
    """One row after the other, with a list."""
    held, last, gone, created, closed = [], {}, [], 0, 0
    for conn, t, e, way in sorted((r[:4] for r in rows if None not in r[:2]), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[0], r[3] == 3)):
        if conn in held:
            held.remove(conn)
        else:
            created += 1
            if len(held) >= places:
                gone.append((held[0], *last[held.pop(0)], t, e))
        if way == 3:
            closed += 1
        else:
            held.append(conn)
            last[conn] = (t, e)
    return gone, [(c, *last[c], i + 1) for i, c in enumerate(held)], (len(held), created, closed, len(gone))


def same(spark, rows, places, block_rows):
    got = capacity.bounded(spark.createDataFrame(rows, KIND), places, block_rows)
    want = replayed(rows, places)
    for one, other in zip(got[:2], want):
        assert sorted(map(repr, map(tuple, one.collect()))) == sorted(map(repr, other))
    assert [tuple(r) for r in got[2].collect()] == [want[2]]
    return want


@pytest.mark.parametrize("seed,places,block_rows,conns,closing", [(1, 4, 5, 12, 0.3), (2, 7, 3, 10, 0.5), (3, 1, 1, 3, 0.2), (4, 40, 8, 30, 0.1), (5, 6, 16, 60, 0.0), (6, 5, 2, 9, 0.4)])
def test_blocks_side_by_side_equal_a_plain_loop(spark, seed, places, block_rows, conns, closing):
    rng = random.Random(seed)
    # One connection has a third of all rows.
    rows = [(1 if rng.random() < 0.33 else rng.randrange(conns), rng.randrange(150), i, 3 if rng.random() < closing else rng.choice([1, 2, None]), "x") for i in range(300)]
    assert len(same(spark, rows, places, block_rows)[0]) > 0 or places > conns


def test_idle_connections_live_through_many_blocks_and_waves_of_short_ones(spark):
    """The table fills up and is closed again inside blocks, so what was evicted there is within the most recent at their ends."""
    rows, t = [(c, c, c, 1, "x") for c in range(6)], 100
    for wave in range(9):
        some = range(100 * wave + 10, 100 * wave + 10 + wave)
        for way in (1, 3):
            for c in some:
                rows.append((c, t, t, way, "x"))
                t += 1
    for block_rows in (2, 7, 64, 1000):
        assert len(same(spark, rows, 8, block_rows)[0]) >= 6


def test_odd_rows(spark):
    rows = [(1, 5, 1, 1, "x"), (1, 5, 1, 1, "x"), (None, 5, 2, 1, "x"), (2, None, 3, 1, "x"), (3, 5, None, 1, "x"), (4, 6, (1 << 60) + 1, 3, "x"), (5, 7, (1 << 60) + 3, 1, None), (6, 7, None, None, "x"), (1, 8, 9, 3, "x"), (1, 8, 9, 3, "x")]
    for places in (1, 2, 3):
        same(spark, rows, places, 2)
    empty = spark.createDataFrame([], KIND)
    got = capacity.bounded(empty, 3)
    assert got[0].count() == got[1].count() == 0 and tuple(got[2].first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        capacity.bounded(empty, 0)


def test_a_busy_connection_is_no_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 500 + 2).alias("conn_id"), F.col("id").alias("timestamp_ns"), F.col("id").alias("event_id"), F.lit(1).alias("direction"))
    gone, held, stats = capacity.bounded(rows, 50)
    assert gone.where("conn_id = 1").count() == 0 and held.count() == 50
    # A connection out of every third row comes back after all 500 others: each of its rows but the first 49 evicts one.
    assert tuple(stats.first()) == (50, gone.count() + 50, 0, 20_000 // 3 + 1 - 49)
