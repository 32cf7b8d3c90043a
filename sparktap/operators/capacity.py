"""A bounded table of connections, as it evicts the one that is least recently used.

A packet of a connection that isn't held takes a place, and where all places are taken the connection with the oldest last
packet goes first. A closing packet gives its connection's place back, after it has taken one if need be.

A connection is evicted as soon as `capacity` others have had packets since its last one and aren't closed. That depends on
what came after that packet alone, so blocks of consecutive rows are replayed side by side, each from the most recent open
connections at its start: at most `capacity`, as any others were evicted before. These come by doubling: the open ones of
2**k blocks and of the 2**k blocks before, cut to the most recent. A connection that is carried although it went inside an
earlier block changes no other's fate, and its own is its first eviction.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktap.session import materialise, release, ship

CAPACITY = 65_536
#: Rows of a block for each place of the table: a block's start costs at most a row for each place.
BLOCK = 8
#: Bits of a row's number within its partition, as monotonically_increasing_id has them.
INDEX = 1 << 33


def _blocks(packets: DataFrame, block_rows: int) -> DataFrame:
    """The packets in the order of time and id, as a table: pos tells the order, block counts runs of block_rows or fewer."""
    closes = (F.coalesce("direction", F.lit(0)) == 3).alias("closes")
    rows = packets.where("conn_id IS NOT NULL AND timestamp_ns IS NOT NULL").select("conn_id", "timestamp_ns", "event_id", closes)
    order = ("timestamp_ns", "event_id", "conn_id", "closes")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    run = F.expr(f"pos - pos % {INDEX}L + (pos % {INDEX}L) div {block_rows}L")
    table = materialise(placed.withColumn("run", run), "places")
    # One row for each block, whatever its connections.
    numbers = table.select("run").distinct().withColumn("block", F.row_number().over(W.orderBy("run")).cast("long") - 1)
    out = materialise(table.join(numbers, "run").drop("run"), "blocks")
    release(table)
    return out


def _open_at_ends(blocks: DataFrame, capacity: int) -> DataFrame:
    """Rows (block, conn_id, pos, timestamp_ns, event_id): of the connections that are open at the end of each block the most
    recent ones. A busy connection counts once a block from the first step on."""
    last = blocks.groupBy("block", "conn_id").agg(F.max(F.struct("pos", "timestamp_ns", "event_id", "closes")).alias("x"))
    until = F.lead("block").over(W.partitionBy("conn_id").orderBy("block"))
    known = last.select("block", "conn_id", "x.*", until.alias("until")).where("NOT closes").drop("closes")
    recent = F.row_number().over(W.partitionBy("block").orderBy(F.desc("pos")))
    cut = lambda d: d.withColumn("place", recent).where(F.col("place") <= capacity).drop("place")
    top = blocks.agg(F.max("block")).first()[0]
    found, span = cut(known), 1
    while top is not None and span <= top:
        later = F.col("block") + span
        stays = (later <= top) & (F.col("until").isNull() | (F.col("until") > later))
        found = cut(found.withColumn("block", F.explode(F.array_compact(F.array("block", F.when(stays, later))))))
        span *= 2
    return found.drop("until")


def _evictions(blocks: DataFrame, ends: DataFrame, capacity: int) -> DataFrame:
    ship(blocks.sparkSession)
    fields = ["conn_id", "pos", "last_ns", "last_event_id", "at_pos", "at_ns", "at_event_id"]

    def replay(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        held: OrderedDict[int, int] = OrderedDict()  # the last row of each, the least recent first
        gone, by = [], []
        for i, (conn, closes, before) in enumerate(zip(*(batch[c].to_pylist() for c in ("conn_id", "closes", "before")))):
            if held.pop(conn, None) is None and not before and len(held) >= capacity:
                gone.append(held.popitem(last=False)[1])
                by.append(i)
            if not closes:
                held[conn] = i
        old, new = batch.take(pa.array(gone, pa.int64())), batch.take(pa.array(by, pa.int64()))
        taken = [*(old[c] for c in ("conn_id", "pos", "timestamp_ns", "event_id")), *(new[c] for c in ("pos", "timestamp_ns", "event_id"))]
        return pa.table(taken, names=fields)

    start = ends.select(F.col("block") + 1, "conn_id", "timestamp_ns", "event_id", F.lit(False), "pos", F.lit(True)).toDF("block", "conn_id", "timestamp_ns", "event_id", "closes", "pos", "before")
    # The start of a block after the last one is of no use.
    asked = blocks.select("block", "conn_id", "timestamp_ns", "event_id", "closes", "pos", F.lit(False).alias("before"))
    start = start.join(blocks.select("block").distinct(), "block", "left_semi")
    kind = {c: t for c, t in blocks.dtypes}
    types = [kind[c] for c in ("conn_id", "pos", "timestamp_ns", "event_id", "pos", "timestamp_ns", "event_id")]
    seen = asked.unionByName(start).groupBy("block").applyInArrow(replay, ", ".join(map(" ".join, zip(fields, types))))
    first = F.min(F.struct("at_pos", "at_ns", "at_event_id")).alias("x")
    return seen.groupBy("pos", "conn_id", "last_ns", "last_event_id").agg(first).select("conn_id", "pos", "last_ns", "last_event_id", "x.at_ns", "x.at_event_id")


def bounded(packets: DataFrame, capacity: int = CAPACITY, block_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a table of so many connections evicts from the packets (conn_id, timestamp_ns, event_id, direction), and holds:

    evicted: a row each time, (conn_id, last_ns, last_event_id, at_ns, at_event_id): the connection's last packet and the one
    that took its place. held: (conn_id, last_ns, last_event_id, lru_no) in the end, 1 for the one that would go first.
    stats: one row, active, created, closed, evicted.

    Rows without a connection or a time don't count; a null direction closes nothing, a null id comes first of its time.
    Repeated rows are packets each. Of packets of the same time the lesser id comes first.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    blocks = _blocks(packets, block_rows or BLOCK * capacity)
    ends = materialise(_open_at_ends(blocks, capacity), "open")
    gone = materialise(_evictions(blocks, ends, capacity), "evicted")
    top = blocks.agg(F.max("block").alias("block"))
    rest = ends.join(F.broadcast(top), "block").join(gone.select("pos"), "pos", "left_anti")
    # At most `capacity` rows.
    held = rest.select("conn_id", F.col("timestamp_ns").alias("last_ns"), F.col("event_id").alias("last_event_id"), F.row_number().over(W.orderBy("pos")).cast("long").alias("lru_no"))
    n = F.count(F.lit(1))
    counts = blocks.agg(F.count_if("closes").alias("n"), F.lit("closed").alias("k")).union(gone.agg(n, F.lit("evicted"))).union(held.agg(n, F.lit("active")))
    value = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")))
    stats = counts.agg(value("active").alias("active"), F.sum("n").alias("created"), value("closed").alias("closed"), value("evicted").alias("evicted"))
    return gone.drop("pos"), held, stats
