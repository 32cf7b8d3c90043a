"""Streaming forms: the detector by state for each connection, totals by event-time window, and idle connections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparktap.operators.detect import RESULT, START, follow
from sparktap.session import ship


def detect_stream(packets: DataFrame, idle_ms: int = 300_000) -> DataFrame:
    """The detector over a stream; a connection that is idle for so long is forgotten, in place of a bound on their number."""
    ship(packets.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else START
        found, now = follow(pd.concat(list(frames)), now)
        state.update(now)
        state.setTimeoutDuration(idle_ms)
        yield found

    few = packets.select("event_id", "conn_id", "timestamp_ns", "protocol", "direction", "payload")
    return few.groupBy("conn_id").applyInPandasWithState(run, f"event_id long, conn_id long, {RESULT}", "packets long, latched int, upgraded int, preface int, service string, method string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counters(packets: DataFrame, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counters of tumbling windows, with a watermark for late rows."""
    timed = packets.withColumn("ts", F.timestamp_micros((F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("events"), F.sum("original_len").alias("bytes"), F.count_if(F.col("direction") == 3).alias("closes"))
