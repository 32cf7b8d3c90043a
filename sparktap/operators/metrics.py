"""Counters, rates and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktap.functions.scalars import protocol_name


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    return packets.groupBy(protocol_name(F.col("protocol")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def drop_rate_pct(drops: Column, events: Column) -> Column:
    return F.coalesce(F.try_divide(drops * 100.0, drops + events), F.lit(0.0))


def counters(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("events"), F.sum("payload_len").alias("bytes_captured"), F.sum("original_len").alias("bytes_original"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("direction") == 3).alias("closes"))


def deltas(series: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Growth of a counter since the row before it, never negative."""
    w = W.partitionBy(*key).orderBy(*order)
    return series.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))


def drops(readings: DataFrame, key: list[str], order: list[str], value: str = "drops") -> DataFrame:
    """Rows (key, order, total, delta) from counters by CPU: their sum at each reading, and by how much it is above the
    highest one before; a counter that falls back counts nothing until it is above that again. Null counters count as 0."""
    each = readings.groupBy(*key, *order).agg(F.sum(F.coalesce(value, F.lit(0))).alias("total"))
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("delta", F.greatest(F.lit(0), F.col("total") - F.greatest(F.lit(0), F.max("total").over(before))))


def rates(packets: DataFrame, seconds: int = 10) -> DataFrame:
    """Events a second in tumbling windows; the ends of a window that has no events aren't shown."""
    start = F.floor(F.col("timestamp_ns") / (seconds * 1_000_000_000)).cast("long")
    return packets.groupBy((start * seconds).alias("window_start_s")).agg(F.count(F.lit(1)).alias("n")).withColumn("rate", F.col("n") / float(seconds))


def event_counters(packets: DataFrame, malformed: Column) -> DataFrame:
    """One row: totals, bytes, closes, malformed packets, the time covered, and a map of counts by protocol code. Counts
    by protocol are made first, so what is put together in the end are a few rows."""
    each = packets.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original_len").alias("b"), F.count_if(F.col("direction") == 3).alias("c"), F.count_if(malformed).alias("m"), F.min("timestamp_ns").alias("t0"), F.max("timestamp_ns").alias("t1")
    )
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("c"), F.lit(0)).alias("closes"), F.coalesce(F.sum("m"), F.lit(0)).alias("malformed"),
        F.round((F.max("t1") - F.min("t0")) / 1e9, 3).alias("uptime_s"), F.map_from_entries(F.collect_list(F.struct("protocol", "n"))).alias("by_protocol"),
    )
