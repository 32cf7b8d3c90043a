"""Connection lifecycle: incarnations, per-connection totals, protocol promotion, age limits and top lists.

Everything is partitioned by connection: one shuffle on conn_id serves the incarnation number and the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktap import schema

ORDER = ("timestamp_ns", "event_id")
TOP_KEYS = ("bytes_total", "bytes_sent", "bytes_recv", "packets_total", "duration_ms")


def incarnations(packets: DataFrame) -> DataFrame:
    """Numbers the lives of a connection: those closed before each packet."""
    before = W.partitionBy("conn_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    return packets.withColumn("incarnation", F.coalesce(F.sum((F.col("direction") == 3).cast("long")).over(before), F.lit(0)).cast("long"))


def promote(codes: Column) -> Column:
    """The protocol after a list of observed codes, in order: each may promote the one before it, or is ignored."""
    table = F.array(*[F.array(*[F.lit(t) for t in schema.PROMOTIONS.get(k, ())]).cast("array<int>") for k in schema.PROTOCOLS])
    step = lambda now, seen: F.when(F.array_contains(F.element_at(table, now + 1), seen), seen).otherwise(now)
    return F.aggregate(F.slice(codes, 2, F.size(codes)), F.element_at(codes, 1), step)


def totals(numbered: DataFrame, protocol: str | None = "protocol") -> DataFrame:
    """One record for each life of a connection.

    Of each code only the first place counts in a promotion: the first known code stands until the first one that may
    follow it, and what follows stays. So packets are first summed up by life and code, at most nine rows a life, which lie
    where the packets of their connection do.
    """
    way = lambda d: F.col("direction") == d
    aggs = {
        "first_ns": F.min("timestamp_ns"), "last_ns": F.max("timestamp_ns"), "closed_ns": F.max(F.when(way(3), F.col("timestamp_ns"))),
        "packets_sent": F.count_if(way(1)), "packets_recv": F.count_if(way(2)), "bytes_sent": F.sum(F.when(way(1), F.col("original_len")).otherwise(0)), "bytes_recv": F.sum(F.when(way(2), F.col("original_len")).otherwise(0)),
    }
    first = F.struct(*ORDER)
    if not protocol:
        return with_derived(numbered.groupBy("conn_id", "incarnation").agg(*[c.alias(k) for k, c in aggs.items()], F.min_by("pid", first).alias("pid")))
    each = numbered.groupBy("conn_id", "incarnation", F.col(protocol).alias("p")).agg(*[c.alias(k) for k, c in aggs.items()], F.min_by("pid", first).alias("pid"), F.min(first).alias("at"))
    again = {"first_ns": F.min, "last_ns": F.max, "closed_ns": F.max}
    seen = F.array_sort(F.collect_list(F.struct("at", "p")))
    out = each.groupBy("conn_id", "incarnation").agg(*[again.get(k, F.sum)(k).alias(k) for k in aggs], F.min_by("pid", "at").alias("pid"), seen.alias("seen"))
    return with_derived(out.withColumn("protocol", promote(F.transform("seen", lambda x: x["p"]))).drop("seen"))


def with_derived(records: DataFrame) -> DataFrame:
    """A closing time of 0 counts as none, as everywhere in this format."""
    end = F.when(F.coalesce("closed_ns", F.lit(0)) == 0, F.col("last_ns")).otherwise(F.col("closed_ns"))
    return records.withColumns({"packets_total": F.col("packets_sent") + F.col("packets_recv"), "bytes_total": F.col("bytes_sent") + F.col("bytes_recv"), "duration_ms": F.round((end - F.col("first_ns")) / 1e6, 3), "is_open": F.col("closed_ns").isNull()})


def top_connections(records: DataFrame, n: int = 10, by: str = "bytes_total") -> DataFrame:
    """The first n by a key, descending; ties by connection. Runs as one top-n operator, not as a sort of all."""
    if by not in TOP_KEYS:
        raise ValueError(f"by must be one of {TOP_KEYS}")
    return records.orderBy(F.desc(by), "conn_id", "incarnation").limit(n)


def expired(records: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """Open records whose last packet is older than the limit, strictly."""
    return records.where(F.col("is_open") & (F.col("last_ns") < now_ns - ttl_ns))


def first_protocol(packets: DataFrame) -> DataFrame:
    """The first known protocol of a connection stands for all later packets."""
    upto = W.partitionBy("conn_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    known = F.first(F.when(F.col("protocol") != 0, F.col("protocol")), ignorenulls=True).over(upto)
    return packets.withColumn("sticky_protocol", F.coalesce(known, F.col("protocol")))


def numbered(packets: DataFrame) -> DataFrame:
    return packets.withColumn("packet_no", F.row_number().over(W.partitionBy("conn_id").orderBy(*ORDER)))


def stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if("is_open").alias("active"), F.count(F.lit(1)).alias("created"), F.count_if(~F.col("is_open")).alias("closed"))


TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "pid")


def by_tuple(packets: DataFrame) -> DataFrame:
    """Packets with the key of their connection (a struct), whether they are the first of it, which creates it, and the
    least connection id under that key. One shuffle serves all."""
    w = W.partitionBy(*TUPLE)
    return packets.withColumns({"tuple": F.struct(*TUPLE), "created": F.row_number().over(w.orderBy(*ORDER)) == 1, "found_conn": F.min("conn_id").over(w)})
