"""Server-sent events put together from decrypted reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktap.session import ship

MAX_BYTES = 256 * 1024
IDLE_NS = 2_000_000_000


def eligible(direction: str = "direction", data: str = "data") -> Column:
    d = F.col(data)
    return (F.col(direction) == "read") & ~d.startswith("HTTP/") & ~d.startswith("{") & (d.contains("data: ") | d.contains("event: "))


def is_last(data: str = "data") -> Column:
    return F.col(data).contains("data: [DONE]") | F.col(data).contains('"finish_reason"')


def reassemble(events: DataFrame, idle_ns: int | None = None) -> DataFrame:
    """Eligible reads of each pid, cut after a last chunk, after the read with which a part holds MAX_BYTES or more, and
    before a gap over the idle limit where one is given.

    Rows: pid, part, n_chunks, data, complete. Streams are cut by sequence, so a pid's parts are built in its order.
    A part without a last chunk is not complete, whatever its size.
    """
    w = W.partitionBy("pid").orderBy("timestamp_ns", "seq")
    reads = events.where(eligible()).withColumn("last", is_last())
    gap = F.lit(False) if idle_ns is None else F.coalesce(F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) > idle_ns, F.lit(False))
    ship(events.sparkSession)
    reads = reads.select("pid", "timestamp_ns", "seq", "data", "last", gap.alias("gap"), F.octet_length("data").cast("long").alias("bytes"))
    schema = reads.schema.add("part", "long")
    parts = reads.repartition("pid").sortWithinPartitions("pid", "timestamp_ns", "seq").mapInArrow(_number, schema)
    parts = parts.groupBy("pid", "part").agg(F.array_sort(F.collect_list(F.struct("timestamp_ns", "seq", "data"))).alias("chunks"), F.max("last").alias("complete"))
    return parts.select("pid", "part", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c["data"]), "").alias("data"), "complete")


def cut(part: int, held: int, ended: bool, gap: bool, n_bytes: int, last: bool) -> tuple[int, int, bool]:
    """The part that a read belongs to, the bytes that it then holds, and whether the read ends it. Both a last chunk and
    a gap count, as two cuts with nothing between them."""
    cuts = int(ended) + int(gap)
    held = n_bytes if cuts else held + n_bytes
    return part + cuts, held, last or held >= MAX_BYTES


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part's number to each pid's reads in order; whether the byte count cuts depends on the cuts before."""
    now, part, held, ended = None, 0, 0, False
    first = True
    for batch in batches:
        parts = []
        for pid, last, gap, n in zip(*(batch.column(c).to_pylist() for c in ("pid", "last", "gap", "bytes"))):
            if first or pid != now:
                now, part, held, ended, first = pid, 0, 0, False, False
            part, held, ended = cut(part, held, ended, gap, n, bool(last))
            parts.append(part)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, "part"])
