"""Streaming forms of connection lives and of event-stream reassembly. Both hold the rules of their batch forms.

Rows of a key are ordered within a micro-batch, and event time with a watermark decides what is idle, so a replay of the
same batches gives the same results. State is bounded by what a key needs: counters of one life, or one open part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparktap import schema
from sparktap.operators import sse
from sparktap.session import ship

LIFE = "conn_id long, incarnation long, first_ns long, last_ns long, closed_ns long, packets_sent long, packets_recv long, bytes_sent long, bytes_recv long, pid long, protocol int"
#: The number of the life, then its record; first_ns is null while no life is open.
_OPEN = "incarnation long, first_ns long, last_ns long, packets_sent long, packets_recv long, bytes_sent long, bytes_recv long, pid long, protocol int"
PART = "pid long, part long, n_chunks long, data string, complete boolean"
_PART = "part long, held long, ended boolean, last_ns long, n long, data string"


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("ts", late)


def _wait(state: GroupState, until_ns: int) -> None:
    """Time out when the watermark has passed; a time that it has passed already is moved right behind it."""
    state.setTimeoutTimestamp(max(until_ns // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))


def connection_lives(packets: DataFrame, ttl_ns: int = 3_600_000_000_000, late: str = "1 minute") -> DataFrame:
    """One row for each life that a closing packet ends, and for each that has had no packet for longer than the limit.

    A closing packet of an unseen connection makes a life of its own. closed_ns is null where a life ran out; then the
    connection is forgotten, and its next life is numbered from 0 again.
    """
    ship(packets.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            number, first, last, *rest = state.get
            state.remove()
            if first is not None:
                yield _lives([(key[0], number, first, last, None, *rest)])
            return
        rows = pd.concat(list(frames)).sort_values(["timestamp_ns", "event_id"], kind="stable")
        number, *life = state.get if state.exists else (0, None, None, 0, 0, 0, 0, None, None)
        out, seen = [], 0
        for ts, way, size, pid, code in zip(rows.timestamp_ns, rows.direction, rows.original_len, rows.pid, rows.protocol):
            ts, code = int(ts), int(code)
            if life[0] is None:
                life = [ts, ts, 0, 0, 0, 0, int(pid), code]
            elif code in schema.PROMOTIONS.get(life[7], ()):
                life[7] = code
            life[0], life[1], seen = min(life[0], ts), max(life[1], ts), max(seen, ts)
            if way in (1, 2):
                life[1 + way] += 1
                life[3 + way] += int(size)
            if way == 3:
                out.append((key[0], number, life[0], life[1], ts, *life[2:]))
                number, life = number + 1, [None, None, 0, 0, 0, 0, None, None]
        state.update((number, *life))
        _wait(state, (life[1] if life[1] is not None else seen) + ttl_ns)
        if out:
            yield _lives(out)

    few = _timed(packets, late).select("ts", "event_id", "conn_id", "timestamp_ns", "direction", "original_len", "pid", "protocol")
    return few.groupBy("conn_id").applyInPandasWithState(run, LIFE, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def _lives(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in LIFE.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"closed_ns": "Int64"})


def reassemble(events: DataFrame, idle_ns: int = sse.IDLE_NS, forget_ns: int = 3_600_000_000_000, late: str = "10 seconds") -> DataFrame:
    """Parts as sse.reassemble with an idle limit makes them. A part goes out with its last chunk, or when it holds
    sse.MAX_BYTES, or before a read that comes later than the limit, or when the watermark passes it.

    A pid without reads for longer than forget_ns is forgotten; its parts are then numbered from 0 again.
    """
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            part, held, ended, last, n, data = state.get
            if n:
                state.update((part, held, ended, last, 0, ""))
                _wait(state, last + forget_ns)
                yield _parts([(key[0], part, n, data, False)])
            else:
                state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["timestamp_ns", "seq"], kind="stable")
        part, held, ended, last, n, data = state.get if state.exists else (0, 0, False, None, 0, "")
        chunks, out = [data] if n else [], []
        for ts, text, done in zip(rows.timestamp_ns, rows.data, rows["last"]):
            ts = int(ts)
            gap = last is not None and ts - last > idle_ns
            if gap and n:
                out.append((key[0], part, n, "".join(chunks), False))
                chunks, n = [], 0
            part, held, ended = sse.cut(part, held, ended, gap, len(text.encode()), bool(done))
            chunks.append(text)
            n, last = n + 1, ts
            if ended:
                out.append((key[0], part, n, "".join(chunks), bool(done)))
                chunks, n = [], 0
        state.update((part, held, ended, last, n, "".join(chunks)))
        _wait(state, last + (idle_ns if n else forget_ns))
        if out:
            yield _parts(out)

    reads = _timed(events, late).where(sse.eligible()).select("ts", "pid", "timestamp_ns", "seq", "data", sse.is_last().alias("last"))
    return reads.groupBy("pid").applyInPandasWithState(run, PART, _PART, "append", GroupStateTimeout.EventTimeTimeout)


def _parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pid", "part", "n_chunks", "data", "complete"])
