"""Streams that keep state by timers: process events of registered pids, and the process table.

Both need a state store with timers, RocksDB in this version: the caller sets spark.sql.streaming.stateStore.providerClass.
Event times are those of timestamp_ns; `late` is how late a row may come. State of a pid: its registrations since the
watermark and the events that wait for it; or one record of the process table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparktap.session import ship

#: Changes of a pid's registration.
ON, OFF = ("register",), ("exit", "deregister")


def _by_pid(events: DataFrame, late: str):
    ship(events.sparkSession)
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    return events.where("pid IS NOT NULL AND timestamp_ns IS NOT NULL").withColumn("ts", at).withWatermark("ts", late).groupBy("pid")


def _passed(timestamp_ns: int, watermark_ms: int) -> bool:
    """No row of this time can come any more."""
    return timestamp_ns // 1000 <= watermark_ms * 1000


class Registered(StatefulProcessor):
    """Holds each event until the watermark has passed it, then lets it go if its pid is registered at its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", "timestamp_ns long, on int")
        self.waiting = handle.getListState("waiting", "timestamp_ns long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes, waiting = [], []
        for r in rows:
            if r.kind in ON or r.kind in OFF:
                changes.append((r.timestamp_ns, int(r.kind in ON)))
            else:
                waiting.append((r.timestamp_ns, r.event_id))
        if changes:
            self.changes.appendList(changes)
        if waiting:
            self.waiting.appendList(waiting)
            self._wake(waiting, timerValues)
        return iter(())

    def _wake(self, waiting: list, timerValues) -> None:
        self.handle.registerTimer(max(min(x[0] for x in waiting) // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        # At one time the end of a registration counts last.
        changes = sorted(((t, on) for t, on in self.changes.get()), key=lambda x: (x[0], -x[1]))
        left, done = [], []
        for t, i in sorted(map(tuple, self.waiting.get())):
            (done if _passed(t, mark) else left).append((t, i))
        at, on, out = 0, 0, []
        for t, i in done:
            while at < len(changes) and changes[at][0] <= t:
                on, at = changes[at][1], at + 1
            if on:
                out.append(Row(event_id=i, pid=key[0], timestamp_ns=t))
        # Of what the watermark has passed, the last change says what holds from here on.
        old = [c for c in changes if _passed(c[0], mark)]
        kept = old[-1:] + changes[len(old) :]
        self.changes.put(kept) if kept else self.changes.clear()
        if left:
            self.waiting.put(left)
            self._wake(left, timerValues)
        else:
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def registered_events(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Rows (event_id, pid, timestamp_ns) of the events whose pid is registered at their time.

    events: a stream of pid, timestamp_ns, kind and event_id; `register` begins a registration, `exit` and `deregister` end
    it, all other kinds are events. The rows of captured_over_time(hops=0) once the filter is on.
    """
    return _by_pid(events, late).transformWithState(Registered(), "event_id long, pid long, timestamp_ns long", "append", "eventTime")


class ProcessTable(StatefulProcessor):
    """One record a pid. What events say is merged by their times, so their order doesn't matter."""

    NAMES = ("node_ns", "ppid", "comm", "first_ns", "first_comm", "exited_ns", "rooted_ns", "rooted")

    def __init__(self, keep_ns: int):
        self.keep_ns = keep_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "node_ns long, ppid long, comm string, first_ns long, first_comm string, exited_ns long, rooted_ns long, rooted int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.record.get() if self.record.exists() else None
        s = dict(zip(self.NAMES, found if found is not None else [None] * len(self.NAMES)))
        for r in rows:
            t = r.timestamp_ns
            if r.kind == "exec" and (s["node_ns"] is None or (t, r.ppid, r.comm) > (s["node_ns"], s["ppid"], s["comm"])):
                s["node_ns"], s["ppid"], s["comm"] = t, r.ppid, r.comm
            if r.kind == "register" and (s["first_ns"] is None or (t, r.comm) < (s["first_ns"], s["first_comm"])):
                s["first_ns"], s["first_comm"] = t, r.comm
            if r.kind == "exit":
                s["exited_ns"] = t if s["exited_ns"] is None else max(t, s["exited_ns"])
            if r.kind in ("register", "exit"):
                # Of a registration and an exit at one time the exit counts.
                now = (t, r.kind == "exit")
                if s["rooted_ns"] is None or now >= (s["rooted_ns"], not s["rooted"]):
                    s["rooted_ns"], s["rooted"] = t, int(r.kind == "register")
        self.record.update(tuple(s[n] for n in self.NAMES))
        exited = self._exited(s)
        if exited is not None:
            self.handle.registerTimer(max((exited + self.keep_ns) // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([self._row(key, s, False)] if self._since(s) is not None else [])

    @staticmethod
    def _since(s: dict):
        return s["node_ns"] if s["node_ns"] is not None else s["first_ns"]

    def _exited(self, s: dict):
        since = self._since(s)
        return s["exited_ns"] if since is not None and s["exited_ns"] is not None and s["exited_ns"] >= since else None

    def _row(self, key, s: dict, collected: bool) -> Row:
        ppid, comm = (s["ppid"], s["comm"]) if s["node_ns"] is not None else (0, s["first_comm"])
        return Row(pid=key[0], ppid=ppid, comm=comm, exited_ns=self._exited(s), is_root=bool(s["rooted"]), collected=collected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = dict(zip(self.NAMES, self.record.get())) if self.record.exists() else None
        exited = s and self._exited(s)
        if exited is None or not _passed(exited + self.keep_ns, timerValues.getCurrentWatermarkInMs()):
            return iter(())  # a later exec has put a new node in its place
        self.record.clear()
        return iter([self._row(key, s, True)])

    def close(self) -> None:
        pass


def process_table(events: DataFrame, keep_ns: int = 300_000_000_000, late: str = "10 seconds") -> DataFrame:
    """Changes of the process table: rows (pid, ppid, comm, exited_ns, is_root, collected), the last of a pid holds.

    events: a stream of pid, ppid, comm, timestamp_ns and kind, with the meaning of processes.tree_at(). A node that ended
    more than keep_ns before the watermark is collected: its state goes, and a last row says so.
    """
    shown = "pid long, ppid long, comm string, exited_ns long, is_root boolean, collected boolean"
    return _by_pid(events, late).transformWithState(ProcessTable(keep_ns), shown, "update", "eventTime")
