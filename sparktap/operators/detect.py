"""Protocol detection: one transition function for batch and stream.

The state of a connection is (packets, latched protocol, WebSocket upgrade seen). Any result of high confidence latches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap import schema as P
from sparktap.functions import wire
from sparktap.session import ship

FRESH = (0, -1, 0)
#: With what notes need: whether the connection began with an HTTP/2 preface, and its gRPC service and method.
START = (*FRESH, 0, None, None)
_TYPE = re.compile(rb"\r\ncontent-type:[ \t]*([^\r\n]*)", re.I)
_UPGRADE = re.compile(rb"upgrade:\s*websocket", re.I)
RESULT = "final_protocol int, confidence int, is_ws_handshake boolean, latched boolean, packet_no long, info string, parsed string"


def _tls(d: bytes) -> tuple[int, int]:
    if len(d) < 5:
        return P.TLS, P.MEDIUM
    if not 0x14 <= d[0] <= 0x17:
        return P.UNKNOWN, P.LOW
    return P.TLS, P.HIGH if int.from_bytes(d[1:3], "big") in wire.TLS_VERSIONS else P.MEDIUM


def _http2(d: bytes) -> tuple[int, int]:
    preface = d.startswith(wire.PREFACE)
    at = len(wire.PREFACE) if preface else 0
    sure = preface or (len(d) >= at + 9 and d[at + 3] <= 9)
    if wire.grpc_path(d):
        return P.GRPC, P.HIGH
    return P.HTTP2, P.HIGH if sure else P.MEDIUM


def _http1(d: bytes, packets: int, code: int) -> tuple[int, int]:
    request = re.match(rb"(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE) ", d)
    if not request and not d.startswith(b"HTTP/1."):
        return (code, P.MEDIUM) if packets > 1 else (P.UNKNOWN, P.LOW)
    if request and _UPGRADE.search(d) or d.startswith(b"HTTP/1.1 101"):
        return P.WEBSOCKET, P.HIGH
    head, _, body = d.partition(b"\r\n\r\n")
    kind = _TYPE.search(head)
    if kind and b"application/json" in kind[1].lower() and wire.rpc(body[:508]):
        return P.MCP, P.HIGH
    return code, P.HIGH


def _websocket(d: bytes) -> tuple[int, int]:
    if len(d) < 2:
        return P.WEBSOCKET, P.LOW
    if d[0] & 0x0F not in wire.OPCODES:
        return P.UNKNOWN, P.LOW
    return P.WEBSOCKET, P.MEDIUM if d[0] & 0x70 else P.HIGH


def _mcp(d: bytes) -> tuple[int, int]:
    d = d[:4096]
    if wire.rpc(d):
        return P.MCP, P.HIGH
    if b'"jsonrpc"' in d and b'"2.0"' in d:
        method = re.search(rb'"method"\s*:\s*"([^"]*)"', d)
        known = not method or method[1].decode("utf-8", "replace") in wire.MCP_METHODS
        return (P.MCP, P.MEDIUM) if known else (P.UNKNOWN, P.LOW)
    return P.UNKNOWN, P.LOW


def _unknown(d: bytes, packets: int, upgraded: bool) -> tuple[int, int]:
    if len(d) < 3:
        return P.UNKNOWN, P.LOW
    if 0x14 <= d[0] <= 0x17 and d[1] == 3:
        return _tls(d)
    if d.startswith(b"PRI * HT"):
        return _http2(d)
    if d[:1] in b"GPDHOCT" and (found := _http1(d, packets, P.HTTP1))[1] >= P.MEDIUM and found[0] != P.UNKNOWN:
        return found
    if upgraded:
        return _websocket(d)
    if d[:1] == b"{" and (found := _mcp(d))[1] >= P.MEDIUM:
        return found
    if len(d) >= 9 and d[3] <= 9 and int.from_bytes(d[:3], "big") <= len(d):
        return _http2(d)
    return P.UNKNOWN, P.LOW


def step(state: tuple, code: int, direction: int, data: bytes) -> tuple[tuple, tuple]:
    """The next state and (protocol, confidence, handshake, latched, packet number). A closing packet forgets the state."""
    packets, latched, upgraded = state
    packets += 1
    if direction == 3:
        return FRESH, (code, P.HIGH, False, False, packets)
    shake = data.startswith(b"HTTP/1.1 101") or bool(_UPGRADE.search(data[:2048]) and wire.is_start(data))
    if latched >= 0:
        return (packets, latched, upgraded), (latched, P.HIGH, shake, True, packets)
    try:
        if code == P.TLS:
            found = _tls(data)
        elif code == P.HTTP2:
            found = _http2(data)
        elif code == P.HTTP1:
            found = _http1(data, packets, code)
        elif code == P.WEBSOCKET:
            found = _websocket(data)
        elif code == P.MCP:
            found = _mcp(data)
        elif code == P.GRPC:
            found = (P.GRPC, P.HIGH)
        elif code == P.UNKNOWN:
            found = _unknown(data, packets, bool(upgraded))
        else:
            found = (code, P.HIGH)
    except Exception:
        found = (code, P.LOW)
    upgraded = int(upgraded or data.startswith(b"HTTP/1.1 101"))
    return (packets, found[0] if found[1] == P.HIGH else -1, upgraded), (*found, shake, False, packets)


def note(seen: tuple, protocol: int, data: bytes, parsed: dict) -> tuple[tuple, dict]:
    """What a packet's first frame or message says, under its protocol's name; {} for protocols without notes.

    `seen` is (preface, service, method) of the connection: later packets of a gRPC call show the service and method that
    its headers named. An MCP message inside HTTP has no notes, as a message must start the packet.
    """
    preface, service, method = seen
    if protocol == P.TLS:
        found = wire.tls(data)
        return seen, {"tls": {"record_type": found["record_type"], "version": found["version"], "is_handshake": data[:1] == b"\x16", "hs_type_name": found["hs_type"]}}
    if protocol in (P.HTTP2, P.HTTP2_TLS, P.GRPC):
        preface = int(preface or data.startswith(wire.PREFACE))
        at = len(wire.PREFACE) if data.startswith(wire.PREFACE) else 0
        kind = data[at + 3] if len(data) >= at + 9 and data[at + 3] <= 9 else None
        frame = {"has_preface": bool(preface) and kind is not None, "frame_type": kind, "stream_id": None if kind is None else int.from_bytes(data[at + 5 : at + 9], "big") & 0x7FFFFFFF}
        out: dict = {"http2": frame}
        if protocol == P.GRPC:
            service, method = (service, method) if service else wire.grpc_path(data) or (service, method)
            body = data[at + 9 : at + 14] if kind == 0 else b""
            out["grpc"] = {"service": service, "method": method, "compressed": len(body) == 5 and body[0] == 1, "message_len": int.from_bytes(body[1:], "big") if len(body) == 5 else None}
        return (preface, service, method), out
    if protocol == P.WEBSOCKET:
        asked = bool(wire.is_start(data) and _UPGRADE.search(data))
        if asked or data.startswith(b"HTTP/1.1 101"):
            return seen, {"websocket": {"is_upgrade_request": asked and not data.startswith(b"HTTP/"), "is_upgrade_response": data.startswith(b"HTTP/"), "opcode_name": None, "masked": None, "payload_len": None}}
        if len(data) >= 2:
            return seen, {"websocket": {"is_upgrade_request": False, "is_upgrade_response": False, "opcode_name": wire.OPCODES.get(data[0] & 0x0F), "masked": bool(data[1] & 0x80), "payload_len": data[1] & 0x7F}}
    if protocol == P.MCP and data[:1] == b"{" and (found := wire.rpc(data[:4096])):
        return seen, {"mcp": {"method": found["method"], "msg_id": parsed.get("mcp", {}).get("id"), **{f"is_{k}": found["kind"] == k for k in ("request", "response", "notification")}}}
    return seen, {}


COLUMNS = ("final_protocol", "confidence", "is_ws_handshake", "latched", "packet_no", "info", "parsed")
#: Results of payloads seen before: of so many bytes at most, so many at once.
SHORT, REMEMBERED = 1024, 1 << 13


def _move(state: tuple, code: int, direction: int, data: bytes) -> tuple[tuple, tuple]:
    """The next state and the columns of a packet."""
    now, found = step(state[:3], code, direction, data)
    if direction == 3:
        seen, info, parsed = START[3:], {}, {}
    else:
        seen, parsed = state[3:], wire.parse(data, found[0])
        try:
            seen, info = note(seen, found[0], data, parsed)
        except Exception:
            info = {}
    if found[0] != code:
        info["was_upgraded"] = True
        if not found[3]:
            info["correction_reason"] = f"{P.PROTOCOLS.get(code, code)} to {P.PROTOCOLS[found[0]]}"
    return (*now, *seen), (*found, json.dumps(info, sort_keys=True), json.dumps(parsed, sort_keys=True))


def mover():
    """_move, with a memory: what a packet shows depends on the packets before it by the state without their number, of which
    only counts whether it is 0."""
    known: dict[tuple, tuple] = {}

    def move(state: tuple, code: int, direction: int, data: bytes) -> tuple[tuple, tuple]:
        if len(data) > SHORT:
            return _move(state, code, direction, data)
        n = state[0]
        key = (n > 0, state[1:], code, direction == 3, data)
        found = known.get(key)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            now, row = _move((min(n, 1), *state[1:]), code, direction, data)
            found = known[key] = (now[0] > 0, now[1:], row[:4], row[5:])
        goes_on, later, head, tail = found
        return (n + 1 if goes_on else 0, *later), (*head, n + 1, *tail)

    return move


def follow(rows: pd.DataFrame, state: tuple = START, keep: tuple = ()) -> tuple[pd.DataFrame, tuple]:
    """Results of one connection's rows, sorted here by time and number, with the columns named in `keep`."""
    rows = rows.sort_values(["timestamp_ns", "event_id"], kind="stable")
    out = []
    for code, direction, data in zip(rows.protocol, rows.direction, rows.payload):
        state, found = _move(tuple(state), int(code), int(direction), bytes(data or b""))
        out.append(found)
    return rows[["event_id", "conn_id", *keep]].assign(**{c: [x[i] for x in out] for i, c in enumerate(COLUMNS)}), tuple(state)


def detect(packets: DataFrame, keep: tuple = ()) -> DataFrame:
    """Each packet with its connection's protocol by then and the parsed payload: one shuffle on conn_id, one pass.
    Columns named in `keep` go along.

    Rows are sorted within partitions and followed as a stream, so no connection is held in memory as a whole.
    """
    ship(packets.sparkSession)
    needed = ("event_id", "conn_id", "timestamp_ns", "protocol", "direction", "payload")
    as_read = {"event_id": "long", "conn_id": "long", "protocol": "int", "direction": "int"}
    taken = packets.select(*[F.col(c).cast(as_read[c]) if c in as_read else F.col(c) for c in needed], *[c for c in keep if c not in needed])
    kept = "".join(f", `{c}` {taken.schema[c].dataType.simpleString()}" for c in keep)
    ordered = taken.repartition("conn_id").sortWithinPartitions("conn_id", F.col("timestamp_ns").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, move = None, START, mover()
        for batch in batches:
            out = []
            for conn, code, direction, data in zip(*(batch.column(c).to_pylist() for c in ("conn_id", "protocol", "direction", "payload"))):
                if conn != last:
                    last, state = conn, START
                state, found = move(state, code, direction, data or b"")
                out.append(found)
            if out:
                shown = [batch.column(c) for c in ("event_id", "conn_id", *keep)] + [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(shown, names=["event_id", "conn_id", *keep, *COLUMNS])

    return ordered.mapInArrow(run, f"event_id long, conn_id long{kept}, {RESULT}")


INFO = (
    "tls struct<record_type: string, version: string, is_handshake: boolean, hs_type_name: string>, http2 struct<has_preface: boolean, frame_type: int, stream_id: long>, "
    "grpc struct<service: string, method: string, compressed: boolean, message_len: long>, "
    "websocket struct<is_upgrade_request: boolean, is_upgrade_response: boolean, opcode_name: string, masked: boolean, payload_len: int>, "
    "mcp struct<method: string, msg_id: string, is_request: boolean, is_response: boolean, is_notification: boolean>, was_upgraded boolean, correction_reason string"
)


def with_info(detected: DataFrame) -> DataFrame:
    """The notes as a struct. was_upgraded is null where the first guess stands."""
    return detected.withColumn("info", F.from_json("info", INFO))


def parsed_with_schema(packets: DataFrame) -> DataFrame:
    return packets.withColumn("parsed", F.try_parse_json("parsed"))
