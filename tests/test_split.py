import random

from sparktap.functions import wire
from sparktap.operators import split

PARTS = [
    b"GET /a?b HTTP/1.1\r\n\r\n", b"POST /x HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello", b"HTTP/1.1 204 No\r\ncontent-length: 0\r\n\r\n", b"PUT / HTTP/1.1\r\nContent-Length: -39\r\n\r\n",
    b"POST /c HTTP/1.1\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", b"GET /half HTTP/1.1\r\nHost: h", b"\x00\xff\xe9 body", b"HTTP/1.0 x y\r\nContent-Length: many\r\n\r\n", b"GET /n HTTP/1.1\r\nContent-Length: 900\r\n\r\nshort", b"\r\n\r\n",
]


def payloads(parts, seed, n=150):
    rng = random.Random(seed)
    made = [b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    return [*made, b"", None, b"x" * 70000, parts[1] * 300]


def test_messages_of_any_bytes(spark):
    data = payloads(PARTS, 1)
    d = spark.createDataFrame([(i, bytearray(p) if p is not None else None, "x") for i, p in enumerate(data)], "id long, payload binary, n string")
    got = {}
    for r in split.messages(d).collect():
        got.setdefault(r.id, []).append(r)
    for i, p in enumerate(data):
        want = wire.split_messages(p) if p else []
        rows = sorted(got.get(i, []), key=lambda r: r.message_no)
        assert [r.message_no for r in rows] == list(range(len(want)))
        for r, (head, body, whole) in zip(rows, want):
            line = head.partition(b"\r\n")[0].decode("latin-1").split(" ", 2)
            assert (bytes(r.body), r.body_len, r.whole) == (body, len(body), whole), (p, r)
            assert r.kind == ("response" if head.startswith(b"HTTP/") else "request")
            if r.kind == "request" and len(line) > 1:
                assert (r.method, r.target) == (line[0].upper(), line[1])
            if r.kind == "response":
                assert r.status_code == wire.whole_number(line[1] if len(line) > 1 else None)


def frame(kind, body, stream=1, size=None):
    return (len(body) if size is None else size).to_bytes(3, "big") + bytes([kind, 5]) + (stream | 1 << 31).to_bytes(4, "big") + body


FRAMES = [
    frame(0, b"\x01\x00\x00\x01\x00hello", 3), frame(0, b"abc"), frame(3, b"\x00\x00\x00\x08"), frame(3, b""), frame(4, b"\x00\x03\x00\x00\x00\x64\x00\x63\x00\x00\x00\x01"), frame(4, b""),
    frame(6, b"12345678"), frame(7, b"\x80\x00\x00\x05\x00\x00\x00\x02"), frame(8, b"\xff\xff\xff\xff"), frame(9, b"zz"), frame(1, b"", size=9000), frame(12, b"stop"), b"\x00\x00",
]


def test_frames_of_any_bytes(spark):
    data = payloads(FRAMES, 2) + [wire.PREFACE + FRAMES[4] + FRAMES[8]]
    d = spark.createDataFrame([(i, bytearray(p) if p is not None else None, 7) for i, p in enumerate(data)], "id long, payload binary, type int")
    got = {}
    for r in split.frames(d.withColumnRenamed("type", "n")).collect():
        got.setdefault(r.id, []).append(r)
    for i, p in enumerate(data):
        want = wire.frames(p or b"")
        rows = sorted(got.get(i, []), key=lambda r: r.frame_no)
        assert len(rows) == len(want)
        for r, w in zip(rows, want):
            assert (r.type, r.length, r.flags, r.stream_id) == (w["type"], w["length"], w["flags"], w["stream_id"])
            assert (r.compressed, r.message_len) == ((w["grpc"]["compressed"], w["grpc"]["message_len"]) if "grpc" in w else (None, None))
            assert (r.error_code, r.last_stream_id, r.increment) == (w.get("error_code"), w.get("last_stream_id"), w.get("increment"))
            assert {s["name"]: s["value"] for s in r.settings or []} == w.get("settings", {})
