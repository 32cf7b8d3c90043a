import http.server
import json
import threading
import time

import duckdb
import pytest

import __spark_entry__ as entry
from sparktap.operators import connections, detect, filters, sse, topic
from sparktap.plans import catalog
from sparktap.sources import sinks
from sparktap.sources.fixtures import view
from sparktap.sources.packets import decode, with_payload
from sparktap.streaming import lifecycle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else list(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_small, name):
    got = catalog.QUERIES[name](spark, sf_small)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == cols
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(repr([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_stream_equals_batch(spark, sf_small, tmp_path):
    packets = with_payload(view(spark, sf_small, "packets")).limit(400).persist()
    want = {(r.event_id, r.final_protocol, r.confidence, r.packet_no) for r in detect.detect(packets).collect()}
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
    q = lifecycle.detect_stream(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).start()
    # With processing-time timeouts batches without data go on for ever, so the test waits for the rows.
    end = time.time() + 120
    try:
        while time.time() < end and spark.table("found").count() < len(want):
            time.sleep(1)
    finally:
        q.stop()
    got = {(r.event_id, r.final_protocol, r.confidence, r.packet_no) for r in spark.table("found").collect()}
    assert got == want


def test_promotion_table(spark):
    f = lambda *codes: spark.range(1).select(connections.promote(connections.F.array(*[connections.F.lit(c) for c in codes]))).first()[0]
    assert f(0, 1, 5) == 5 and f(1, 6) == 1 and f(6, 7, 2) == 7 and f(2, 3, 1) == 3


def test_short_records_are_dropped(spark):
    d = spark.createDataFrame([(bytearray(b"\x00" * 71),), (bytearray(b"\x00" * 60 + b"\x09\x00\x00\x00" + b"\x00" * 8 + b"abc"),), (None,)], "record binary")
    rows = decode(d).collect()
    assert len(rows) == 1 and rows[0].payload_len == 3 and bytes(rows[0].payload) == b"abc"


def test_sinks(spark, tmp_path):
    good, bad = sinks.build([{"type": "file", "path": str(tmp_path / "out")}, {"type": "nope"}, {"type": "kafka", "key_field": "x"}])
    assert [k for k, _ in good] == ["file"] and len(bad) == 2
    out = sinks.fan_out(spark.range(5), [*good, ("bad", lambda df: 1 / 0)])
    assert out[0]["written"] == 5 and out[1]["error"] and spark.read.text(str(tmp_path / "out")).count() == 5
    assert sinks.build([])[0][0][0] == "stdout" and "x 1" in sinks.prometheus({"x": 1})


def test_filter_names_unknown_keys():
    with pytest.raises(ValueError, match="parse_errors"):
        filters.OutputFilter.of({"parse_errors": True})


@pytest.mark.parametrize("idle_ns", [None, sse.IDLE_NS])
def test_long_stream_is_cut_at_its_byte_limit(spark, idle_ns):
    chunk = "data: " + "é" * 32765  # 65536 bytes
    sizes = [chunk] * 9 + ["data: a", "data: [DONE]", "data: b"]
    rows = [(p, k, k, "read", d) for p in (1, 2) for k, d in enumerate(sizes)] + [(3, 0, 0, "read", chunk * 5), (3, 1, 1, "read", "data: c")]
    d = spark.createDataFrame(rows, "pid long, timestamp_ns long, seq long, direction string, data string")
    got = [(r.pid, r.part, r.n_chunks, len(r.data.encode()), r.complete) for r in sse.reassemble(d, idle_ns).orderBy("pid", "part").collect()]
    one = [(0, 4, 4 * 65536, False), (1, 4, 4 * 65536, False), (2, 3, 65536 + 7 + 12, True), (3, 1, 7, False)]
    assert got == [(p, *x) for p in (1, 2) for x in one] + [(3, 0, 1, 5 * 65536, False), (3, 1, 1, 7, False)]


def test_consumer_reads_one_http_branch_of_a_message(spark):
    h1 = {"headers": {"host": "", ":authority": "a.example"}, "method": "GET", "path": "/x", "query": "q=1", "body_len": 5, "body_schema": {"a": "int"}, "status_code": 404}
    h2 = {"request": {"method": "PUT", "path": "/h2", "authority": "b.example", "status": 201}, "frames": [{"type": "HEADERS", "data_schema": {"z": 1}}, {"type": "DATA", "data_schema": {}}, {"type": "DATA", "data_schema": {"b": "str"}}, {"type": "DATA", "data_schema": {"c": "str"}}]}
    grpc, mcp = {"service": "pkg.S", "method": "M", "message_len": 9}, {"method": "tools/call", "params_schema": {"p": "int"}}
    sent = [
        {"http1": h1 | {"is_request": True}}, {"http1": h1 | {"is_response": True}, "mcp": mcp}, {"http2": h2, "grpc": grpc}, {"grpc": grpc, "mcp": mcp}, {"grpc": {"method": "M"}}, {"mcp": mcp}, {"mcp": {}}, {"mcp": {"method": None}},
        {"mcp": mcp, "ssl_content": "GET /own HTTP/1.1\r\nHost: c.example\r\nA: b"}, {"http2": h2, "ssl_content": '"model"'}, {"pid": 1},
    ]
    rows = [(json.dumps({"conn_id": i} | m).encode(), [("X-Agent-Key", b"k")]) for i, m in enumerate(sent)]
    d = spark.createDataFrame(rows, "value binary, headers array<struct<key: string, value: binary>>")
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in topic.normalise(d).orderBy("conn_id").select("method", "raw_path", *topic.HTTP_COLUMNS).collect()]
    tool = {"method": "POST", "raw_path": "/mcp/tools/call", "mcp_method": "tools/call", "mcp_params_schema": '{"p":"int"}'}
    assert got == [
        {"method": "GET", "raw_path": "/x", "host": "a.example", "query": "q=1", "request_size": 5, "request_schema": '{"a":"int"}'},
        {"host": "a.example", "status_code": 404, "response_size": 5, "response_schema": '{"a":"int"}'},
        {"method": "PUT", "raw_path": "/h2", "host": "b.example", "status_code": 201, "response_schema": '{"b":"str"}'},
        {"method": "POST", "raw_path": "/pkg.S/M", "request_size": 9, "grpc_service": "pkg.S", "grpc_method": "M"},
        {"method": "POST", "grpc_method": "M"}, tool, {"method": "POST", "raw_path": "/mcp/unknown"}, {"method": "POST", "raw_path": "/mcp/None"},
        tool | {"method": "GET", "raw_path": "/own", "host": "c.example"}, {"method": "PUT", "raw_path": "/h2", "host": "b.example", "status_code": 201, "response_schema": '{"b":"str"}'}, {},
    ]


def test_webhook_counts_what_went_out_and_what_failed(spark):
    got = []

    class Take(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            bad = b'"id":3' in body
            got.append(0 if bad else body.count(b"\n") + 1)
            self.send_response(500 if bad else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Take)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        sink = sinks.webhook(f"http://127.0.0.1:{server.server_port}", tries=2, wait_s=0.01, rows_per_post=1)
        out = sinks.fan_out(spark.range(10), [("webhook", sink)])
        gone = sinks.fan_out(spark.range(4), [("webhook", sinks.webhook("http://127.0.0.1:9", tries=1))])
    finally:
        server.shutdown()
    assert [(x["sink"], x["error"], x["written"], x["failed"]) for x in out] == [("webhook", None, 9, 1)] and sum(got) == 9
    assert gone[0]["failed"] == 4 and gone[0]["written"] == 0


def test_sinks_can_be_removed():
    sinks.register("own", lambda: print)
    assert sinks.build([{"type": "own"}])[0][0][0] == "own"
    assert sinks.remove("own") and not sinks.remove("own") and sinks.build([{"type": "own"}])[1]
