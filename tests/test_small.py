import random

from pyspark.sql import functions as F

from sparktap.functions import scalars
from sparktap.operators import bodies, detect, filters, metrics, processes, topic
from sparktap.plans import catalog
from sparktap.sources.packets import PAYLOADS


def test_only_the_ipv4_family_is_kept(spark):
    rows = spark.createDataFrame([(1, 2), (2, 10), (3, None), (4, 1)], "n int, family int")
    assert [r.n for r in rows.where(filters.inet_only()).collect()] == [1]


def test_the_first_known_length_counts(spark):
    rows = spark.createDataFrame([(1, 5, 50), (2, None, 50), (3, None, 5), (4, None, None), (5, 50, 5)], "n int, http_len int, grpc_len int").withColumns({"src_port": F.lit(1), "dst_port": F.lit(1)})
    keep = filters.OutputFilter(min_body_bytes=10)
    assert [r.n for r in rows.where(keep.column(body=("http_len", "grpc_len"))).orderBy("n").collect()] == [2, 4, 5]
    assert [r.n for r in rows.where(keep.column(body="grpc_len")).orderBy("n").collect()] == [1, 2, 4]


def test_drops_count_above_the_highest_total_before(spark):
    rows = [("a", 1, 3), ("a", 1, 4), ("a", 2, 5), ("a", 2, None), ("a", 3, 9), ("b", 1, -4), ("b", 2, 1), ("b", 3, None)]
    got = metrics.drops(spark.createDataFrame(rows, "host string, at int, drops long"), ["host"], ["at"]).orderBy("host", "at").collect()
    assert [tuple(r) for r in got] == [("a", 1, 7, 7), ("a", 2, 5, 0), ("a", 3, 9, 2), ("b", 1, -4, 0), ("b", 2, 1, 1), ("b", 3, 0, 0)]


def test_snapshot_has_children_of_each_node(spark):
    rows = [(1, None, "init"), (2, 1, "a"), (3, 1, "b"), (4, 3, None), (5, 99, "orphan")]
    got = {r.pid: r.children for r in processes.snapshot(spark.createDataFrame(rows, "pid long, ppid long, comm string")).collect()}
    assert got == {1: [2, 3], 2: [], 3: [4], 4: [], 5: []}
    assert processes.snapshot(spark.createDataFrame([], "pid long, ppid long")).count() == 0


def test_first_of_each_value_stays(spark):
    rows = [("/a", 3, "late"), ("/a", 1, "first"), (None, 2, "none"), ("/b", 5, "z"), ("/b", 5, "y"), (None, 4, "more")]
    got = filters.first_of_each(spark.createDataFrame(rows, "real string, place int, path string"), "real", ["place"])
    assert [tuple(r) for r in got.orderBy("place").collect()] == [("/a", 1, "first"), (None, 2, "none"), ("/b", 5, "y")]
    assert got.columns == ["real", "place", "path"] and got.limit(0).count() == 0


def test_payload_as_digits_only_where_asked_for(spark):
    data = bytes(range(256)) * 2
    one = spark.createDataFrame([(bytearray(data),), (bytearray(),), (None,)], "data binary")
    rows = one.select(*[v.alias(k) for k, v in scalars.payload_fields(F.col("data"), True).items()]).collect()
    assert rows[0].payload_hex == data.hex() and rows[0].payload_preview == "".join(chr(b) if 32 <= b < 127 else "." for b in data[:128])
    assert rows[1] == ("", "") and rows[2] == (None, None)
    assert list(scalars.payload_fields(F.col("data"))) == ["payload_preview"]


def test_types_of_content(spark):
    kinds = {"application/json": (True, False), "APPLICATION/VND.x+json": (True, False), "text/jsonx": (True, False), "application/x": (False, False), "multipart; application/x-www-form-urlencoded": (False, True), None: (None, None)}
    rows = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", scalars.is_json_type(F.col("k")), scalars.is_form_type(F.col("k"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == kinds


def test_schemas_are_merged_where_tasks_have_no_rows(spark):
    rows = spark.createDataFrame([("a", bytearray(b'{"x": 1}')), ("a", bytearray(b'{"y": null}')), ("b", bytearray(b"text")), ("c", None)], "kind string, body binary")
    assert [tuple(r) for r in bodies.merged_by(rows.repartition(8, "kind"), "kind").collect()] == [("a", '{"x": "integer", "y": "null"}')]
    assert bodies.merged_by(rows.where("kind = 'b'"), "kind").count() == bodies.merged_by(rows.limit(0), "kind").count() == 0


def test_remembered_packets_show_what_they_showed(monkeypatch):
    """Any payloads in any order of states, with a memory so small that it is cleared now and then."""
    monkeypatch.setattr(detect, "REMEMBERED", 50)
    monkeypatch.setattr(detect, "SHORT", 200)
    rng = random.Random(5)
    some = [*PAYLOADS, b"", b"?", b"HTTP/1.1 101 Switching\r\n\r\n", b"\x00\x00\x05\x00\x00\x00\x00\x00\x01\x01\x00\x00\x00\x09", b"GET / HTTP/1.1\r\n\r\n" + b"x" * 300]
    move, one, other = detect.mover(), detect.START, detect.START
    for _ in range(4000):
        packet = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 7]), rng.choice([1, 2, 1, 2, 3]), rng.choice(some)
        (one, found), (other, want) = move(one, *packet), detect._move(other, *packet)
        assert (one, found) == (other, want)


def test_times_kept_beside_unknown_ones_stay_exact(spark):
    at = 1_700_000_000_123_456_789
    rows = [(1, 7, at, 0, 1, bytearray(b"?")), (2, 7, None, 0, 1, bytearray(b"GET / HTTP/1.1\r\n\r\n")), (3, 7, at + 1, 0, 1, None)]
    packets = spark.createDataFrame(rows, "event_id long, conn_id long, timestamp_ns long, protocol int, direction int, payload binary")
    got = detect.detect(packets, keep=("timestamp_ns",)).orderBy("packet_no").collect()
    assert [(r.event_id, r.timestamp_ns, r.packet_no) for r in got] == [(1, at, 1), (3, at + 1, 2), (2, None, 3)]


def test_a_message_is_made_and_parsed_once(spark, sf_small):
    plan = catalog.QUERIES["u1_p14_p16_p17_http_stream"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("from_json(", "StructsToJsonEvaluator", "VariantExpressionEvalUtils.parseJson")] == [1, 1, 1]


def test_messages_that_are_no_objects_are_dropped(spark):
    texts = [b'{"conn_id": 1}', b' {"conn_id": "x"}', b"[1]", b'{"a": 1', b"", b'{"conn_id": 2} x', None]
    rows = [(None if t is None else bytearray(t), [("x-agent-key", bytearray(b"k"))]) for t in texts] + [(bytearray(texts[0]), [("x-agent-key", bytearray(b" "))]), (bytearray(texts[0]), None)]
    got = topic.normalise(spark.createDataFrame(rows, "value binary, headers array<struct<key: string, value: binary>>"))
    assert sorted((r.agent_key, r.conn_id) for r in got.collect()) == [("k", 0), ("k", 1)]
