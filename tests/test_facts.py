"""Decisions on facts of the format, by their number in the survey."""

import random

import pytest
from pyspark.sql import functions as F

from sparktap.functions import scalars as S
from sparktap.operators import connections, filters, processes, topic
from sparktap.sources import sinks
from sparktap.sources.packets import decode


def packet(ip=b"\x0a\x00\x00\x01"):
    record = bytearray(72)
    record[28:32], record[32:36] = ip, bytes(reversed(ip))
    record[8:16] = (0x1122).to_bytes(8, "little")
    return record


def test_q1_addresses_are_in_network_order(spark):
    r = decode(spark.createDataFrame([(packet(),)], "record binary")).first()
    assert (r.src_ip, r.dst_ip) == ("10.0.0.1", "1.0.0.10")


def test_q11_a_packet_carries_both_forms(spark):
    d = decode(spark.createDataFrame([(packet(),)], "record binary")).withColumn("event_id", F.lit(1))
    r = topic.packet_dict(d).first()
    assert (r.conn_id, r.conn_id_hex, r.src, r.dst) == (0x1122, "0x0000000000001122", "10.0.0.1:0", "1.0.0.10:0")


def test_q12_writes_are_resolved_by_their_descriptor(spark):
    """The byte count of a write is a descriptor that another path was opened with."""
    opens = spark.createDataFrame([(1, 3, 10, "right"), (1, 64, 10, "wrong")], "pid long, fd long, timestamp_ns long, path string")
    writes = spark.createDataFrame([(7, 1, 3, 20, 64)], "event_id long, pid long, fd long, timestamp_ns long, retval long")
    assert [r.resolved_path for r in processes.resolved_paths(writes, opens).collect()] == ["right"]


def test_q16_unknown_keys_are_named(spark):
    with pytest.raises(ValueError, match="parse_errors"):
        filters.OutputFilter.of({"parse_errors": True})
    d = spark.createDataFrame([(1, None), (2, "bad")], "event_id long, parse_error string")
    kept = filters.OutputFilter.of({"drop_parse_errors": True}).column(parse_error="parse_error")
    assert [r.event_id for r in d.where(kept).collect()] == [1]
    good, faults = sinks.build([{"type": "webhook", "url": "http://x", "batch_size": 3}, {"type": "stdout"}])
    assert [name for name, _ in good] == ["stdout"] and len(faults) == 1 and "batch_size" in faults[0]


def test_q17_times_are_cut_to_microseconds(spark):
    value = '{"conn_id": 1, "timestamp_ns": 1999, "pid": 2, "ssl_content": "x", "protocol": 5, "dst_port": "no number"}'
    rows = [(b"1", bytearray(value.encode()), [("X-Agent-Key", bytearray(b"k"))]), (b"1", bytearray(b"[1]"), [("X-Agent-Key", bytearray(b"k"))]), (b"1", bytearray(b'{"a": 1} x'), [("X-Agent-Key", bytearray(b"k"))])]
    d = spark.createDataFrame(rows, "key binary, value binary, headers array<struct<key: string, value: binary>>")
    (r,) = topic.normalise(d).withColumn("us", F.unix_micros("occurred_at")).collect()
    assert (r.us, r.timestamp_ns, r.conn_id, r.protocol) == (1, 1999, 1, "HTTPS")


def test_q18_digits_are_those_of_ascii(spark):
    d = spark.createDataFrame([("2024-01-02",), ("٢٠٢٤-٠١-٠٢",), ("10.0.0.1",), ("١٠.0.0.1",)], "s string")
    got = [r[0] for r in d.select(S.format_token(F.col("s"))).collect()]
    assert got[0] != "string" and got[2] != "string" and got[1] == got[3] == "string"


def test_promotion_by_first_places_equals_the_full_fold(spark):
    from sparktap import schema

    rng = random.Random(3)
    rows = [(i, rng.randrange(30), rng.randrange(100), 1, 10, 5, rng.choice([0, 0, 0, *range(9)])) for i in range(800)]
    d = spark.createDataFrame(rows, "event_id long, conn_id long, timestamp_ns long, direction int, original_len long, pid long, protocol int")
    want = {}
    for _, conn, _, _, _, _, code in sorted(rows, key=lambda r: (r[2], r[0])):
        now = want.setdefault(conn, code)
        want[conn] = code if code in schema.PROMOTIONS.get(now, ()) else now
    got = {r.conn_id: (r.protocol, r.packets_sent, r.first_ns) for r in connections.totals(connections.incarnations(d)).collect()}
    assert got == {c: (p, sum(r[1] == c for r in rows), min(r[2] for r in rows if r[1] == c)) for c, p in want.items()}
