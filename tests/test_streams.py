import pytest
from pyspark.sql import functions as F

from sparktap.operators import connections, sse
from sparktap.sources.fixtures import view
from sparktap.streaming import lives

FAR = 10**18


def run(spark, build, parts, tmp_path, name):
    """A stream over files that are read one after the other; with all of them read, its rows."""
    for k, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_stream_of_lives_equals_batch(spark, sf_small, tmp_path):
    packets = view(spark, sf_small, "packets").select("event_id", "conn_id", "timestamp_ns", "direction", "original_len", "pid", "protocol").where("conn_id % 3 = 0").persist()
    cuts = packets.approxQuantile("timestamp_ns", [0.4, 0.7], 0.0)
    t = F.col("timestamp_ns")
    parts = [packets.where(t <= cuts[0]), packets.where((t > cuts[0]) & (t <= cuts[1])), packets.where(t > cuts[1])]
    # A late packet of another connection moves the watermark on, so that open lives run out.
    last = packets.limit(1).select("event_id", F.lit(-1).cast("long").alias("conn_id"), F.lit(FAR * 4).cast("long").alias("timestamp_ns"), *[F.col(c) for c in ("direction", "original_len", "pid", "protocol")])
    ttl = FAR
    got = run(spark, lambda s: lives.connection_lives(s, ttl), [*parts, last], tmp_path, "lives")
    cols = [p.split()[0] for p in lives.LIFE.split(", ")]
    want = connections.totals(connections.incarnations(packets)).select(*cols).collect()
    assert sorted(map(repr, (tuple(r) for r in got if r.conn_id >= 0))) == sorted(map(repr, map(tuple, want)))
    assert any(r.closed_ns is None for r in got) and any(r.closed_ns is not None for r in got)


@pytest.mark.parametrize("at_once", [True, False])
def test_stream_of_parts_equals_batch(spark, tmp_path, at_once):
    second = 1_000_000_000
    big = "data: " + "é" * 70000
    reads = [(1, 0, "data: a"), (1, 1, "data: b"), (1, 4, "data: c"), (1, 5, "data: [DONE]"), (1, 6, "data: d"), (1, 9, 'data: "finish_reason"'), (1, 20, "data: e"), (2, 1, big), (2, 2, big), (2, 3, "data: f"), (2, 30, "HTTP/1.1 200 OK"), (3, 7, "event: x")]
    rows = [(p, (100 + s) * second, k, "read", d) for k, (p, s, d) in enumerate(reads)]
    make = lambda r: spark.createDataFrame(r, "pid long, timestamp_ns long, seq long, direction string, data string")
    rows.sort(key=lambda r: r[1])
    parts = [make(rows)] if at_once else [make(rows[:4]), make(rows[4:8]), make(rows[8:])]
    end = make([(9, 2000 * second, 99, "read", "data: z")])
    got = run(spark, lives.reassemble, [*parts, end], tmp_path, f"parts_{at_once}")
    want = sse.reassemble(make(rows), sse.IDLE_NS).collect()
    assert sorted(map(repr, (tuple(r) for r in got if r.pid != 9))) == sorted(map(repr, map(tuple, want)))


def test_process_tree_over_time(spark):
    from sparktap.operators.processes import collected, tree_at

    rows = [
        (1, 0, "root", 10, "register"), (2, 1, "old", 20, "exec"), (2, 1, "new", 30, "exec"), (2, 1, "new", 40, "exit"), (3, 1, "x", 50, "exit"), (4, 1, "a", 60, "exec"), (4, 1, "a", 70, "exit"), (4, 9, "b", 80, "exec"),
        (1, 0, "root", 90, "exit"), (5, 1, "r", 10, "register"), (5, 1, "s", 15, "exec"), (6, 1, "late", 500, "exec"), (7, 1, "q", 10, "other"),
    ]
    nodes = tree_at(spark.createDataFrame(rows, "pid long, ppid long, comm string, timestamp_ns long, kind string"), 100)
    got = {tuple(r) for r in nodes.collect()}
    assert got == {(1, 0, "root", 90, False), (2, 1, "new", 40, False), (4, 9, "b", None, False), (5, 1, "s", None, True)}
    assert {r.pid for r in collected(nodes, 100, 30).collect()} == {1, 4, 5}
