import time

from pyspark.sql import functions as F

from sparktap.sources import sinks
from sparktap.sources.fixtures import view
from sparktap.streaming import health


def test_counters_of_a_stream_equal_a_recount(spark, sf_small, tmp_path):
    packets = view(spark, sf_small, "packets").select("event_id", "payload_len", "original_len", "direction").persist()
    for k in range(3):
        packets.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    listener = health.Health()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        seen = health.watched(stream, malformed=F.col("payload_len") < F.col("original_len"), parse_error=F.col("original_len") % 7 == 0)
        q = seen.writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(100):
            found = [x for x in listener.snapshot() if x["name"] == "counted"]
            if found and not found[0]["active"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = packets.collect()
    want = {"events": len(rows), "bytes_captured": sum(r.payload_len for r in rows), "close_events": sum(r.direction == 3 for r in rows), "malformed_events": sum(r.payload_len < r.original_len for r in rows), "parse_errors": sum(r.original_len % 7 == 0 for r in rows)}
    assert found[0]["counters"] == want == listener.totals() and found[0]["input_rows"] == len(rows) and found[0]["batches"] >= 3 and found[0]["error"] is None
    assert f"events {len(rows)}" in sinks.prometheus(listener.totals())


def test_fan_out_counts_in_one_pass(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * i if i % 3 else None) for i in range(30)], "n long, s string")
    told = sinks.fan_out(d, [("files", sinks.ndjson(str(tmp_path / "out"), compression="none")), ("bad", lambda df: 1 / 0)], F.length("s") > 4)
    lines = [x for p in (tmp_path / "out").glob("*.txt") for x in p.read_bytes().splitlines(keepends=True)]
    good, bad = told
    assert (good["written"], good["filtered"], good["bytes"]) == (len(lines), 30 - len(lines), sum(map(len, lines)))
    assert (bad["written"], bad["failed"], bad["filtered"]) == (0, len(lines), 30 - len(lines)) and "zero" in bad["error"]
    assert sinks.fan_out(d.limit(0), [("none", sinks.callback(lambda df: None))])[0]["written"] == 0
