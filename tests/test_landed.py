import gzip
import io
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktap.operators import detect
from sparktap.session import ship
from sparktap.sources import landed
from sparktap.sources.fixtures import view
from sparktap.sources.packets import decode, encode, with_payload
from sparktap.streaming import lifecycle


@pytest.fixture
def source(spark):
    ship(spark)
    spark.dataSource.register(landed.LandedRecords)
    return spark


def test_any_split_finds_each_frame_once():
    """Records that hold marks and whole frames, broken bytes between frames, a cut last frame."""
    rng = random.Random(1)
    records = [rng.randbytes(rng.randrange(40)) + rng.choice([b"", landed.MARK, landed.MARK * 3]) for _ in range(60)] + [b"", rng.randbytes(9000)]
    parts = [landed.frame(r) for r in records]
    clean = b"".join(parts)
    for data in (clean, clean + landed.frame(b"cut off")[:-1], rng.randbytes(50) + b"".join(p + (rng.randbytes(7) if rng.random() < 0.3 else b"") for p in parts)):
        for _ in range(12):
            cuts = sorted({0, len(data), *[rng.randrange(len(data)) for _ in range(rng.randrange(6))]})
            found = [x for low, high in zip(cuts, cuts[1:]) for x in landed.scan(io.BytesIO(data), len(data), low, high)]
            assert [r for _, r in found] == records
    broken = bytearray(clean)
    broken[len(parts[0]) + 15] ^= 1
    assert [r for _, r in landed.scan(io.BytesIO(bytes(broken)), len(broken), 0, len(broken))] == records[:1] + records[2:]


def write(df, path, **options):
    df.write.format("landed_records").options(path=str(path), **options).mode("append").save()


def read(spark, path, **options):
    return spark.read.format("landed_records").options(path=str(path), **options).load()


def test_table_of_records_and_rotation(source, tmp_path):
    rows = [(bytearray(random.Random(i).randbytes(i * 7 % 300)),) for i in range(400)] + [(None,)]
    d = source.createDataFrame(rows, "record binary").repartition(3)
    write(d, tmp_path / "in", rotateBytes=4000)
    assert len(list((tmp_path / "in").glob("*.rec"))) > 6 and max(p.stat().st_size for p in (tmp_path / "in").glob("*.rec")) <= 4000
    write(d.limit(0), tmp_path / "in")
    found = read(source, tmp_path / "in", splitBytes=700)
    assert sorted(bytes(r.record) for r in found.collect()) == sorted(bytes(r) for (r,) in rows if r is not None)
    assert found.select("file", "place").distinct().count() == 400 and not list((tmp_path / "in" / "_pending").iterdir())
    assert read(source, tmp_path / "none").count() == 0


def run(query, checkpoint, sink=None):
    q = query.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def test_restart_loses_and_repeats_nothing(source, tmp_path):
    """Bounded batches; restarts between batches and after a batch that failed; files that land in between."""
    stream = source.readStream.format("landed_records").options(path=str(tmp_path / "in"), splitBytes=300, maxBytesPerTrigger=900, progressLocation=str(tmp_path / "at")).load()
    seen, sizes, fail = [], [], []

    def take(batch, number):
        if number in fail:
            fail.remove(number)
            raise RuntimeError("lost")
        seen.extend(bytes(r.record) for r in batch.collect())

    want = []
    for k in range(3):
        records = [f"{k}:{i}:".encode() + b"x" * (i % 90) for i in range(60)]
        want += records
        write(source.createDataFrame([(bytearray(r),) for r in records], "record binary").coalesce(1), tmp_path / "in" / f"late{k}", rotateBytes=2000)
        for p in sorted((tmp_path / "in" / f"late{k}").glob("*.rec")):
            p.rename(tmp_path / "in" / f"{k}-{p.name}")
        if k == 1:
            fail.append(len(sizes) + 2)
            with pytest.raises(Exception, match="lost"):
                run(stream, tmp_path / "ck", take)
        sizes += run(stream, tmp_path / "ck", take)
    assert sorted(seen) == sorted(want) and len(sizes) > 9


def test_stream_feeds_decoder_and_detector(source, sf_small, tmp_path):
    packets = with_payload(view(source, sf_small, "packets").where("conn_id % 5 = 0")).withColumns({"tid": F.col("pid"), "uid": F.lit(0), "ip_version": F.lit(4), "truncated": F.lit(0), "payload_len": F.length("payload").cast("long")})
    write(encode(packets).select("record").coalesce(1), tmp_path / "in")
    stream = decode(source.readStream.format("landed_records").option("path", str(tmp_path / "in")).load()).withColumn("event_id", F.col("place"))
    got = []
    q = lifecycle.detect_stream(stream).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    want = detect.detect(decode(read(source, tmp_path / "in")).withColumn("event_id", F.col("place"))).collect()
    key = lambda r: (r.conn_id, r.event_id, r.final_protocol)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == packets.count()


def test_lost_attempts_and_repeated_batches_leave_nothing(tmp_path, monkeypatch):
    """A task dies after its first file, its second attempt is taken over; then the whole batch comes again."""

    class Task:
        partitionId = staticmethod(lambda: 0)

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Task))
    batch = lambda a, b: pa.record_batch({"value": [f"line {i}" for i in range(a, b)]})

    def dying():
        yield batch(0, 30)
        raise RuntimeError("lost")

    options = {"path": str(tmp_path), "as": "lines", "compression": "gzip", "rotatebytes": "100"}
    for again in range(2):
        writer = landed.StreamWriter(options)
        with pytest.raises(RuntimeError):
            writer.write(dying())
        told = writer.write(iter([batch(0, 30), batch(30, 40)]))
        assert told.rows == 40 and told.files > 2
        writer.commit([told, None], 7)
        lines = [x for p in sorted(Path(tmp_path).glob("b*.ndjson.gz")) for x in gzip.decompress(p.read_bytes()).decode().splitlines()]
        assert lines == [f"line {i}" for i in range(40)]
    other = landed.StreamWriter(options)
    other.write(iter([batch(0, 5)]))
    other.abort([], 8)
    assert len(list(Path(tmp_path).glob("b*"))) == told.files and not list((tmp_path / "_pending").iterdir())
    with pytest.raises(ValueError):
        landed.TableWriter({"path": str(tmp_path), "compression": "gzip"})


def test_a_stream_that_fails_in_the_middle_writes_each_row_once(source, tmp_path):
    source.range(0, 3000, 1, 6).selectExpr("cast(id as string) as value").write.parquet(str(tmp_path / "in"))
    flag = tmp_path / "failed"

    def once(batches):
        for b in batches:
            if b.num_rows and not flag.exists() and "2999" in b.column(0).to_pylist():
                flag.write_text("x")
                raise RuntimeError("lost")
            yield b

    def start():
        lines = source.readStream.schema("value string").parquet(str(tmp_path / "in")).mapInArrow(once, "value string")
        q = lines.writeStream.format("landed_records").options(path=str(tmp_path / "out"), rotateBytes="3000", **{"as": "lines"}).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(150)

    with pytest.raises(Exception, match="lost"):
        start()
    start()
    lines = sorted(int(x) for p in (tmp_path / "out").glob("*.ndjson") for x in p.read_text().splitlines())
    assert flag.exists() and lines == list(range(3000))
