import random

import pytest
from pyspark.sql import functions as F

from sparktap.operators import processes, temporal
from sparktap.streaming import stateful

LAST = 1 << 62


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def pairs_of(rows):
    return sorted((r.event_id, r.right_event_id) for r in rows)


def made(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, rng.randrange(-300, 300) * 1000 + rng.randrange(3)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, root_pid long, timestamp_ns long")


@pytest.mark.parametrize("before,after", [(40_000, 7_001), (0, 0), (0, 5000)])
def test_interval_join_equals_all_pairs(spark, before, after):
    (a, da), (b, db) = made(spark, 150, 1), made(spark, 150, 2)
    want = [(i, j) for i, k, t in a for j, m, u in b if k == m and None not in (k, t, u) and -before <= u - t <= after]
    assert pairs_of(temporal.correlate(da, db, before, after).collect()) == sorted(want)
    assert temporal.correlate(da.limit(0), db, before, after).count() == 0


@pytest.mark.parametrize("before,after", [(40_000, 7_001), (0, 0), (-3000, 20_000), (20_000, -3000)])
def test_numbers_and_nearest_ones_are_those_of_all_pairs(spark, before, after):
    """Equal times, repeated and null ids among them; and no two rows of events meet in a join."""
    (a, da), (b, db), (c, dc) = (made(spark, 150, k) for k in (1, 2, 3))
    a, b = a + [(3, 1, 5000), (3, 2, 9000), (None, 1, 5000), (900, 1, 5000)], b + [(None, 1, 5000), (77, 1, 5000), (76, 1, 5000), (75, 1, 5000 + after), (74, 1, 5000 - before)]
    da, db = (spark.createDataFrame(x, da.schema) for x in (a, b))
    want = []
    for i, k, _ in a:
        row = [i, k]
        for others in (b, c):
            near = [(abs(u - t), u, j is None, j) for i2, k2, t in a if i2 == i and i is not None for j, m, u in others if k2 == m and None not in (k2, t, u) and -before <= u - t <= after]
            row += [len(near), min(near)[3] if near else None]
        want.append(tuple(row))
    got = temporal.correlated(da, db, dc, before, after)
    assert bag(got) == sorted(map(repr, want))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def stream_of(spark, df, tmp_path, name, parts=3):
    for k in range(parts):
        df.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == k).coalesce(1).write.parquet(str(tmp_path / name / f"{k:02d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def drained(query, name, tmp_path, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    return query.sparkSession.table(name)


def test_interval_join_of_streams_equals_batch(spark, tmp_path):
    """Rows of all times come in each batch, so the late ones of one batch meet those of others."""
    # Spark's watermark begins at 1970, so times before that are late.
    da, db = (made(spark, 80, k)[1].withColumn("timestamp_ns", F.col("timestamp_ns") + 10**9) for k in (3, 4))
    got = temporal.correlate_streams(stream_of(spark, da, tmp_path, "a"), stream_of(spark, db, tmp_path, "b"), 40_000, 7_001, late="1 hour")
    assert pairs_of(drained(got, "pairs", tmp_path).collect()) == pairs_of(temporal.correlate(da, db, 40_000, 7_001).collect())


def walk(lives, pid, t, hops):
    """The nearest root above a pid at a time, by following the tree as it stood."""
    for _ in range(hops + 1):
        on = [(u, k not in ("exit", "deregister"), k) for p, u, k, _ in lives if p == pid and u <= t and k != "exec"]
        if on:
            last = max(u for u, _, _ in on)
            if all(is_on for u, is_on, _ in on if u == last):
                return pid
        nodes = [(u, q) for p, u, k, q in lives if p == pid and u <= t and k == "exec"]
        if not nodes or not max(nodes)[1] > 0:
            return None
        pid = max(nodes)[1]
    return None


@pytest.mark.parametrize("hops", [0, 3, 16])
def test_ancestry_over_time_equals_a_walk(spark, hops):
    rng = random.Random(hops)
    lives = [(rng.randrange(1, 14), rng.randrange(60), rng.choice(["exec"] * 6 + ["register", "exit", "deregister"]), rng.randrange(0, 16)) for _ in range(160)]
    lives = list({(p, u, k == "exec"): (p, u, k, q) for p, u, k, q in lives}.values())  # one of each at a time
    asked = [(i, rng.randrange(1, 18), rng.randrange(-2, 62)) for i in range(200)]
    d = spark.createDataFrame(lives, "pid long, timestamp_ns long, kind string, ppid long")
    e = spark.createDataFrame(asked, "event_id long, pid long, timestamp_ns long")
    got = {r.event_id: r.root_pid for r in temporal.roots_over_time(e, d, hops or 1).collect()}
    assert got == {i: walk(lives, p, t, (hops or 1) - 1) or p for i, p, t in asked}
    since = min(u for _, u, k, _ in lives if k == "register")
    kept = {r.event_id for r in temporal.captured_over_time(e, d, hops).collect()}
    assert kept == {i for i, p, t in asked if walk(lives, p, t, hops) is not None or t < since}
    assert temporal.captured_over_time(e, d.where("kind = 'exec'"), hops).count() == len(asked)


def loop_rates(times, width):
    out, start, n = [], None, 0
    for t in sorted(times):
        start = t if start is None else start
        n += 1
        if t - start >= width:
            out.append((start, t, n, n / ((t - start) / 1e9)))
            start, n = t, 0
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_anchored_rates_equal_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(temporal, "GROUP", 4)
    rng = random.Random(seed)
    times = [rng.choice([rng.randrange(-500, 500), rng.randrange(100), 7, 40, 90_000 + rng.randrange(20)]) for _ in range(250)]
    d = spark.createDataFrame([(t, "x") for t in times] + [(None, "x")], "timestamp_ns long, b string")
    got = sorted((r.start_ns, r.end_ns, r.n, r.rate) for r in temporal.anchored_rates(d, 10).collect())
    want = loop_rates(times, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 * w[3] for g, w in zip(got, want))
    assert temporal.anchored_rates(d.limit(0), 10).count() == 0
    assert temporal.anchored_rates(d.where("timestamp_ns = 7"), 10).count() == 0


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


MS = 1_000_000


def test_stream_of_registered_events_equals_batch(timers, tmp_path):
    """Registrations come after the events that they cover, and others before; a row behind the watermark ends the stream."""
    spark, rng = timers, random.Random(5)
    rows = [(i, rng.randrange(1, 6), rng.randrange(1, 4000) * MS + rng.randrange(2), rng.choice(["event"] * 4 + ["register", "exit", "deregister"])) for i in range(300)]
    rows += [(999, 77, LAST // 1000, "event")]
    d = spark.createDataFrame(rows, "event_id long, pid long, timestamp_ns long, kind string").coalesce(1)
    first, rest = d.where("event_id < 999"), d.where("event_id = 999")
    for k in range(3):
        first.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    rest.write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drained(stateful.registered_events(stream, "1 hour"), "registered", tmp_path)
    lives = first.where("kind <> 'event'").withColumn("ppid", F.lit(None).cast("long"))
    since = lives.where("kind = 'register'").agg(F.min("timestamp_ns")).first()[0]
    want = temporal.captured_over_time(first.where("kind = 'event'").select("event_id", "pid", "timestamp_ns"), lives, 0).where(F.col("timestamp_ns") >= since)
    assert bag(got.select("event_id", "pid", "timestamp_ns")) == bag(want.select("event_id", "pid", "timestamp_ns")) and want.count() > 20


def test_stream_of_the_process_table_equals_batch_after_a_restart(timers, tmp_path):
    spark, rng = timers, random.Random(6)
    rows = [(i, rng.randrange(1, 25), rng.randrange(5), rng.choice("abc"), rng.randrange(1, 3000) * MS, rng.choice(["exec", "exec", "exit", "register"])) for i in range(120)]
    last = [(999, 99, 1, "z", 5000 * MS, "exec")]
    d = spark.createDataFrame(rows + last, "event_id long, pid long, ppid long, comm string, timestamp_ns long, kind string")
    seen = {}
    for k in range(3):
        # Each run reads what is new and goes on from the checkpoint.
        part = d.where(F.col("event_id") % 2 == k) if k < 2 else d.where("event_id = 999")
        part.where("event_id < 999" if k < 2 else "true").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        stream = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = stateful.process_table(stream, 1000 * MS, "1 hour" if k < 2 else "1 second")
        out = []
        q = query.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(150)
        for r in out:
            seen[r.pid] = r
    now = 4999 * MS
    nodes = processes.tree_at(d, 5000 * MS)
    want = {tuple(r) for r in processes.collected(nodes, now, 1000 * MS).collect()}
    assert {tuple(r)[:5] for r in seen.values() if not r.collected} == want
    assert any(r.collected for r in seen.values())
