"""Sinks and their registry. Each sink writes one DataFrame; a micro-batch is kept once and fanned out to all."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparktap.functions.scalars import hex64

#: A sink may return what it wrote and what failed, as a dictionary.
Sink = Callable[[DataFrame], dict | None]
_kinds: dict[str, Callable[..., Sink]] = {}


def register(kind: str, make: Callable[..., Sink]) -> None:
    _kinds[kind] = make


def as_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def ndjson(path: str, rows_per_file: int = 1_000_000, compression: str = "gzip") -> Sink:
    """JSON lines in files of bounded size."""
    return lambda df: as_lines(df).write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", compression).text(path)


def stdout(rows: int = 20) -> Sink:
    """The first rows as JSON lines; a look at the data, not a copy of it."""
    return lambda df: print("\n".join(r.value for r in as_lines(df).limit(rows).collect()))


def kafka(servers: str, topic: str) -> Sink:
    """Messages keyed by the connection's 16 hex digits; needs Spark's Kafka connector."""
    keyed = lambda df: df.select(F.substring(hex64(F.col("conn_id")), 3, 16).alias("key"), F.to_json(F.struct("*")).alias("value"))
    return lambda df: keyed(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.compression.type", "lz4").option("kafka.acks", "1").save()


def webhook(url: str, tries: int = 3, wait_s: float = 0.5, most_s: float = 30.0, rows_per_post: int = 500) -> Sink:
    """A POST for each batch of lines, tried again with doubled waits. The sink returns how many lines went out and how
    many failed in the end, which raise nothing."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = failed = 0
        for batch in batches:
            for low in range(0, batch.num_rows, rows_per_post):
                lines = batch.column(0).slice(low, rows_per_post).to_pylist()
                if _posted(url, "\n".join(lines).encode(), tries, wait_s, most_s):
                    sent += len(lines)
                else:
                    failed += len(lines)
        yield pa.RecordBatch.from_pydict({"sent": [sent], "failed": [failed]})

    def sink(df: DataFrame) -> dict:
        found = as_lines(df).mapInArrow(post, "sent long, failed long").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed")).first()
        return {"written": found["sent"] or 0, "failed": found["failed"] or 0}

    return sink


def _posted(url: str, body: bytes, tries: int, pause: float, most_s: float) -> bool:
    for k in range(tries):
        try:
            urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/x-ndjson"}), timeout=10).close()
            return True
        except OSError:
            if k + 1 < tries:
                time.sleep(min(pause, most_s))
                pause *= 2
    return False


def callback(f: Callable[[DataFrame], None]) -> Sink:
    return f


for _name, _make in (("file", ndjson), ("stdout", stdout), ("kafka", kafka), ("webhook", webhook), ("callback", callback)):
    register(_name, _make)


def remove(kind: str) -> bool:
    """Forget a kind of sink; whether there was one."""
    return _kinds.pop(kind, None) is not None


def build(plans: list[dict]) -> tuple[list[tuple[str, Sink]], list[str]]:
    """Sinks of a list of settings, and what was wrong with others: unknown kinds and keys are named. None left: stdout."""
    good, bad = [], []
    for plan in plans:
        kind, rest = plan.get("type"), {k: v for k, v in plan.items() if k != "type"}
        try:
            good.append((kind, _kinds[kind](**rest)))
        except KeyError:
            bad.append(f"unknown sink type {kind!r}")
        except TypeError as e:
            bad.append(f"{kind}: {e}")
    return good or [("stdout", stdout())], bad


def fan_out(df: DataFrame, sinks: list[tuple[str, Sink]], keep: Column | None = None) -> list[dict]:
    """Write to every sink; one that fails doesn't stop the others. Returns what each wrote and what failed, how many rows the
    filter left out and the bytes of the others as JSON lines, all counted in the one pass that keeps the rows."""
    seen = Observation()
    good = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    marked = df.withColumn("__kept", good)
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "true"})) + 1
    counted = marked.observe(seen, F.count_if("__kept").alias("kept"), F.count_if(~F.col("__kept")).alias("filtered"), F.coalesce(F.sum(F.when(F.col("__kept"), size)), F.lit(0)).alias("bytes"))
    rows = counted.where("__kept").drop("__kept").persist()
    try:
        rows.count()
        n, out = seen.get["kept"], []
        for kind, sink in sinks:
            base = {"sink": kind, "error": None, "filtered": seen.get["filtered"]}
            try:
                told = sink(rows) or {"written": n, "failed": 0}
                out.append(base | {"bytes": seen.get["bytes"] if not told["failed"] else None} | told)
            except Exception as e:
                out.append(base | {"error": str(e)[:200], "written": 0, "failed": n, "bytes": 0})
        return out
    finally:
        rows.unpersist()


def prometheus(counters: dict[str, float], kinds: dict[str, str] | None = None) -> str:
    """Text exposition of counters and gauges."""
    kinds = kinds or {}
    return "".join(f"# TYPE {k} {kinds.get(k, 'counter')}\n{k} {json.dumps(v)}\n" for k, v in sorted(counters.items()))
