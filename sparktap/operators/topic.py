"""Messages of the topic: what the producer writes and how the consumer reads it. Native from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.functions.scalars import basename, direction_name, hex64, protocol_name, request_line

SCHEMA_VERSION = "2"


def ssl_payload(events: DataFrame) -> DataFrame:
    """A TLS-plaintext event in the topic's form."""
    return events.select(
        F.shiftleft(F.col("pid").cast("long"), 16).bitwiseOR(F.col("seq").cast("long").bitwiseAND(F.lit(0xFFFF))).alias("conn_id"), "timestamp_ns", "pid", F.col("comm").alias("process_name"), F.lit("127.0.0.1").alias("src_ip"), F.lit(443).alias("dst_port"),
        F.when(F.col("direction") == "write", "EGRESS").otherwise("INGRESS").alias("direction"), F.lit("HTTPS").alias("protocol"), F.col("data").alias("ssl_content"), "root_pid",
    )


def proc_payload(events: DataFrame) -> DataFrame:
    """A process event in the topic's form; an empty resolved path gives way to the raw one."""
    path = F.coalesce(F.nullif("resolved_path", F.lit("")), "path") if "resolved_path" in events.columns else F.col("path")
    return events.select(F.shiftleft(F.col("pid").cast("long"), 16).bitwiseOR(F.col("timestamp_ns").bitwiseAND(F.lit(0xFFFF))).alias("conn_id"), "timestamp_ns", "pid", "comm", F.lit("0.0.0.0").alias("src_ip"), F.lit("KERNEL").alias("protocol"), "event_type", "bytes_count", path.alias("path"))


#: What http_payload reads of a parsed packet; schemas stay JSON text.
PARSED = (
    "http1 struct<headers: map<string, string>, kind: string, method: string, path: string, query: string, body_len: long, schema: string, status_code: int>, "
    "http2 struct<frames: array<struct<type: string, headers: map<string, string>, data_schema: string>>>, grpc struct<service: string, method: string, message_len: long>, mcp struct<method: string, params: string, result: string>"
)


def http_payload(parsed: DataFrame) -> DataFrame:
    """A parsed packet (the detector's result with timestamp_ns, pid and direction) in the topic's form. The request of
    HTTP/2 is what the first frame of headers says."""
    read = parsed.withColumn("p", F.from_json("parsed", PARSED))
    h1, h2, mcp = F.col("p.http1"), F.col("p.http2"), F.col("p.mcp")
    first = F.get(F.filter(h2["frames"], lambda f: f["type"] == "HEADERS"), F.lit(0))["headers"]
    http1 = F.struct(h1["headers"].alias("headers"), (h1["kind"] == "request").alias("is_request"), (h1["kind"] == "response").alias("is_response"), h1["method"].alias("method"), h1["path"].alias("path"), h1["query"].alias("query"), h1["body_len"].alias("body_len"), h1["schema"].alias("body_schema"), h1["status_code"].alias("status_code"))
    request = F.struct(first[":method"].alias("method"), first[":path"].alias("path"), first[":authority"].alias("authority"), first[":status"].cast("int").alias("status"))
    http2 = F.struct(request.alias("request"), F.transform(h2["frames"], lambda f: F.struct(f["type"].alias("type"), f["data_schema"].alias("data_schema"))).alias("frames"))
    tool = F.struct(mcp["method"].alias("method"), mcp["params"].alias("params_schema"), mcp["result"].alias("result_schema"))
    return read.select(
        "conn_id", "timestamp_ns", "pid", protocol_name(F.col("final_protocol")).alias("protocol"), direction_name(F.col("direction")).alias("direction"),
        F.when(h1.isNotNull(), http1).alias("http1"), F.when(h2.isNotNull(), http2).alias("http2"), F.col("p.grpc").alias("grpc"), F.when(mcp.isNotNull(), tool).alias("mcp"),
    )


def packet_dict(packets: DataFrame) -> DataFrame:
    """Canonical form of a packet: both the number and the text of addresses and ids are there."""
    return packets.select("event_id", hex64(F.col("conn_id")).alias("conn_id_hex"), "conn_id", "timestamp_ns", "pid", F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string")).alias("src"), F.concat("dst_ip", F.lit(":"), F.col("dst_port").cast("string")).alias("dst"), protocol_name(F.col("protocol")).alias("protocol"), "payload_len", "original_len", "truncated")


def envelope(payload: DataFrame, kind: str, agent_key: Column, root_pid: Column | None = None) -> DataFrame:
    """Rows (key, value, headers) for a Kafka sink, or for any table of that shape."""
    head = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    headers = F.array(head("X-Agent-Key", agent_key), head("X-Schema-Version", F.lit(SCHEMA_VERSION)), head("X-Event-Kind", F.lit(kind)), head("X-Root-Pid", (root_pid if root_pid is not None else F.lit(0)).cast("string")))
    return payload.select(F.encode(F.col("conn_id").cast("string"), "UTF-8").alias("key"), F.encode(F.to_json(F.struct("*")), "UTF-8").alias("value"), headers.alias("headers"))


def agent_key(headers: Column) -> Column:
    """The first X-Agent-Key whatever its case, trimmed; null if there is none or it is empty."""
    found = F.filter(headers, lambda h: F.lower(h["key"]) == "x-agent-key")
    return F.nullif(F.trim(F.decode(F.get(found, F.lit(0))["value"], "UTF-8")), F.lit(""))


FIELDS = "conn_id long, timestamp_ns long, pid long, process_name string, src_ip string, dst_port int, protocol string, direction string, ssl_content string, event_type int, comm string, path string, bytes_count long, root_pid long"
#: What a message of the http stream holds; schemas stay JSON text, and of mcp also whether a key is there.
BRANCHES = (
    "http1 struct<headers: map<string, string>, is_request: boolean, is_response: boolean, method: string, path: string, query: string, body_len: long, body_schema: string, status_code: int>, "
    "http2 struct<request: struct<method: string, path: string, authority: string, status: int>, frames: array<struct<type: string, data_schema: string>>>, "
    "grpc struct<service: string, method: string, message_len: long>, mcp map<string, string>"
)
HTTP_COLUMNS = ("host", "query", "status_code", "request_size", "response_size", "request_schema", "response_schema", "grpc_service", "grpc_method", "mcp_method", "mcp_params_schema", "mcp_result_schema")


def http_fields(e: Column) -> dict[str, Column]:
    """method, raw_path and HTTP_COLUMNS of a parsed message, by the first of its http1, http2, grpc and mcp."""
    h1, h2, grpc, mcp = e["http1"], e["http2"], e["grpc"], e["mcp"]
    pick = lambda a=None, b=None, c=None, d=None: F.when(h1.isNotNull(), F.lit(None) if a is None else a).when(h2.isNotNull(), F.lit(None) if b is None else b).when(grpc.isNotNull(), F.lit(None) if c is None else c).when(mcp.isNotNull(), F.lit(None) if d is None else d)
    asked = lambda n: F.when(h1["is_request"], h1[n])
    said = lambda n: F.when(h1["is_response"], h1[n])
    request = h2["request"]
    data = F.filter(h2["frames"], lambda f: (f["type"] == "DATA") & ~F.coalesce(f["data_schema"], F.lit("")).isin("", "{}", "[]"))
    service = F.nullif(grpc["service"], F.lit(""))
    tool = F.when(F.map_contains_key(mcp, "method"), F.coalesce(mcp["method"], F.lit("None"))).otherwise("unknown")
    return {
        "method": pick(asked("method"), request["method"], F.lit("POST"), F.lit("POST")),
        "raw_path": pick(asked("path"), request["path"], F.concat(F.lit("/"), service, F.lit("/"), F.coalesce(grpc["method"], F.lit("None"))), F.concat(F.lit("/mcp/"), tool)),
        "host": pick(F.coalesce(F.nullif(h1["headers"]["host"], F.lit("")), h1["headers"][":authority"]), request["authority"]),
        "query": pick(asked("query")),
        "status_code": pick(said("status_code"), request["status"]),
        "request_size": pick(asked("body_len"), None, grpc["message_len"]),
        "response_size": pick(said("body_len")),
        "request_schema": pick(asked("body_schema")),
        "response_schema": pick(said("body_schema"), F.get(data, F.lit(0))["data_schema"]),
        "grpc_service": pick(None, None, grpc["service"]),
        "grpc_method": pick(None, None, grpc["method"]),
        "mcp_method": pick(None, None, None, mcp["method"]),
        "mcp_params_schema": pick(None, None, None, mcp["params_schema"]),
        "mcp_result_schema": pick(None, None, None, mcp["result_schema"]),
    }


def normalise(messages: DataFrame) -> DataFrame:
    """Flat rows of good messages: without an agent key, or where the value is no JSON object, a message is dropped."""
    read = messages.withColumns({"agent_key": agent_key(F.col("headers")), "text": F.decode("value", "UTF-8")})
    # Parsed once, as the one item of a list, as the parser passes over what follows a value. A field of another type than
    # its own is null.
    read = read.withColumn("v", F.when(F.col("agent_key").isNotNull() & F.ltrim("text").startswith("{"), F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit("]")))))
    # A generator drops the bad ones: a filter would be pushed below, and make and parse each message again for each of its terms.
    good = F.col("v").isNotNull() & F.try_variant_get("v", "$[1]", "variant").isNull()
    read = read.select("agent_key", F.explode(F.when(good, F.array(F.try_variant_get("v", "$[0]", f"struct<{FIELDS}, {BRANCHES}>")))).alias("e"))
    e = lambda n: F.col(f"e.{n}")
    ssl = e("ssl_content")
    line = request_line(F.substring_index(ssl, "\r\n", 1))
    posted = ssl.startswith("POST ") | ssl.startswith("GET ")
    model = ssl.contains('"messages"') | ssl.contains('"model"')
    proc = e("event_type").isNotNull()
    http = http_fields(F.col("e"))
    hosts = F.regexp_extract_all(ssl, F.lit(r"(?is)\r\nhost: (.*?)(?=\r\n|\z)"), F.lit(1))
    http["host"] = F.coalesce(F.when(posted, F.trim(F.try_element_at(hosts, F.lit(-1)))), http["host"])
    return read.select(
        "agent_key", F.coalesce(e("conn_id"), F.lit(0)).alias("conn_id"), F.coalesce(e("timestamp_ns"), F.lit(0)).alias("timestamp_ns"), F.timestamp_micros(F.floor(F.coalesce(e("timestamp_ns"), F.lit(0)) / 1000).cast("long")).alias("occurred_at"), F.coalesce(e("pid"), F.lit(0)).alias("pid"),
        F.coalesce(e("process_name"), F.when(proc & (e("event_type") == 1) & (F.coalesce(e("comm"), F.lit("")) == ""), basename(e("path"))).otherwise(e("comm")), F.lit("")).alias("process_name"),
        F.when(proc, "KERNEL").when(ssl.isNotNull(), "HTTPS").otherwise(F.coalesce(e("protocol"), F.lit(""))).alias("protocol"), F.coalesce(e("direction"), F.lit("")).alias("direction"),
        F.when(posted, line["method"]).when(model, F.coalesce(F.nullif(http["method"], F.lit("")), F.lit("POST"))).otherwise(http["method"]).alias("method"), F.when(posted, line["path"]).otherwise(http["raw_path"]).alias("raw_path"), "e.path", "e.bytes_count",
        *[http[c].alias(c) for c in HTTP_COLUMNS],
    )
