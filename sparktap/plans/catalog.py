"""Registered queries of the engine's own operators, with the SQL that they are held against.

Names begin with the ids of the operators that they cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktap import schema
from sparktap.functions import scalars as S
from sparktap.operators import connections as C
from sparktap.operators import bodies, capacity, detect, filters, metrics, processes, split, sse, temporal, topic
from sparktap.sources import packets as records_io
from sparktap.session import materialise, ship, temporary_folder
from sparktap.sources import landed, sinks
from sparktap.sources.fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


PORTS = [80, 443, 8080]
NUMBERED = """, numbered AS (
  SELECT *, coalesce(sum(CASE WHEN direction = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS incarnation FROM {0}
), records AS (
  SELECT conn_id, incarnation, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, max(CASE WHEN direction = 3 THEN timestamp_ns END) AS closed_ns,
    count(*) FILTER (direction = 1) AS packets_sent, count(*) FILTER (direction = 2) AS packets_recv,
    sum(CASE WHEN direction = 1 THEN original_len ELSE 0 END)::BIGINT AS bytes_sent, sum(CASE WHEN direction = 2 THEN original_len ELSE 0 END)::BIGINT AS bytes_recv,
    arg_min(pid, timestamp_ns) AS pid
  FROM numbered GROUP BY 1, 2
), full_records AS (
  SELECT *, packets_sent + packets_recv AS packets_total, bytes_sent + bytes_recv AS bytes_total, round((coalesce(closed_ns, last_ns) - first_ns) / 1e6, 3) AS duration_ms, closed_ns IS NULL AS is_open FROM records
) """
ALL_PACKETS = duck("packets") + NUMBERED.format("packets")
ON_PORTS = duck("packets") + ", allowed AS (SELECT * FROM packets WHERE src_port IN (80, 443, 8080) OR dst_port IN (80, 443, 8080))" + NUMBERED.format("allowed")


def records(spark: SparkSession, sf: str) -> DataFrame:
    return C.totals(C.incarnations(view(spark, sf, "packets")), protocol=None)


@query("f1_w4_a1_o1_top_connections", ON_PORTS + "SELECT * FROM full_records ORDER BY bytes_total DESC, conn_id, incarnation LIMIT 10")
def flagship(spark, sf):
    """The busiest lives of connections on allowed ports."""
    allowed = view(spark, sf, "packets").where(filters.allowed(PORTS, "src_port", "dst_port"))
    return C.top_connections(C.totals(C.incarnations(allowed), protocol=None))


@query("a1_p4_d1_connection_records", ALL_PACKETS + "SELECT * FROM full_records")
def _(spark, sf):
    return records(spark, sf)


@query("a3_tracker_stats", ALL_PACKETS + "SELECT count(*) FILTER (is_open) AS active, count(*) AS created, count(*) FILTER (NOT is_open) AS closed FROM full_records")
def _(spark, sf):
    return C.stats(records(spark, sf))


@query("a3a_live_records", ALL_PACKETS + "SELECT conn_id, incarnation, last_ns, packets_total FROM full_records WHERE is_open")
def _(spark, sf):
    return records(spark, sf).where("is_open").select("conn_id", "incarnation", "last_ns", "packets_total")


@query("t3_expired", ALL_PACKETS + ", now AS (SELECT max(timestamp_ns) AS n FROM packets) SELECT conn_id, incarnation, last_ns FROM full_records, now WHERE is_open AND last_ns < n - 3600000000000")
def _(spark, sf):
    packets = view(spark, sf, "packets")
    now = packets.agg(F.max("timestamp_ns")).first()[0] or 0
    return C.expired(records(spark, sf), now, 3_600_000_000_000).select("conn_id", "incarnation", "last_ns")


#: Each life's packets in order, one step of the promotion table after the other.
PROMOTION = ALL_PACKETS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT conn_id, incarnation, protocol, row_number() OVER (PARTITION BY conn_id, incarnation ORDER BY timestamp_ns, event_id) AS k FROM numbered),
  p(conn_id, incarnation, k, protocol) AS (SELECT conn_id, incarnation, k, protocol FROM o WHERE k = 1 UNION ALL
    SELECT o.conn_id, o.incarnation, o.k, CASE WHEN (p.protocol = 0 AND o.protocol BETWEEN 1 AND 8) OR (p.protocol = 6 AND o.protocol IN (7, 8)) OR (p.protocol = 1 AND o.protocol IN (4, 5)) OR (p.protocol = 2 AND o.protocol = 3) THEN o.protocol ELSE p.protocol END
    FROM p JOIN o ON o.conn_id = p.conn_id AND o.incarnation = p.incarnation AND o.k = p.k + 1)
  SELECT conn_id, incarnation, arg_max(protocol, k) AS protocol FROM p GROUP BY 1, 2"""


#: Packet after packet, with the list of all held connections: the least recent first.
PLACES = 32
REPLAY = duck("packets").replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT *, row_number() OVER (ORDER BY timestamp_ns, event_id) AS i FROM packets),
  r(i, held, gone) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL
    SELECT e.i, CASE WHEN e.direction = 3 THEN x.rest ELSE list_append(x.rest, e.conn_id) END, x.gone
    FROM r JOIN e ON e.i = r.i + 1, LATERAL (SELECT NOT list_contains(r.held, e.conn_id) AND len(r.held) >= {PLACES} AS full) f,
      LATERAL (SELECT CASE WHEN f.full THEN r.held[1] END AS gone, CASE WHEN f.full THEN r.held[2:] WHEN list_contains(r.held, e.conn_id)
        THEN list_concat(r.held[:list_position(r.held, e.conn_id) - 1], r.held[list_position(r.held, e.conn_id) + 1:]) ELSE r.held END AS rest) x) """


@query("t2_lru_evictions", REPLAY + """SELECT r.gone AS conn_id, l.timestamp_ns AS last_ns, l.event_id AS last_event_id, e.timestamp_ns AS at_ns, e.event_id AS at_event_id
  FROM r JOIN e ON e.i = r.i JOIN (SELECT r.i, max(e.i) AS last FROM r JOIN e ON e.conn_id = r.gone AND e.i < r.i GROUP BY 1) m ON m.i = r.i JOIN e l ON l.i = m.last""")
def _(spark, sf):
    return capacity.bounded(view(spark, sf, "packets"), PLACES)[0]


@query("o2_lru_order", REPLAY + """SELECT h.conn_id, max(e.timestamp_ns) AS last_ns, arg_max(e.event_id, e.i) AS last_event_id, h.lru_no
  FROM (SELECT unnest(held) AS conn_id, generate_subscripts(held, 1)::BIGINT AS lru_no FROM r WHERE i = (SELECT max(i) FROM r)) h JOIN e USING (conn_id) GROUP BY 1, 4""")
def _(spark, sf):
    return capacity.bounded(view(spark, sf, "packets"), PLACES)[1]


@query("a3_bounded_tracker", REPLAY + """SELECT (SELECT len(held) FROM r ORDER BY i DESC LIMIT 1)::BIGINT AS active, sum(CASE WHEN fresh THEN 1 ELSE 0 END)::BIGINT AS created, count(*) FILTER (direction = 3) AS closed, count(gone) AS evicted
  FROM (SELECT e.direction, r.gone, NOT list_contains(b.held, e.conn_id) AS fresh FROM r JOIN e ON e.i = r.i JOIN r b ON b.i = r.i - 1)""")
def _(spark, sf):
    return capacity.bounded(view(spark, sf, "packets"), PLACES)[2]


@query("t10_promotion", PROMOTION)
def _(spark, sf):
    return C.totals(C.incarnations(view(spark, sf, "packets"))).select("conn_id", "incarnation", "protocol")


@query("w3_first_protocol", duck("packets") + "SELECT event_id, coalesce(first_value(nullif(protocol, 0) IGNORE NULLS) OVER (PARTITION BY conn_id ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), protocol) AS sticky_protocol FROM packets")
def _(spark, sf):
    return C.first_protocol(view(spark, sf, "packets")).select("event_id", "sticky_protocol")


@query("w2_packet_number", duck("packets") + "SELECT event_id, row_number() OVER (PARTITION BY conn_id ORDER BY timestamp_ns, event_id) AS packet_no FROM packets")
def _(spark, sf):
    return C.numbered(view(spark, sf, "packets")).select("event_id", F.col("packet_no").cast("long").alias("packet_no"))


@query("w1_ssl_sequence", duck("ssl_events") + "SELECT pid, seq, row_number() OVER (PARTITION BY pid, direction ORDER BY timestamp_ns) - 1 AS dir_seq FROM ssl_events")
def _(spark, sf):
    w = C.W.partitionBy("pid", "direction").orderBy("timestamp_ns")
    return view(spark, sf, "ssl_events").select("pid", "seq", (F.row_number().over(w) - 1).cast("long").alias("dir_seq"))


@query("j3_packet_with_record", ALL_PACKETS + "SELECT n.event_id, r.packets_total, r.bytes_total FROM numbered n LEFT JOIN full_records r USING (conn_id, incarnation)")
def _(spark, sf):
    packets = C.incarnations(view(spark, sf, "packets"))
    return packets.join(C.totals(packets, protocol=None).select("conn_id", "incarnation", "packets_total", "bytes_total"), ["conn_id", "incarnation"], "left").select("event_id", "packets_total", "bytes_total")


@query("p2_p22_m2_m3_packet_dict", duck("packets") + """SELECT event_id, '0x' || lpad(lower(to_hex(conn_id)), 16, '0') AS conn_id_hex, conn_id, timestamp_ns, pid, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst,
  CASE protocol WHEN 0 THEN 'unknown' WHEN 1 THEN 'HTTP/1.x' WHEN 2 THEN 'HTTP/2' WHEN 3 THEN 'gRPC' WHEN 4 THEN 'WebSocket' WHEN 5 THEN 'MCP' WHEN 6 THEN 'TLS' WHEN 7 THEN 'HTTP/1.x+TLS' ELSE 'HTTP/2+TLS' END AS protocol, payload_len, original_len, truncated FROM packets""")
def _(spark, sf):
    return topic.packet_dict(view(spark, sf, "packets"))


@query("f6_output_filter", duck("packets") + "SELECT event_id FROM packets WHERE protocol IN (1, 2, 6) AND protocol <> 6 AND (src_port IN (80, 443) OR dst_port IN (80, 443)) AND direction IN (1, 2) AND coalesce(payload_len >= 1000, true)")
def _(spark, sf):
    f = filters.OutputFilter.of({"protocols": ["HTTP/1.x", "HTTP2", "TLS"], "drop_tls_only": True, "ports": [80, 443], "directions": ["egress", "INGRESS"], "min_body_bytes": 1000})
    return view(spark, sf, "packets").where(f.column(body="payload_len")).select("event_id")


@query("f2_f4_pid_and_comm", duck("packets") + "SELECT event_id FROM packets WHERE pid IN (1001, 1002, 1003) AND substr(comm, 1, 15) = 'python'")
def _(spark, sf):
    return view(spark, sf, "packets").where(filters.allowed([1001, 1002, 1003, "x"], "pid") & filters.same_comm("comm", "python")).select("event_id")


@query("f13_enum_predicates", duck("packets") + "SELECT event_id, protocol IN (6, 7, 8) AS is_encrypted, protocol IN (1, 2, 3, 7, 8) AS is_http, CASE direction WHEN 2 THEN 'INGRESS' WHEN 3 THEN 'CLOSE' ELSE 'EGRESS' END AS direction FROM packets")
def _(spark, sf):
    return view(spark, sf, "packets").select("event_id", S.is_encrypted(F.col("protocol")).alias("is_encrypted"), S.is_http(F.col("protocol")).alias("is_http"), S.direction_name(F.col("direction")).alias("direction"))


@query("a2_protocol_breakdown", duck("packets") + "SELECT CASE protocol WHEN 0 THEN 'unknown' WHEN 1 THEN 'HTTP/1.x' WHEN 2 THEN 'HTTP/2' WHEN 3 THEN 'gRPC' WHEN 4 THEN 'WebSocket' WHEN 5 THEN 'MCP' WHEN 6 THEN 'TLS' WHEN 7 THEN 'HTTP/1.x+TLS' ELSE 'HTTP/2+TLS' END AS protocol, count(*) AS n FROM packets GROUP BY 1")
def _(spark, sf):
    return metrics.protocol_breakdown(view(spark, sf, "packets"))


@query("a4_counters", duck("packets") + "SELECT count(*) AS events, sum(payload_len)::BIGINT AS bytes_captured, sum(original_len)::BIGINT AS bytes_original, count(*) FILTER (truncated) AS truncated, count(*) FILTER (direction = 3) AS closes FROM packets")
def _(spark, sf):
    return metrics.counters(view(spark, sf, "packets"))


@query("a5_drop_rate", duck("packets") + "SELECT pid, coalesce(count(*) FILTER (truncated) * 100.0 / nullif(count(*) FILTER (truncated) + count(*), 0), 0)::DOUBLE AS drop_rate_pct FROM packets GROUP BY pid")
def _(spark, sf):
    return view(spark, sf, "packets").groupBy("pid").agg(F.count_if("truncated").alias("d"), F.count(F.lit(1)).alias("n")).select("pid", metrics.drop_rate_pct(F.col("d"), F.col("n")).cast("double").alias("drop_rate_pct"))


@query("a8_a9_counter_deltas", duck("packets") + "SELECT event_id, greatest(0, original_len - coalesce(lag(original_len) OVER (PARTITION BY conn_id ORDER BY timestamp_ns, event_id), 0)) AS delta FROM packets")
def _(spark, sf):
    return metrics.deltas(view(spark, sf, "packets"), ["conn_id"], list(C.ORDER), "original_len").select("event_id", "delta")


@query("t9_rates", duck("packets") + "SELECT (timestamp_ns // 10000000000) * 10 AS window_start_s, count(*) AS n, count(*) / 10.0 AS rate FROM packets GROUP BY 1")
def _(spark, sf):
    return metrics.rates(view(spark, sf, "packets"))


@query("a11_process_children", duck("proc_tree") + "SELECT ppid, count(*) AS n_children, min(pid) AS first_child, max(pid) AS last_child FROM proc_tree WHERE ppid > 0 GROUP BY ppid")
def _(spark, sf):
    return processes.children(view(spark, sf, "proc_tree"))


UP = duck("proc_tree").replace("WITH ", "WITH RECURSIVE ", 1) + """, up(pid, anc, depth) AS (SELECT pid, pid, 0 FROM proc_tree UNION ALL SELECT up.pid, t.ppid, up.depth + 1 FROM up JOIN proc_tree t ON up.anc = t.pid WHERE up.depth < {0} AND t.ppid > 0 AND up.anc > 12),
  found AS (SELECT up.pid, coalesce(arg_min(anc, depth) FILTER (anc <= 12), up.pid) AS root_pid FROM up GROUP BY up.pid) """


def _forest(spark, sf):
    tree = view(spark, sf, "proc_tree")
    return tree, tree.where("is_root").select("pid")


@query("g1_j6_root_resolution", UP.format(15) + "SELECT pid, root_pid FROM found")
def _(spark, sf):
    return processes.roots(*_forest(spark, sf))


@query("f5_f14_monitored", UP.format(8) + "SELECT pid FROM found WHERE root_pid <= 12")
def _(spark, sf):
    return processes.monitored(*_forest(spark, sf))


@query("j1_f9_entry_exit_pairs", duck("syscalls") + ", s AS (SELECT *, lag(is_entry) OVER w AS pe, lag(l_partkey) OVER w AS entry_l_partkey FROM syscalls WINDOW w AS (PARTITION BY tid ORDER BY l_orderkey, l_linenumber, l_partkey)) SELECT tid, l_orderkey, l_linenumber, l_partkey, entry_l_partkey FROM s WHERE NOT is_entry AND pe AND ret > 0")
def _(spark, sf):
    pairs = processes.paired(view(spark, sf, "syscalls"), "tid", ["l_orderkey", "l_linenumber", "l_partkey"], ["l_partkey"])
    return pairs.where(filters.syscall_ok("read")).select("tid", "l_orderkey", "l_linenumber", "l_partkey", "entry_l_partkey")


@query("j5_registered_pids", duck("proc_events", "ssl_events") + "SELECT e.event_id FROM proc_events e JOIN (SELECT pid, min(timestamp_ns) AS since FROM ssl_events GROUP BY pid) s USING (pid) WHERE e.timestamp_ns * 1000 >= since // 1000000000")
def _(spark, sf):
    # The two tables' clocks differ by a factor of 10**12.
    ssl = view(spark, sf, "ssl_events").withColumn("timestamp_ns", F.expr("timestamp_ns div 1000000000"))
    return processes.after_first_seen(view(spark, sf, "proc_events").withColumn("timestamp_ns", F.col("timestamp_ns") * 1000), ssl).select("event_id")


@query("j7_resolved_paths", duck("proc_events") + ", o AS (SELECT pid, fd, timestamp_ns, path FROM proc_events WHERE event_type = 3) SELECT w.event_id, w.pid, w.fd, w.timestamp_ns, o.path AS resolved_path FROM (SELECT * FROM proc_events WHERE event_type = 4) w ASOF LEFT JOIN o ON w.pid = o.pid AND w.fd = o.fd AND w.timestamp_ns >= o.timestamp_ns")
def _(spark, sf):
    e = view(spark, sf, "proc_events")
    return processes.resolved_paths(e.where("event_type = 4"), e.where("event_type = 3"))


@query("f9_syscall_success", duck("proc_events") + "SELECT event_id FROM proc_events WHERE (event_type = 3 AND retval >= 0) OR (event_type = 4 AND retval > 0) OR (event_type = 1)")
def _(spark, sf):
    ok = ((F.col("event_type") == 3) & filters.syscall_ok("open", "retval")) | ((F.col("event_type") == 4) & filters.syscall_ok("write", "retval")) | (F.col("event_type") == 1)
    return view(spark, sf, "proc_events").where(ok).select("event_id")


SSE = duck("ssl_events") + """, r AS (SELECT *, contains(data, 'data: [DONE]') OR contains(data, '"finish_reason"') AS fin FROM ssl_events WHERE direction = 'read' AND NOT starts_with(data, 'HTTP/') AND NOT starts_with(data, '{') AND (contains(data, 'data: ') OR contains(data, 'event: '))),
  c AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY pid ORDER BY timestamp_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut, coalesce((timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY pid ORDER BY timestamp_ns, seq) > 2000000000)::INT, 0) AS gap FROM r),
  p AS (SELECT *, cut + GAPS AS part FROM c) SELECT pid, part::BIGINT AS part, count(*) AS n_chunks, string_agg(data, '' ORDER BY timestamp_ns, seq) AS data, bool_or(fin) AS complete FROM p GROUP BY 1, 2"""


@query("t7_f11_sse_reassembly", SSE.replace("GAPS", "0"))
def _(spark, sf):
    return sse.reassemble(view(spark, sf, "ssl_events"))


@query("t8_sse_idle_flush", SSE.replace("GAPS", "sum(gap) OVER (PARTITION BY pid ORDER BY timestamp_ns, seq)"))
def _(spark, sf):
    return sse.reassemble(view(spark, sf, "ssl_events"), sse.IDLE_NS)


@query("p10_ssl_payload", duck("ssl_events") + "SELECT (pid << 16) | (seq & 65535) AS conn_id, timestamp_ns, pid, comm AS process_name, '127.0.0.1' AS src_ip, 443 AS dst_port, CASE direction WHEN 'write' THEN 'EGRESS' ELSE 'INGRESS' END AS direction, 'HTTPS' AS protocol, data AS ssl_content, root_pid FROM ssl_events")
def _(spark, sf):
    return topic.ssl_payload(view(spark, sf, "ssl_events"))


@query("p11_proc_payload", duck("proc_events") + "SELECT (pid << 16) | (timestamp_ns & 65535) AS conn_id, timestamp_ns, pid, comm, '0.0.0.0' AS src_ip, 'KERNEL' AS protocol, event_type, bytes_count, path FROM proc_events")
def _(spark, sf):
    return topic.proc_payload(view(spark, sf, "proc_events"))


def _messages(spark, sf):
    """All streams in one topic; some messages without a key, some with a broken value."""
    ssl = topic.envelope(topic.ssl_payload(view(spark, sf, "ssl_events")), "ssl", F.lit(" key-1 "), F.col("root_pid"))
    proc = topic.envelope(topic.proc_payload(view(spark, sf, "proc_events")), "proc", F.lit("key-2"))
    both = ssl.unionByName(proc).withColumn("n", F.decode("key", "UTF-8").cast("long"))
    lost = F.filter("headers", lambda h: h["key"] != "X-Agent-Key")
    return both.select("key", F.when(F.col("n") % 17 == 0, F.encode(F.lit('{"broken'), "UTF-8")).otherwise(F.col("value")).alias("value"), F.when(F.col("n") % 10 == 0, lost).otherwise(F.col("headers")).alias("headers"))


@query("k4_p12_u1_envelope", duck("ssl_events", "proc_events") + ", t AS (SELECT (pid << 16) | (seq & 65535) AS k, 'ssl' AS kind, root_pid AS r FROM ssl_events UNION ALL SELECT (pid << 16) | (timestamp_ns & 65535), 'proc', 0 FROM proc_events) SELECT CAST(k AS VARCHAR) AS key, kind, CAST(r AS VARCHAR) AS root_pid, '2' AS version FROM t")
def _(spark, sf):
    ssl = topic.envelope(topic.ssl_payload(view(spark, sf, "ssl_events")), "ssl", F.lit("k"), F.col("root_pid"))
    proc = topic.envelope(topic.proc_payload(view(spark, sf, "proc_events")), "proc", F.lit("k"))
    h = lambda i: F.decode(F.col("headers")[i]["value"], "UTF-8")
    return ssl.unionByName(proc).select(F.decode("key", "UTF-8").alias("key"), h(2).alias("kind"), h(3).alias("root_pid"), h(1).alias("version"))


@query("s5_f10_p13_p18_p19_p20_consumer", duck("ssl_events", "proc_events") + """, t AS (
  SELECT 'key-1' AS agent_key, (pid << 16) | (seq & 65535) AS conn_id, timestamp_ns, pid, comm AS process_name, 'HTTPS' AS protocol, CASE direction WHEN 'write' THEN 'EGRESS' ELSE 'INGRESS' END AS direction,
    CASE WHEN contains(data, '"messages"') OR contains(data, '"model"') THEN 'POST' END AS method, CAST(NULL AS VARCHAR) AS raw_path, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS bytes_count FROM ssl_events
  UNION ALL SELECT 'key-2', (pid << 16) | (timestamp_ns & 65535), timestamp_ns, pid, CASE WHEN event_type = 1 AND comm = '' THEN string_split(path, '/')[-1] ELSE comm END, 'KERNEL', '', NULL, NULL, path, bytes_count FROM proc_events)
  SELECT *, timestamp_ns // 1000 AS occurred_us FROM t WHERE conn_id % 10 <> 0 AND conn_id % 17 <> 0""")
def _(spark, sf):
    return topic.normalise(_messages(spark, sf)).withColumn("occurred_us", F.unix_micros("occurred_at")).drop("occurred_at", *topic.HTTP_COLUMNS)


@query("m9_p14_request_lines", "SELECT page_id, 'GET' AS method, '/' || CASE WHEN contains(t, '/') THEN split_part(substr(t, instr(t, '/') + 1), '?', 1) ELSE '' END AS path, nullif(CASE WHEN contains(t, '?') THEN substr(t, instr(t, '?') + 1) ELSE '' END, '') AS query FROM (SELECT page_id, split_part(split_part(url, '#', 1), '//', 2) AS t FROM pages)")
def _(spark, sf):
    r = view(spark, sf, "requests")
    target = F.concat(F.lit("/"), F.when(F.contains("rest", F.lit("/")), F.substring(F.col("rest"), F.instr("rest", "/") + 1, F.length("rest"))).otherwise(""))
    line = S.request_line(F.concat(F.lit("get "), target, F.lit(" HTTP/1.1")))
    return r.select("page_id", line.alias("l")).select("page_id", "l.method", "l.path", F.nullif("l.query", F.lit("")).alias("query"))




@query("m16_format_tokens", "WITH t AS (SELECT url AS s FROM pages UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT c_name FROM customer UNION ALL SELECT CAST(o_orderkey * 1000003 AS VARCHAR) FROM orders UNION ALL SELECT '10.0.' || (c_custkey % 256) || '.1' FROM customer UNION ALL SELECT '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') FROM customer) SELECT token, count(*) AS n FROM (SELECT " + S.format_sql("s") + " AS token FROM t) GROUP BY token")
def _(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    parts = [t("pages").select("url"), t("orders").select("o_orderpriority"), t("customer").select("c_name"), t("orders").select((F.col("o_orderkey") * 1000003).cast("string")), t("customer").select(F.concat(F.lit("10.0."), (F.col("c_custkey") % 256).cast("string"), F.lit(".1"))), t("customer").select(F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("s").groupBy(S.format_token(F.col("s")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("d3_basename", duck("proc_events") + "SELECT event_id, string_split(path, '/')[-1] AS name FROM proc_events")
def _(spark, sf):
    return view(spark, sf, "proc_events").select("event_id", S.basename(F.col("path")).alias("name"))


@query("m4_preview", "SELECT page_id, regexp_replace(substr(url, 1, 40), '[^ -~]', '.', 'gs') AS preview FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", S.preview(F.encode("url", "ISO-8859-1"), 40).alias("preview"))


def _fold_sql(words: list[str]) -> str:
    h = "14695981039346656037::UBIGINT"
    for w in words:
        h = f"((xor({h}, {w}::UBIGINT)::UHUGEINT * 1099511628211) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return h


@query("m5_conn_id", duck("packets") + ", f AS (SELECT event_id, " + _fold_sql(["pid", "conn_id", "src_port", "dst_port", "timestamp_ns"]) + " AS h FROM packets) SELECT event_id, CASE WHEN h > 9223372036854775807 THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS folded FROM f")
def _(spark, sf):
    return view(spark, sf, "packets").select("event_id", S.fold_conn_id([F.col("pid"), F.col("conn_id"), F.col("src_port"), F.col("dst_port"), F.col("timestamp_ns")]).alias("folded"))


@query("x3_form_schema", "SELECT page_id, list_sort(list_distinct([split_part(p, '=', 1) FOR p IN string_split(split_part(split_part(url, '#', 1), '?', 2), '&') IF contains(p, '=')])) AS names FROM pages")
def _(spark, sf):
    body = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.array_sort(F.json_object_keys(S.form_schema(body))).alias("names"))


def _raw(spark, sf):
    p = view(spark, sf, "packets").withColumns({"tid": F.col("pid") + 7, "uid": F.lit(1000), "ip_version": F.lit(4)})
    return records_io.encode(p.withColumns({"payload": F.unhex(F.lit("474554")), "truncated": F.col("truncated").cast("int")}))


@query("s2_p1_m1_decode_records", duck("packets") + "SELECT event_id, timestamp_ns, conn_id, pid, pid + 7 AS tid, src_ip, dst_ip, src_port::BIGINT AS src_port, direction, protocol, comm, truncated, least(payload_len, 3) AS payload_len, original_len FROM packets")
def _(spark, sf):
    return decoded(materialise(_raw(spark, sf).select("event_id", "record"), "records"))


def decoded(records: DataFrame) -> DataFrame:
    return records_io.decode(records).select("event_id", "timestamp_ns", "conn_id", "pid", "tid", "src_ip", "dst_ip", "src_port", "direction", "protocol", "comm", "truncated", "payload_len", "original_len")


@query("b12_kernel_sniff", duck("packets") + "SELECT event_id, CASE WHEN direction = 3 THEN 0 ELSE [1, 1, 1, 6, 2, 2, 4, 5, 5, 1, 0][event_id % 11 + 1] END AS protocol FROM packets")
def _(spark, sf):
    return records_io.with_payload(view(spark, sf, "packets")).select("event_id", "protocol")


@query("t4_t5_b0_b11_detect_and_parse")
def _(spark, sf):
    return detect.detect(records_io.with_payload(view(spark, sf, "packets")))


#: What each of the eleven payloads says by itself; the first sure one of a life stands for the rest of it.
DETECTED = ALL_PACKETS + """, own AS (SELECT *, CASE WHEN direction = 3 THEN 0 ELSE [1, 1, 1, 6, 2, 3, 4, 5, 0, 4, 0][event_id % 11 + 1] END AS p, CASE WHEN direction <> 3 AND event_id % 11 IN (8, 10) THEN 1 ELSE 3 END AS c FROM numbered),
  l AS (SELECT *, first_value(CASE WHEN c = 3 THEN p END IGNORE NULLS) OVER (PARTITION BY conn_id, incarnation ORDER BY timestamp_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latched FROM own),
  f AS (SELECT CASE WHEN direction = 3 THEN p ELSE coalesce(latched, p) END AS p, CASE WHEN direction <> 3 AND latched IS NOT NULL THEN 3 ELSE c END AS confidence FROM l)
  SELECT CASE p WHEN 0 THEN 'unknown' WHEN 1 THEN 'HTTP/1.x' WHEN 2 THEN 'HTTP/2' WHEN 3 THEN 'gRPC' WHEN 4 THEN 'WebSocket' WHEN 5 THEN 'MCP' WHEN 6 THEN 'TLS' END AS protocol, confidence, count(*) AS n FROM f GROUP BY 1, 2"""


@query("t4_p5_detected_protocols", DETECTED)
def _(spark, sf):
    found = detect.detect(records_io.with_payload(view(spark, sf, "packets")))
    return found.groupBy(S.protocol_name(F.col("final_protocol")).alias("protocol"), "confidence").agg(F.count(F.lit(1)).alias("n"))


#: A string of each event, in one of several formats.
VALUE = """CASE event_id % 8 WHEN 0 THEN concat(CAST(user_id AS STRING), '@x.example') WHEN 1 THEN concat('10.0.', CAST(user_id % 256 AS STRING), '.7') WHEN 2 THEN concat('2024-01-', lpad(CAST(user_id % 28 + 1 AS STRING), 2, '0'))
  WHEN 3 THEN concat('1.', CAST(user_id AS STRING), '.0') WHEN 4 THEN concat('https://h.example/', event_type) WHEN 5 THEN concat('0xdead', CAST(1000 + event_id AS STRING)) WHEN 6 THEN upper(substring(event_type, 1, 2)) ELSE event_type END"""


@query("x1_x2_body_schema", "WITH v AS (SELECT *, " + VALUE.replace("STRING", "VARCHAR") + " AS s FROM events), t AS (SELECT *, " + S.format_sql("s") + """ AS token FROM v)
  SELECT event_id, concat('{"root_type": "object", "schema": {"a": "integer", "b": "', token, '", "c": [', CASE WHEN event_id % 7 = 0 THEN '["integer", "string"]' ELSE '"integer"' END, '], "d": {"e": ', CASE event_id % 3 WHEN 0 THEN '"null"' WHEN 1 THEN '"boolean"' ELSE '"number"' END, '}}, "truncated": false}') AS schema FROM t""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("s", F.expr(VALUE))
    n = F.col("event_id").cast("string")
    items = F.when(F.col("event_id") % 7 == 0, F.concat(n, F.lit(', "x"'))).otherwise(F.concat(n, F.lit(", 1")))
    inner = F.when(F.col("event_id") % 3 == 0, "null").when(F.col("event_id") % 3 == 1, "true").otherwise("1.5")
    body = F.concat(F.lit('{"a": '), n, F.lit(', "b": "'), F.col("s"), F.lit('", "c": ['), items, F.lit('], "d": {"e": '), inner, F.lit("}}"))
    return bodies.infer(e.select("event_id", F.encode(body, "UTF-8").alias("body")))


@query("a10_merged_schema", """WITH k AS (SELECT DISTINCT event_type, 'x' || user_id % 5 AS x, 'y' || event_id % 3 AS y FROM events)
  SELECT event_type, '{"n": {' || (SELECT string_agg('"' || y || '": "boolean"', ', ' ORDER BY y) FROM (SELECT DISTINCT y FROM k i WHERE i.event_type = o.event_type)) || '}, ' || (SELECT string_agg('"' || x || '": "integer"', ', ' ORDER BY x) FROM (SELECT DISTINCT x FROM k i WHERE i.event_type = o.event_type)) || '}' AS schema
  FROM (SELECT DISTINCT event_type FROM events) o""")
def _(spark, sf):
    body = F.concat(F.lit('{"x'), (F.col("user_id") % 5).cast("string"), F.lit('": 1, "n": {"y'), (F.col("event_id") % 3).cast("string"), F.lit('": true}}'))
    return bodies.merged_by(spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.encode(body, "UTF-8").alias("body")), "event_type")


def _http_text(spark, sf):
    """A request and a response text of each page."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract("url", "//([^/]*)", 1)
    n = F.col("page_id").cast("string")
    third = (F.col("page_id") % 3).cast("string")
    start = F.when(F.col("page_id") % 4 == 0, "GETS /x HTTP/1.1").otherwise("GET /x HTTP/1.1")
    keep = F.when(F.col("page_id") % 2 == 0, "Close").otherwise("keep-alive")
    request = F.concat(start, F.lit("\r\nHost: "), host, F.lit("\r\nAuthorization: secret\r\nX-Id: "), n, F.lit("\r\nx-id: again\r\nX-P"), third, F.lit(": v\r\nConnection: "), keep, F.lit("\r\n\r\nbody"))
    why = F.element_at(F.array(F.lit("All Fine"), F.lit("OK"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    response = F.concat(F.lit("HTTP/1."), (F.col("page_id") % 2).cast("string"), F.lit(" "), (F.col("page_id") % 5 + 200).cast("string"), F.lit(" "), why, F.lit(" \r\nContent-Length: "), n, F.lit("\r\nSet-Cookie: a="), third, F.lit("\r\nSet-Cookie: b=2\r\n\r\n"))
    return p.select("page_id", request.alias("request"), response.alias("response"))


def _block(c):
    return F.substring_index(F.substring(c, F.instr(c, "\r\n") + 2, F.length(c)), "\r\n\r\n", 1)


@query("m6_m7_m8_m11_p7_request_headers", "SELECT page_id, page_id % 4 <> 0 AS is_request, split_part(split_part(url, '//', 2), '/', 1) AS host, CAST(page_id AS VARCHAR) AS x_id, 'connection,host,x-id,x-p' || page_id % 3 AS names, page_id % 2 <> 0 AS keep_alive FROM pages")
def _(spark, sf):
    r = _http_text(spark, sf)
    named = S.redact(S.headers(_block(F.col("request"))))
    return r.select("page_id", S.is_request(F.col("request")).alias("is_request"), S.header(F.col("request"), "host").alias("host"), named["x-id"].alias("x_id"), F.array_join(F.array_sort(F.map_keys(named)), ",").alias("names"), S.keep_alive(named["connection"]).alias("keep_alive"))


@query("m10_m12_response_lines", "SELECT page_id, 'HTTP/1.' || page_id % 2 AS http_version, CAST(page_id % 5 + 200 AS INT) AS status_code, ['All Fine', 'OK', ''][page_id % 3 + 1] AS reason, page_id AS body_len, 'a=' || page_id % 3 || '; b=2' AS cookies FROM pages")
def _(spark, sf):
    r = _http_text(spark, sf)
    line = S.status_line(F.substring_index("response", "\r\n", 1))
    named = S.headers(_block(F.col("response")))
    return r.select("page_id", line.alias("l"), named.alias("h")).select("page_id", "l.http_version", "l.status_code", "l.reason", S.body_length(F.col("h")["content-length"], F.lit(0).cast("long")).alias("body_len"), F.col("h")["set-cookie"].alias("cookies"))


@query("f12_l1_payload_clip", "SELECT page_id, substr(html, 1, 1000) AS clipped, length(html) > 1000 AS truncated FROM pages")
def _(spark, sf):
    cut, over = filters.clip("html", 1000)
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", cut.alias("clipped"), over.alias("truncated"))


@query("u2_a6_a7_fan_out", duck("packets") + """SELECT sink, count(*) AS written, sum(length('{"event_id":' || event_id || ',"comm":"' || comm || '","original_len":' || original_len || ',"direction":' || direction || '}') + 1)::BIGINT AS bytes, (SELECT count(*) FROM packets WHERE direction = 3) AS filtered
  FROM packets, (VALUES ('plain'), ('packed')) s(sink) WHERE direction <> 3 GROUP BY sink""")
def _(spark, sf):
    """Two sinks write all that is left, one fails; what the files hold stands beside what the counters say."""
    folder = temporary_folder(spark, "fan-out")
    plans = [("plain", sinks.ndjson(f"{folder}/plain", compression="none")), ("packed", sinks.ndjson(f"{folder}/packed")), ("bad", lambda df: 1 / 0)]
    told = {x["sink"]: x for x in sinks.fan_out(view(spark, sf, "packets").select("event_id", "comm", "original_len", "direction"), plans, F.col("direction") != 3)}
    each = [spark.read.text(f"{folder}/{k}").agg(F.count(F.lit(1)).alias("written"), F.sum(F.octet_length("value") + 1).alias("bytes")).select(F.lit(k).alias("sink"), "written", "bytes", F.lit(told[k]["filtered"]).cast("long").alias("filtered")) for k in ("plain", "packed")]
    return each[0].union(each[1])


@query("s3_decode_ssl_records", duck("ssl_events") + "SELECT pid, root_pid, tid, timestamp_ns, seq, direction, comm, seq % 3 = 0 AS truncated, least(strlen(data), 65536) AS data_len, data FROM ssl_events")
def _(spark, sf):
    e = view(spark, sf, "ssl_events").withColumns({"data_len": F.octet_length("data"), "direction": F.when(F.col("direction") == "write", 1).otherwise(2), "truncated": (F.col("seq") % 3 == 0).cast("int"), "data": F.encode("data", "UTF-8")})
    found = records_io.decode_ssl(records_io.encode(e, schema.SSL, schema.SSL_BYTES, "data").select("record"))
    return found.select("pid", "root_pid", "tid", "timestamp_ns", "seq", "direction", "comm", "truncated", "data_len", F.decode("data", "UTF-8").alias("data"))


@query("s4_decode_proc_records", duck("proc_events") + "SELECT event_id, timestamp_ns, pid, pid + 1 AS ppid, event_type, retval, bytes_count, fd AS flags, '10.1.' || pid % 200 || '.' || fd AS dst_addr, 1000 + fd AS dst_port, comm, path FROM proc_events")
def _(spark, sf):
    zero = F.lit(0)
    address = F.concat(F.lit("10.1."), (F.col("pid") % 200).cast("string"), F.lit("."), F.col("fd").cast("string"))
    e = view(spark, sf, "proc_events").withColumns({"root_pid": zero, "ppid": F.col("pid") + 1, "tid": zero, "uid": zero, "flags": F.col("fd"), "dst_addr": address, "src_addr": F.lit("0.0.0.0"), "dst_port": F.col("fd") + 1000, "src_port": zero})
    e = e.withColumn("rest", F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00414243"))))
    found = records_io.decode_proc(records_io.encode(e, schema.PROC, schema.PROC_BYTES, "rest").select("event_id", "record"))
    return found.select("event_id", "timestamp_ns", "pid", "ppid", F.col("event_type").cast("int").alias("event_type"), F.col("retval").cast("int").alias("retval"), "bytes_count", "flags", "dst_addr", "dst_port", "comm", "path")


@query("a4_a3b_event_counters", duck("packets") + """SELECT count(*) AS events, sum(original_len)::BIGINT AS bytes, count(*) FILTER (direction = 3) AS closes, count(*) FILTER (payload_len < original_len) AS malformed, round((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 3) AS uptime_s,
  (SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM (SELECT protocol AS p, count(*) AS n FROM packets GROUP BY 1)) AS by_protocol FROM packets""")
def _(spark, sf):
    found = metrics.event_counters(view(spark, sf, "packets"), F.col("payload_len") < F.col("original_len"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("by_protocol")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("by_protocol", shown)


@query("j2_tuple_lookup", duck("packets") + "SELECT event_id, min(conn_id) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, pid) AS found_conn, row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, pid ORDER BY timestamp_ns, event_id) = 1 AS created FROM packets")
def _(spark, sf):
    return C.by_tuple(view(spark, sf, "packets")).select("event_id", "found_conn", "created")


#: Process events as changes of the tree: event types stand for the three kinds, a third of the pid for its parent.
CHANGES = "SELECT pid, CAST(floor(pid / 3) AS BIGINT) AS ppid, comm, timestamp_ns, CASE event_type WHEN 3 THEN 'exec' WHEN 4 THEN 'exit' ELSE 'register' END AS kind FROM {0}"
TREE = duck("proc_events") + ", e AS (" + CHANGES.format("proc_events") + """), t AS (SELECT CAST(max(timestamp_ns) * 0.9 AS BIGINT) AS now FROM e), c AS (SELECT * FROM e WHERE timestamp_ns <= (SELECT now FROM t)),
  g AS (SELECT pid, max(timestamp_ns) FILTER (kind = 'exec') AS born, min(timestamp_ns) FILTER (kind = 'register') AS registered, max(timestamp_ns) FILTER (kind = 'exit') AS gone, arg_max(ppid, timestamp_ns) FILTER (kind = 'exec') AS ppid, arg_max(comm, timestamp_ns) FILTER (kind = 'exec') AS comm,
    arg_min(comm, timestamp_ns) FILTER (kind = 'register') AS root_comm, coalesce(arg_max(kind, timestamp_ns) FILTER (kind <> 'exec') = 'register', false) AS is_root FROM c GROUP BY pid)
  SELECT pid, CASE WHEN born IS NULL THEN 0 ELSE ppid END AS ppid, CASE WHEN born IS NULL THEN root_comm ELSE comm END AS comm, CASE WHEN gone >= coalesce(born, registered) THEN gone END AS exited_ns, is_root
  FROM g, t WHERE coalesce(born, registered) IS NOT NULL AND NOT coalesce(gone >= coalesce(born, registered) AND gone < now - 20000000, false)"""


@query("t11_t12_process_tree_at", TREE)
def _(spark, sf):
    events = spark.sql(CHANGES.format("{e}"), e=view(spark, sf, "proc_events"))
    now = int((events.agg(F.max("timestamp_ns")).first()[0] or 0) * 0.9 + 0.5)
    return processes.collected(processes.tree_at(events, now), now, 20_000_000)


#: The notes read from the payloads' hex digits; a packet's protocol is as in DETECTED.
PAYLOADS = ", ".join(f"({k}, '{p.hex()}')" for k, p in enumerate(records_io.PAYLOADS))
NOTES = DETECTED.split(",\n  f AS")[0] + """, f AS (SELECT *, event_id % 11 AS k, coalesce(latched, p) AS q FROM l WHERE direction <> 3), pay(k, hex) AS (VALUES """ + PAYLOADS + """),
  b AS (SELECT *, CASE WHEN starts_with(hex, '505249202a20') THEN 48 ELSE 0 END AS skip_hex, max((k = 4 AND q IN (2, 3))::INT) OVER (PARTITION BY conn_id, incarnation ORDER BY timestamp_ns, event_id) = 1 AS prefaced FROM f JOIN pay USING (k)),
  t AS (SELECT *, CASE WHEN q IN (2, 3) AND length(hex) >= skip_hex + 18 AND ('0x' || substr(hex, skip_hex + 7, 2))::INT <= 9 THEN ('0x' || substr(hex, skip_hex + 7, 2))::INT END AS frame_type FROM b),
  n AS (SELECT q <> protocol AS moved, frame_type, frame_type IS NOT NULL AND prefaced AS has_preface, CASE WHEN frame_type IS NOT NULL THEN ('0x' || substr(hex, skip_hex + 11, 8))::BIGINT & 2147483647 END AS stream_id, CASE WHEN q = 3 THEN 'pkg.Svc.M' END AS call,
    CASE WHEN q = 4 AND k <> 9 THEN CASE ('0x' || hex[1:2])::INT & 15 WHEN 0 THEN 'continuation' WHEN 1 THEN 'text' WHEN 2 THEN 'binary' WHEN 8 THEN 'close' WHEN 9 THEN 'ping' WHEN 10 THEN 'pong' END END AS opcode, CASE WHEN q = 4 AND k <> 9 THEN ('0x' || hex[3:4])::INT & 127 END AS payload_len,
    CASE WHEN q = 5 AND k = 7 THEN 'tools/call' END AS tool, CASE WHEN q = 6 THEN CASE WHEN hex[1:2] = '16' THEN 'Handshake' ELSE 'unknown' END END AS record_type FROM (SELECT * REPLACE ([1, 1, 1, 6, 2, 2, 4, 5, 5, 1, 0][k + 1] AS protocol) FROM t))
  SELECT *, count(*) AS n FROM n GROUP BY ALL"""


@query("p5_t5_b8_b9_b13_b14_detection_notes", NOTES)
def _(spark, sf):
    packets = records_io.with_payload(view(spark, sf, "packets"))
    found = detect.with_info(detect.detect(packets, keep=("direction",))).where("direction <> 3")
    i = lambda n: F.col(f"info.{n}")
    rows = found.select(
        F.coalesce(i("was_upgraded"), F.lit(False)).alias("moved"), i("http2.frame_type").alias("frame_type"), F.coalesce(i("http2.has_preface"), F.lit(False)).alias("has_preface"), i("http2.stream_id").alias("stream_id"), F.concat(i("grpc.service"), F.lit("."), i("grpc.method")).alias("call"),
        i("websocket.opcode_name").alias("opcode"), i("websocket.payload_len").alias("payload_len"), i("mcp.method").alias("tool"), i("tls.record_type").alias("record_type"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("u1_p14_p16_p17_http_stream", duck("packets") + """, p AS (SELECT *, CASE WHEN direction = 3 THEN -1 ELSE event_id % 11 END AS k FROM packets)
  SELECT conn_id * 11 + event_id % 11 AS conn_id, timestamp_ns, pid, CASE direction WHEN 2 THEN 'INGRESS' WHEN 3 THEN 'CLOSE' ELSE 'EGRESS' END AS direction, CASE k WHEN 0 THEN 'HTTP/1.x' WHEN 1 THEN 'HTTP/1.x' WHEN 2 THEN 'HTTP/1.x' WHEN 3 THEN 'TLS' WHEN 4 THEN 'HTTP/2' WHEN 5 THEN 'gRPC' WHEN 6 THEN 'WebSocket' WHEN 7 THEN 'MCP' WHEN 9 THEN 'WebSocket' ELSE 'unknown' END AS protocol,
    CASE WHEN k = 0 THEN 'PUT' WHEN k IN (1, 5, 7) THEN 'POST' END AS method, CASE k WHEN 0 THEN '/p' || event_id % 50 WHEN 1 THEN '/u' WHEN 5 THEN '/pkg.Svc/M' WHEN 7 THEN '/mcp/tools/call' END AS raw_path, CASE WHEN k = 0 THEN 'h' || pid END AS host, CASE WHEN k = 0 THEN 'x=' || conn_id END AS query,
    CASE k WHEN 0 THEN pid WHEN 1 THEN 18 END AS request_size, CASE k WHEN 2 THEN 5 END AS response_size, CASE k WHEN 2 THEN 200 END AS status_code, CASE k WHEN 5 THEN 'pkg.Svc' END AS grpc_service, CASE k WHEN 7 THEN 'tools/call' END AS mcp_method FROM p""")
def _(spark, sf):
    """Packets, each kind of payload in a connection of its own, through the detector and the topic to the consumer."""
    text = lambda c: F.col(c).cast("string")
    put = F.concat(F.lit("PUT /p"), (F.col("event_id") % 50).cast("string"), F.lit("?x="), text("conn_id"), F.lit(" HTTP/1.1\r\nHost: h"), text("pid"), F.lit("\r\nContent-Length: "), text("pid"), F.lit("\r\n\r\n"))
    packets = records_io.with_payload(view(spark, sf, "packets")).withColumn("payload", F.when((F.col("event_id") % 11 == 0) & (F.col("direction") != 3), F.encode(put, "UTF-8")).otherwise(F.col("payload")))
    own = packets.withColumn("conn_id", F.col("conn_id") * 11 + F.col("event_id") % 11)
    payload = topic.http_payload(detect.detect(own, keep=("timestamp_ns", "pid", "direction")))
    shown = ("conn_id", "timestamp_ns", "pid", "direction", "protocol", "method", "raw_path", "host", "query", "request_size", "response_size", "status_code", "grpc_service", "mcp_method")
    return topic.normalise(topic.envelope(payload, "http", F.lit("key-3"))).select(*shown)


MINUTE = 60_000_000_000


@query("j9_correlation_by_root", duck("activity") + f""", h AS (SELECT * FROM activity WHERE kind = 'http'),
  m AS (SELECT h.event_id, o.kind, o.event_id AS other, row_number() OVER (PARTITION BY h.event_id, o.kind ORDER BY abs(o.timestamp_ns - h.timestamp_ns), o.timestamp_ns, o.event_id) AS k
    FROM h JOIN activity o ON o.kind <> 'http' AND o.root_pid = h.root_pid AND o.timestamp_ns BETWEEN h.timestamp_ns - {10 * MINUTE} AND h.timestamp_ns + {30 * MINUTE})
  SELECT h.event_id, h.root_pid, count(m.k) FILTER (m.kind = 'ssl') AS n_ssl, max(other) FILTER (m.kind = 'ssl' AND k = 1) AS nearest_ssl, count(m.k) FILTER (m.kind = 'proc') AS n_proc, max(other) FILTER (m.kind = 'proc' AND k = 1) AS nearest_proc
  FROM h LEFT JOIN m USING (event_id) GROUP BY 1, 2""")
def _(spark, sf):
    a = view(spark, sf, "activity")
    return temporal.correlated(*[a.where(F.col("kind") == k) for k in ("http", "ssl", "proc")], 10 * MINUTE, 30 * MINUTE)


#: Each event walks up the tree as it stood at its time. The events are those of all pids, half a microsecond later.
LIVES = duck("lives").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT pid, ppid, timestamp_ns AS low, lead(timestamp_ns, 1, 9223372036854775807) OVER (PARTITION BY pid ORDER BY timestamp_ns) AS high FROM lives WHERE kind = 'exec'),
  r AS (SELECT pid, kind = 'register' AS is_on, timestamp_ns AS low, lead(timestamp_ns, 1, 9223372036854775807) OVER (PARTITION BY pid ORDER BY timestamp_ns) AS high FROM lives WHERE kind <> 'exec'),
  e AS (SELECT event_id, pid, timestamp_ns + 500 AS t FROM lives),
  up(event_id, t, anc, depth, root) AS (
    SELECT e.event_id, e.t, e.pid, 0, CASE WHEN r.is_on THEN e.pid END FROM e LEFT JOIN r ON r.pid = e.pid AND r.low <= e.t AND r.high > e.t
    UNION ALL
    SELECT up.event_id, up.t, n.ppid, up.depth + 1, CASE WHEN r.is_on THEN n.ppid END
    FROM up JOIN n ON n.pid = up.anc AND n.low <= up.t AND n.high > up.t LEFT JOIN r ON r.pid = n.ppid AND r.low <= up.t AND r.high > up.t
    WHERE up.root IS NULL AND n.ppid > 0 AND up.depth < {0}),
  found AS (SELECT event_id, max(root) AS root FROM up GROUP BY 1) """


def _later(spark, sf):
    lives = view(spark, sf, "lives")
    return lives.select("event_id", "pid", (F.col("timestamp_ns") + 500).alias("timestamp_ns")), lives


@query("g1_j6_roots_over_time", LIVES.format(15) + "SELECT e.event_id, e.pid, e.t AS timestamp_ns, coalesce(root, e.pid) AS root_pid FROM e JOIN found USING (event_id)")
def _(spark, sf):
    return temporal.roots_over_time(*_later(spark, sf))


@query("f5_f14_t11a_captured_over_time", LIVES.format(8) + "SELECT e.event_id, e.pid, e.t AS timestamp_ns FROM e JOIN found USING (event_id) WHERE root IS NOT NULL OR e.t < (SELECT min(timestamp_ns) FROM lives WHERE kind = 'register')")
def _(spark, sf):
    return temporal.captured_over_time(*_later(spark, sf))


@query("j5_t11a_registered_in_time", duck("activity") + """, s AS (SELECT DISTINCT root_pid, timestamp_ns, 1 AS is_on FROM activity WHERE kind = 'ssl' UNION ALL SELECT DISTINCT root_pid, timestamp_ns, 0 FROM activity WHERE kind = 'http' AND event_id % 4 = 3)
  SELECT p.event_id, p.root_pid AS pid, p.timestamp_ns FROM activity p ASOF JOIN s ON p.root_pid = s.root_pid AND p.timestamp_ns >= s.timestamp_ns WHERE p.kind = 'proc' AND s.is_on = 1
  UNION ALL SELECT event_id, root_pid, timestamp_ns FROM activity WHERE kind = 'proc' AND timestamp_ns < (SELECT min(timestamp_ns) FROM activity WHERE kind = 'ssl')""")
def _(spark, sf):
    """TLS events register their pid, some http events end that; process events count while their pid is registered."""
    a = view(spark, sf, "activity").withColumnRenamed("root_pid", "pid")
    lives = temporal.registrations(a.where("kind = 'ssl'"), a.where("kind = 'http' AND event_id % 4 = 3"))
    return temporal.captured_over_time(a.where("kind = 'proc'").select("event_id", "pid", "timestamp_ns"), lives, hops=0)


@query("t9_anchored_rates", duck("packets").replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT timestamp_ns AS t, count(*) AS n FROM packets GROUP BY 1),
  c(t) AS (SELECT min(t) FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t >= c.t + {60 * MINUTE}) FROM c WHERE c.t IS NOT NULL),
  w AS (SELECT t AS start_ns, lead(t) OVER (ORDER BY t) AS end_ns FROM c WHERE t IS NOT NULL),
  s AS (SELECT start_ns, end_ns, (sum(n) + (start_ns = (SELECT min(t) FROM e))::INT)::BIGINT AS n FROM w JOIN e ON e.t >= start_ns AND e.t < end_ns GROUP BY 1, 2)
  SELECT start_ns, end_ns, n, n / ((end_ns - start_ns) / 1e9) AS rate FROM s""")
def _(spark, sf):
    return temporal.anchored_rates(view(spark, sf, "packets"), 60 * MINUTE)


@query("m13_pipelined_messages", duck("pipelines") + """, k AS (SELECT event_id, k, (event_id + k) % 3 AS kind, (event_id + k) % 7 AS size FROM pipelines, range(1, 6) r(k) WHERE k <= n)
  SELECT event_id, (k - 1)::INT AS message_no, CASE kind WHEN 2 THEN 'response' ELSE 'request' END AS kind, CASE kind WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' END AS method,
    CASE WHEN kind < 2 THEN '/e/' || event_id || '/' || k || CASE kind WHEN 1 THEN '?q=1' ELSE '' END END AS target, CASE kind WHEN 2 THEN (200 + event_id % 5)::INT END AS status_code,
    CASE kind WHEN 1 THEN 13 ELSE size END::INT AS body_len, CASE kind WHEN 1 THEN '3\\r\\nabc\\r\\n0\\r\\n\\r\\n' ELSE repeat('x', size::INT) END AS body, true AS whole FROM k""".replace("'3\\r\\nabc\\r\\n0\\r\\n\\r\\n'", "'3' || chr(13) || chr(10) || 'abc' || chr(13) || chr(10) || '0' || chr(13) || chr(10) || chr(13) || chr(10)"))
def _(spark, sf):
    made = view(spark, sf, "pipelines").select("event_id", F.encode("text", "UTF-8").alias("payload"))
    found = split.messages(made).select("event_id", "message_no", "kind", "method", "target", "status_code", "body_len", "body", "whole")
    return found.withColumn("body", F.decode("body", "UTF-8"))


@query("b1_b3_b4_frames", duck("frames") + """, k AS (SELECT event_id, k, (event_id + k * k) % 10 AS t, event_id % 4 AS pad FROM frames, range(1, 6) r(k) WHERE k <= n)
  SELECT event_id, (k - 1)::INT AS frame_no, ['DATA', 'HEADERS', 'PRIORITY', 'RST_STREAM', 'SETTINGS', 'PUSH_PROMISE', 'PING', 'GOAWAY', 'WINDOW_UPDATE', 'CONTINUATION'][t + 1] AS type,
    (CASE t WHEN 0 THEN 5 + pad WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 7 THEN 8 WHEN 8 THEN 4 ELSE pad END)::BIGINT AS length, (event_id % 6)::BIGINT AS flags, event_id % 1000 * 2 + 1 AS stream_id,
    CASE t WHEN 0 THEN event_id % 2 = 1 END AS compressed, CASE t WHEN 0 THEN event_id % 3000 END AS message_len, CASE WHEN t IN (3, 7) THEN event_id % 14 END AS error_code,
    CASE t WHEN 7 THEN event_id % 50 END AS last_stream_id, CASE t WHEN 8 THEN event_id + 1 END AS increment,
    CASE t WHEN 4 THEN coalesce(['HEADER_TABLE_SIZE', 'ENABLE_PUSH', 'MAX_CONCURRENT_STREAMS', 'INITIAL_WINDOW_SIZE', 'MAX_FRAME_SIZE', 'MAX_HEADER_LIST_SIZE'][event_id % 8 + 1], CAST(event_id % 8 + 1 AS VARCHAR)) || '=' || event_id * 3 END AS settings FROM k""")
def _(spark, sf):
    made = view(spark, sf, "frames").select("event_id", F.unhex("digits").alias("payload"))
    told = F.array_join(F.transform("settings", lambda s: F.concat(s["name"], F.lit("="), s["value"].cast("string"))), ",")
    return split.frames(made).withColumn("settings", told).drop("payload", "held")


@query("s1_k2_landed_records", duck("packets") + "SELECT event_id, timestamp_ns, conn_id, pid, src_ip, direction, comm, original_len, octet_length(encode('payload ' || event_id)) AS payload_len FROM packets")
def _(spark, sf):
    """Packets as records in files that rotate by bytes, read again in parts of files."""
    ship(spark)
    spark.dataSource.register(landed.LandedRecords)
    p = view(spark, sf, "packets").withColumns({"tid": F.col("pid") + 7, "uid": F.lit(1000), "ip_version": F.lit(4), "truncated": F.col("truncated").cast("int")})
    p = p.withColumn("payload", F.encode(F.concat(F.lit("payload "), F.col("event_id").cast("string")), "UTF-8")).withColumn("payload_len", F.length("payload").cast("long"))
    folder = temporary_folder(spark, "landed")
    records_io.encode(p).select("record").write.format("landed_records").option("path", folder).option("rotateBytes", 1 << 20).mode("append").save()
    found = records_io.decode(spark.read.format("landed_records").option("path", folder).option("splitBytes", 1 << 18).load())
    number = F.split(F.decode("payload", "UTF-8"), " ")[1].cast("long")
    return found.select(number.alias("event_id"), "timestamp_ns", "conn_id", "pid", "src_ip", "direction", "comm", "original_len", "payload_len")


@query("f3_inet_only", duck("packets") + "SELECT event_id FROM packets WHERE event_id % 7 IN (1, 2, 3, 5, 6)")
def _(spark, sf):
    family = F.when(F.col("event_id") % 7 == 0, 10).when(F.col("event_id") % 7 == 4, None).otherwise(2)
    return view(spark, sf, "packets").withColumn("family", family).where(filters.inet_only()).select("event_id")


@query("p3_payload_hex", """WITH h AS (SELECT conv_id, turn, coalesce(lower(hex(encode(text))), '') AS payload_hex FROM conversations)
  SELECT conv_id, turn, payload_hex, coalesce(array_to_string([CASE WHEN x BETWEEN '20' AND '7e' THEN chr(('0x' || x)::INT) ELSE '.' END FOR x IN regexp_extract_all(payload_hex[:256], '..')], ''), '') AS payload_preview FROM h""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in S.payload_fields(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), include_payload=True).items()])


@query("f6_f6a_length_and_errors", duck("packets") + """SELECT event_id FROM packets WHERE event_id % 11 <> 0
  AND NOT (CASE WHEN protocol IN (1, 7) THEN payload_len < 1000 WHEN protocol = 3 AND event_id % 2 = 0 THEN original_len < 1000 ELSE false END)""")
def _(spark, sf):
    p = view(spark, sf, "packets").withColumns({
        "http_len": F.when(F.col("protocol").isin(1, 7), F.col("payload_len")), "grpc_len": F.when((F.col("protocol") == 3) & (F.col("event_id") % 2 == 0), F.col("original_len")),
        "parse_error": F.when(F.col("event_id") % 11 == 0, "no header end"),
    })
    f = filters.OutputFilter.of({"min_body_bytes": 1000, "drop_parse_errors": True})
    return p.where(f.column(body=("http_len", "grpc_len"), parse_error="parse_error")).select("event_id")


@query("a8_drops_by_cpu", """WITH t AS (SELECT l_orderkey % 10 AS host, l_orderkey AS reading, sum(l_partkey % 1000 + l_orderkey)::BIGINT AS total FROM lineitem GROUP BY 1, 2)
  SELECT host, reading, total, greatest(0, total - coalesce(max(total) OVER (PARTITION BY host ORDER BY reading ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS delta FROM t""")
def _(spark, sf):
    """Line numbers stand for CPUs, orders for readings."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.select((F.col("l_orderkey") % 10).alias("host"), F.col("l_orderkey").alias("reading"), (F.col("l_partkey") % 1000 + F.col("l_orderkey")).alias("drops"))
    return metrics.drops(rows, ["host"], ["reading"])


@query("a11_process_snapshot", duck("proc_tree") + """SELECT n.pid, n.ppid, n.comm, coalesce(array_to_string(c.pids, ','), '') AS children
  FROM proc_tree n LEFT JOIN (SELECT ppid, list(pid ORDER BY pid) AS pids FROM proc_tree GROUP BY 1) c ON c.ppid = n.pid""")
def _(spark, sf):
    nodes = processes.snapshot(view(spark, sf, "proc_tree").select("pid", "ppid", "comm"))
    return nodes.withColumn("children", F.array_join("children", ","))


@query("u3_first_of_each", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def _(spark, sf):
    """The first order of each customer, as of links that lead to the same file the first one stays."""
    return filters.first_of_each(spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", ["o_orderkey"])


#: Content types that rows take in turn; null is one of them.
TYPES = ("application/json", "Application/JSON; charset=utf-8", "application/vnd.api+json", "text/json", "application/ld+json", "text/html", "application/x-www-form-urlencoded", "APPLICATION/X-WWW-FORM-URLENCODED; a=b", "x/application/json", "")


@query("m15_content_types", "WITH t AS (SELECT event_id, CASE WHEN event_id % 11 < 10 THEN [" + ", ".join(f"'{x}'" for x in TYPES) + """][event_id % 11 + 1] END AS kind FROM events)
  SELECT event_id, coalesce(regexp_matches(lower(kind), '^(application/json|application/vnd\\.|text/json|application/ld\\+json)'), false) AS is_json, coalesce(contains(lower(kind), 'application/x-www-form-urlencoded'), false) AS is_form FROM t""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_id") % 11 < 10, F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 11).cast("int") + 1))
    no = F.lit(False)
    return e.select("event_id", F.coalesce(S.is_json_type(kind), no).alias("is_json"), F.coalesce(S.is_form_type(kind), no).alias("is_form"))
