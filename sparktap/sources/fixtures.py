"""Captured records derived from the test tables, the same in Spark and in DuckDB.

Each view is one SQL text over the tables; MICROS() is the only word that the engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Up to five HTTP/1 messages in a text, by place: requests with a declared length, chunked ones and responses.
_BODY = "repeat('x', CAST((event_id + {k}) % 7 AS INT))"
_MESSAGE = (
    "CASE WHEN event_id % 5 + 1 >= {k} THEN CASE (event_id + {k}) % 3 "
    "WHEN 0 THEN concat('POST /e/', CAST(event_id AS STRING), '/{k} HTTP/1.1', CRLF, 'Content-Length: ', CAST((event_id + {k}) % 7 AS STRING), CRLF, CRLF, " + _BODY + ") "
    "WHEN 1 THEN concat('GET /e/', CAST(event_id AS STRING), '/{k}?q=1 HTTP/1.1', CRLF, 'Host: h', CRLF, 'Transfer-Encoding: Chunked', CRLF, CRLF, '3', CRLF, 'abc', CRLF, '0', CRLF, CRLF) "
    "ELSE concat('HTTP/1.1 ', CAST(200 + event_id % 5 AS STRING), ' OK', CRLF, 'content-length: ', CAST((event_id + {k}) % 7 AS STRING), CRLF, CRLF, " + _BODY + ") END ELSE '' END"
)
#: Up to five HTTP/2 frames in hexadecimal digits, by place: the type follows from id and place, the body from the type.
_HEX = "lpad(hex(CAST({x} AS BIGINT)), {n}, '0')"
_TYPE = "(event_id + {k} * {k}) % 10"
_FRAME_BODY = (
    "CASE " + _TYPE + " WHEN 0 THEN concat('0', CAST(event_id % 2 AS STRING), " + _HEX.format(x="event_id % 3000", n=8) + ", repeat('ab', CAST(event_id % 4 AS INT))) "
    "WHEN 3 THEN " + _HEX.format(x="event_id % 14", n=8) + " WHEN 4 THEN concat(" + _HEX.format(x="event_id % 8 + 1", n=4) + ", " + _HEX.format(x="event_id * 3", n=8) + ") "
    "WHEN 7 THEN concat(" + _HEX.format(x="event_id % 50", n=8) + ", " + _HEX.format(x="event_id % 14", n=8) + ") WHEN 8 THEN " + _HEX.format(x="event_id + 1", n=8) + " ELSE repeat('00', CAST(event_id % 4 AS INT)) END"
)
_FRAME = (
    "CASE WHEN event_id % 5 + 1 >= {k} THEN concat(lpad(hex(CAST(length(" + _FRAME_BODY + ") / 2 AS BIGINT)), 6, '0'), " + _HEX.format(x=_TYPE, n=2) + ", " + _HEX.format(x="event_id % 6", n=2) + ", " + _HEX.format(x="event_id % 1000 * 2 + 1", n=8) + ", " + _FRAME_BODY + ") ELSE '' END"
)
_places = lambda text: ", ".join(text.replace("{k}", str(k)) for k in range(1, 6))

VIEWS = {
    "pipelines": f"""
        SELECT event_id, event_id % 5 + 1 AS n, concat({_places(_MESSAGE).replace("CRLF", "chr(13), chr(10)")}) AS text FROM events""",
    "frames": f"""
        SELECT event_id, event_id % 5 + 1 AS n, concat(CASE WHEN event_id % 4 = 0 THEN '505249202a20485454502f322e300d0a0d0a534d0d0a0d0a' ELSE '' END, {_places(_FRAME)}) AS digits FROM events""",
    "packets": """
        SELECT event_id, user_id AS conn_id, MICROS(ts) * 1000 AS timestamp_ns, 1000 + user_id % 20 AS pid,
          CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 2 ELSE 1 END AS direction,
          CAST(event_id % 9 AS INT) AS protocol,
          CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS original_len,
          CASE WHEN event_type = 'error' THEN 0 ELSE least(CAST(round(value * 100) AS BIGINT), 4096) END AS payload_len,
          event_type <> 'error' AND CAST(round(value * 100) AS BIGINT) > 4096 AS truncated,
          CAST(40000 + user_id % 1000 AS INT) AS src_port,
          CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 3000 ELSE 5432 END AS dst_port,
          concat('10.0.', CAST(user_id % 200 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS src_ip, '192.168.1.9' AS dst_ip,
          CASE user_id % 3 WHEN 0 THEN 'curl' WHEN 1 THEN 'python' ELSE 'node' END AS comm
        FROM events""",
    "requests": """
        SELECT page_id, url, split_part(split_part(url, '#', 1), '//', 2) AS rest FROM pages""",
    "ssl_events": """
        SELECT conv_id AS pid, conv_id AS root_pid, conv_id AS tid, 0 AS uid, turn AS seq, (conv_id * 1000 + turn) * 1000000000 AS timestamp_ns,
          CASE role WHEN 'assistant' THEN 'read' ELSE 'write' END AS direction, 'python' AS comm,
          CASE role WHEN 'assistant' THEN concat('data: ', text, CASE WHEN turn = max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) THEN 'data: [DONE]' ELSE '' END) ELSE text END AS data
        FROM conversations""",
    "proc_tree": """
        SELECT c_custkey + 1 AS pid, CAST(floor((c_custkey + 1) / 3) AS BIGINT) AS ppid, c_custkey + 1 <= 12 AS is_root, c_name AS comm FROM customer""",
    "proc_events": """
        SELECT o_orderkey AS event_id, o_custkey + 1 AS pid, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 4 ELSE 1 END AS event_type,
          CAST(floor(o_totalprice) AS BIGINT) AS bytes_count, o_orderkey % 7 AS fd, o_orderkey * 1000 AS timestamp_ns, CAST(o_orderkey % 4 - 1 AS INT) AS retval,
          concat('/usr/lib/', o_orderpriority) AS path, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('w', CAST(o_custkey % 7 AS STRING)) END AS comm
        FROM orders""",
    "activity": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'ssl' ELSE 'proc' END AS kind,
          CASE WHEN event_id % 2 = 0 THEN 1 ELSE user_id % 40 + 2 END AS root_pid, MICROS(ts) * 1000 AS timestamp_ns
        FROM events""",
    "lives": """
        SELECT o_orderkey AS event_id, o_custkey + 1 AS pid, o_orderkey * 1000 AS timestamp_ns,
          CASE WHEN o_orderkey % 13 = 0 THEN 'register' WHEN o_orderkey % 13 = 1 THEN 'exit' WHEN o_orderkey % 13 = 2 THEN 'deregister' ELSE 'exec' END AS kind,
          CAST(CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey * 7) % 1000 + 1 ELSE floor((o_custkey + 1) / 3) END AS BIGINT) AS ppid
        FROM orders""",
    "syscalls": """
        SELECT l_suppkey AS tid, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS ts, l_orderkey, l_linenumber, l_partkey,
          l_linenumber % 2 = 1 AS is_entry, CAST(l_partkey % 9 AS INT) - 1 AS ret
        FROM lineitem""",
}


def tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"MICROS\((\w+)\)", r"unix_micros(cast(\1 as timestamp))", VIEWS[name])
    source = re.search(r"FROM (\w+)\s*$", sql)[1]
    return spark.sql(re.sub(r"FROM (\w+)\s*$", r"FROM {\1}", sql), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def duck(*names: str) -> str:
    """The views as a WITH clause for DuckDB."""
    fixed = lambda s: re.sub(r"MICROS\((\w+)\)", r"epoch_us(\1)", s).replace("AS STRING", "AS VARCHAR")
    return "WITH " + ", ".join(f"{n} AS ({fixed(VIEWS[n])})" for n in names) + " "
