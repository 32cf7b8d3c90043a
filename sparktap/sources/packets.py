"""Binary packet records: decoding by native expressions, and their encoding for tests and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap import schema
from sparktap.functions import scalars as S

#: Payloads that stand for the cases of each protocol; a fixture's packet takes one by its number.
PAYLOADS = (
    b"GET /a?x=1 HTTP/1.1\r\nHost: h\r\nConnection: close\r\n\r\n",
    b'POST /u HTTP/1.1\r\nContent-Type: application/json\r\nContent-Length: 18\r\n\r\n{"email":"a@b.co"}',
    b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n",
    b"\x16\x03\x01\x00\x05\x01\x00\x00\x01\x03",
    b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n\x00\x00\x06\x04\x00\x00\x00\x00\x00\x00\x03\x00\x00\x00\x64",
    b"\x00\x00\x12\x01\x04\x00\x00\x00\x01\x00\x05:path\x0a/pkg.Svc/M",
    b"\x81\x85\x01\x02\x03\x04igohn",
    b'{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"x"}}',
    b'{"jsonrpc":"2.0","id":1,"method":"eth_call"}',
    b"GET /chat HTTP/1.1\r\nUpgrade: websocket\r\n\r\n",
    b"a=1&b=2",
)


def with_payload(packets: DataFrame, number: str = "event_id") -> DataFrame:
    """Fixture packets with a payload each, and the kernel's guess from its first bytes."""
    made = F.array(*[F.unhex(F.lit(p.hex())) for p in PAYLOADS])
    out = packets.withColumn("payload", F.when(F.col("direction") == 3, F.lit(b"")).otherwise(F.get(made, F.pmod(F.col(number), F.lit(len(PAYLOADS))).cast("int"))))
    return out.withColumn("protocol", S.kernel_sniff(F.col("payload")))


def encode(rows: DataFrame, layout: tuple = schema.PACKET, size: int = schema.HEADER_BYTES, rest: str = "payload") -> DataFrame:
    """Records of a header and what follows it (a binary column), from columns named as in the layout."""

    def field(name: str, n: int, kind: str) -> Column:
        if kind == "text":
            return F.rpad(F.hex(F.encode(F.substring(F.col(name), 1, n - 1), "UTF-8")), 2 * n, "0")
        if kind == "ip":
            return F.concat(*[F.lpad(F.hex(F.split(F.col(name), r"\.")[i].cast("int")), 2, "0") for i in range(4)])
        wide = F.lpad(F.hex(F.col(name).cast("long")), 16, "0")
        return F.concat(*[F.substring(wide, 15 - 2 * i, 2) for i in range(n)])

    parts, at = [], 0
    for name, offset, n, kind in layout:
        parts.append(F.lit("00" * (offset - at)))
        parts.append(field(name, n, kind))
        at = offset + n
    parts.append(F.lit("00" * (size - at)))
    return rows.withColumn("record", F.unhex(F.concat(*parts, F.hex(rest))))


def _fields(data: Column, layout: tuple, size: int) -> dict[str, Column]:
    """The header's fields: its hex form is made once, and each number is a turned slice of it."""
    digits = F.hex(F.substring(data, 1, size))
    fields = {}
    for name, offset, n, kind in layout:
        if kind == "text":
            fields[name] = S.clean_text(F.substring(data, offset + 1, n))
            continue
        own = [F.substring(digits, 2 * (offset + i) + 1, 2) for i in range(n)]
        if kind == "ip":
            fields[name] = F.concat_ws(".", *[F.conv(x, 16, 10) for x in own])
            continue
        number = F.conv(F.concat(*own[::-1]), 16, -10 if n == 8 else 10).cast("long")
        fields[name] = F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number) if kind == "i" else number
    return fields


def decode(records: DataFrame, col: str = "record") -> DataFrame:
    """A packet's fields and its payload. A record shorter than a header is dropped; a claimed length beyond what is
    there is clipped to it; unknown enumeration codes become the first one."""
    data = F.col(col)
    fields = _fields(data, schema.PACKET, schema.HEADER_BYTES)
    fields["payload_len"] = F.least(fields["payload_len"], (F.length(data) - schema.HEADER_BYTES).cast("long"))
    fields["direction"] = F.when(fields["direction"].isin(1, 2, 3), fields["direction"]).otherwise(1).cast("int")
    fields["protocol"] = F.when(fields["protocol"] <= 8, fields["protocol"]).otherwise(0).cast("int")
    fields["truncated"] = fields["truncated"] != 0
    good = records.where(F.length(data) >= schema.HEADER_BYTES)
    return good.withColumns(fields).withColumn("payload", F.expr(f"substring({col}, {schema.HEADER_BYTES + 1}, cast(payload_len as int))"))


def decode_ssl(records: DataFrame, col: str = "record") -> DataFrame:
    """A TLS-plaintext event's fields and its data, of 65536 bytes at most. Direction 1 is a write, all others are reads."""
    data = F.col(col)
    fields = _fields(data, schema.SSL, schema.SSL_BYTES)
    fields["data_len"] = F.least(fields["data_len"], F.lit(schema.MAX_PAYLOAD), (F.length(data) - schema.SSL_BYTES).cast("long"))
    fields["direction"] = F.when(fields["direction"] == 1, "write").otherwise("read")
    fields["truncated"] = fields["truncated"] != 0
    good = records.where(F.length(data) >= schema.SSL_BYTES)
    return good.withColumns(fields).withColumn("data", F.expr(f"substring({col}, {schema.SSL_BYTES + 1}, cast(data_len as int))"))


def decode_proc(records: DataFrame, col: str = "record") -> DataFrame:
    """A process event's fields, and its path up to the first NUL."""
    data = F.col(col)
    path = S.clean_text(F.expr(f"substring({col}, {schema.PROC_BYTES + 1})"))
    return records.where(F.length(data) >= schema.PROC_BYTES).withColumns(_fields(data, schema.PROC, schema.PROC_BYTES) | {"path": path})
