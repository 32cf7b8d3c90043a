"""Native column functions: addresses, headers, request and status lines, formats, form schemas. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktap import schema

# --- binary fields -------------------------------------------------------------------------------------------------


def uint_le(data: Column, offset: int, size: int) -> Column:
    """An unsigned little-endian number; 8 bytes give its signed bit pattern."""
    turned = F.concat(*[F.hex(F.substring(data, offset + i + 1, 1)) for i in reversed(range(size))])
    wide = F.conv(turned, 16, -10 if size == 8 else 10)
    return wide.cast("long")


def uint_be(data: Column, offset: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def ipv4(n: Column) -> Column:
    """Dotted form of a number in network order."""
    return F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def hex64(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 16, "0"))


def clean_text(data: Column) -> Column:
    """Text up to the first NUL."""
    return F.substring_index(F.decode(data, "UTF-8"), "\x00", 1)


def preview(data: Column, size: int = 128) -> Column:
    """The first bytes, printable ASCII as it is, others as dots."""
    return F.regexp_replace(F.decode(F.substring(data, 1, size), "ISO-8859-1"), "(?s)[^ -~]", ".")


def payload_fields(data: Column, include_payload: bool = False) -> dict[str, Column]:
    """What a record shows of its payload: a preview, and all of it in hexadecimal digits where that is asked for."""
    return {"payload_preview": preview(data)} | ({"payload_hex": F.lower(F.hex(data))} if include_payload else {})


def direction_name(code: Column) -> Column:
    return F.when(code == 2, "INGRESS").when(code == 3, "CLOSE").otherwise("EGRESS")


def protocol_name(code: Column, names: dict[int, str] | None = None) -> Column:
    names = names or schema.PROTOCOLS
    out = F.lit(names[0])
    for k, v in list(names.items())[1:]:
        out = F.when(code == k, v).otherwise(out)
    return out


def is_encrypted(code: Column) -> Column:
    return code.isin(*schema.ENCRYPTED)


def is_http(code: Column) -> Column:
    return code.isin(*schema.HTTP_KINDS)


def fold_conn_id(words: list[Column]) -> Column:
    """A connection number: five rounds of xor and a multiplication modulo 2**64, exact in decimals."""
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    signed = lambda d: F.when(d >= F.lit(str(1 << 63)).cast("decimal(38,0)"), d - two64).otherwise(d).cast("long")
    unsigned = lambda n: F.when(n < 0, n.cast("decimal(38,0)") + two64).otherwise(n.cast("decimal(38,0)"))
    def step(h: Column, w: Column) -> Column:
        x = unsigned(h.bitwiseXOR(w))
        # 0x100000001B3 = 2**40 + 0x1B3, in two parts that stay within 38 digits.
        part = F.pmod(x, F.lit(str(1 << 24)).cast("decimal(38,0)")).cast("decimal(8,0)") * F.lit(str(1 << 40)).cast("decimal(13,0)")
        return signed(F.pmod((part.cast("decimal(38,0)") + (x.cast("decimal(20,0)") * F.lit(0x1B3).cast("decimal(3,0)")).cast("decimal(38,0)")).cast("decimal(38,0)"), two64))

    return F.aggregate(F.array(*[w.cast("long") for w in words]), F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long"), step)


# --- HTTP/1 ---------------------------------------------------------------------------------------------------------

METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE"


def is_request(text: Column) -> Column:
    return text.rlike(rf"^(?:{METHODS}) ")


def is_response(text: Column, strict: bool = True) -> Column:
    return text.startswith("HTTP/1." if strict else "HTTP/")


def request_line(line: Column) -> Column:
    parts = F.split(line, " ", 3)
    target = F.get(parts, F.lit(1))
    return F.struct(F.upper(F.get(parts, F.lit(0))).alias("method"), F.get(F.split(target, r"\?", 2), F.lit(0)).alias("path"), F.get(F.split(target, r"\?", 2), F.lit(1)).alias("query"), F.get(parts, F.lit(2)).alias("http_version"))


def status_line(line: Column) -> Column:
    parts = F.split(line, " ", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("http_version"), F.get(parts, F.lit(1)).try_cast("int").alias("status_code"), F.trim(F.get(parts, F.lit(2))).alias("reason"))


def header(text: Column, name: str) -> Column:
    """The first value of a header in a raw message, before the empty line; null if there is none."""
    head = F.substring_index(text, "\r\n\r\n", 1)
    return F.nullif(F.regexp_extract(head, rf"(?is)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def headers(block: Column, most: int = 512) -> Column:
    """A header block as a map: names in small letters, the first of equal names stays, set-cookie values are joined."""
    lines = F.filter(F.split(block, "\r\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.substring(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), 1, most).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.when(n == "set-cookie", F.array_join(values(n), "; ")).otherwise(F.get(values(n), F.lit(0))))))


def redact(named: Column, names=("authorization", "cookie", "set-cookie")) -> Column:
    return F.map_filter(named, lambda k, _: ~k.isin(*names))


def keep_alive(connection: Column) -> Column:
    return ~F.contains(F.lower(F.coalesce(connection, F.lit(""))), F.lit("close"))


def body_length(content_length: Column, captured: Column) -> Column:
    return F.coalesce(content_length.try_cast("long"), captured)


def is_json_type(content_type: Column) -> Column:
    return F.lower(content_type).rlike(r"^(?:application/json|application/json-rpc|application/ld\+json|application/vnd\.|text/json)")


def is_form_type(content_type: Column) -> Column:
    return F.lower(content_type).contains("application/x-www-form-urlencoded")


def form_schema(body: Column) -> Column:
    """Names of a form body, each typed as a string; names aren't decoded."""
    names = F.array_distinct(F.transform(F.filter(F.split(body, "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.substring_index(p, "=", 1)))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(names), lambda n: F.struct(n, F.lit("string")))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: The ordered formats of strings; the first whose length and pattern fit is the token.
FORMATS = (
    ("jwt", "length > 20", r"^ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"),
    ("datetime", "length >= 16", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"),
    ("date", "length = 10", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("uuid", "length = 36", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("uri", "length > 7", r"^https?://"),
    ("email", "length > 5 AND length < 254", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("ipv4", "length >= 7 AND length <= 15", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"),
    ("semver", "length < 20", r"^[0-9]+\.[0-9]+\.[0-9]+"),
    ("country-code", "length = 2", r"^[A-Z]{2}$"),
    ("phone", "length >= 7 AND length <= 20", r"^\+?[0-9\s().-]{7,20}$"),
    ("hex", "length > 8", r"(?i)^(0x)?[0-9a-f]+$"),
    ("base64", "length > 32", r"^[A-Za-z0-9+/]{20,}={0,2}$"),
)


def format_token(text: Column) -> Column:
    n = F.char_length(text)
    out = F.lit("string")
    for name, rule, pattern in reversed(FORMATS):
        fits = F.lit(True)
        for part in rule.split(" AND "):
            _, op, k = part.split()
            fits = fits & {">": n > int(k), ">=": n >= int(k), "<": n < int(k), "<=": n <= int(k), "=": n == int(k)}[op]
        out = F.when(fits & text.rlike(pattern), f"string:{name}").otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "string").otherwise(out)


def format_sql(col: str) -> str:
    """The same rule for DuckDB."""
    rows = "".join(f" WHEN {rule.replace('length', f'length({col})')} AND regexp_matches({col}, '{pattern}') THEN 'string:{name}'" for name, rule, pattern in FORMATS)
    return f"CASE WHEN coalesce(length({col}), 0) = 0 THEN 'string'{rows} ELSE 'string' END"


def kernel_sniff(data: Column) -> Column:
    """The protocol code that the first bytes suggest; the first rule that fits."""
    b = lambda i: F.conv(F.hex(F.substring(F.concat(data, F.unhex(F.lit("00" * 8))), i + 1, 1)), 16, 10).cast("int")
    text = F.decode(F.substring(data, 1, 8), "ISO-8859-1")
    n = F.length(data)
    u24 = b(0) * 65536 + b(1) * 256 + b(2)
    rules = (
        (n < 3, schema.UNKNOWN),
        (b(0).between(0x14, 0x17) & (b(1) == 3) & (b(2) <= 4), schema.TLS),
        (text.startswith("PRI * HT"), schema.HTTP2),
        ((n >= 9) & (b(3) <= 9) & (u24 <= 65536), schema.HTTP2),
        (F.substring(text, 1, 3).isin("GET", "POS", "PUT", "DEL", "PAT", "HEA", "OPT", "CON", "TRA"), schema.HTTP1),
        (text.startswith("HTTP"), schema.HTTP1),
        ((b(0).bitwiseAND(0x70) == 0) & (b(0).bitwiseAND(0x0F) <= 10), schema.WEBSOCKET),
        (text.startswith('{"'), schema.MCP),
    )
    out = F.lit(schema.UNKNOWN)
    for rule, code in reversed(rules):
        out = F.when(rule, code).otherwise(out)
    return out
