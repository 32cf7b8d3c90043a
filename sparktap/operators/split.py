"""Payloads that hold several messages or frames, as one row each. Native: a payload's starts are found by a fold over it.

Defined results: a null payload has no rows, an empty one neither. Rows keep the columns of their payload, and are numbered
in its order from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTTP.
BLANK = "\r\n\r\n"
STARTS = r"^(?:(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE) |HTTP/)"
PREFACE = "PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
FRAME_TYPES = ("DATA", "HEADERS", "PRIORITY", "RST_STREAM", "SETTINGS", "PUSH_PROMISE", "PING", "GOAWAY", "WINDOW_UPDATE", "CONTINUATION")
SETTINGS = ("HEADER_TABLE_SIZE", "ENABLE_PUSH", "MAX_CONCURRENT_STREAMS", "INITIAL_WINDOW_SIZE", "MAX_FRAME_SIZE", "MAX_HEADER_LIST_SIZE")

CUTS = "array<struct<start: int, body: int, stop: int, whole: boolean>>"


def _header(head: Column, name: str) -> Column:
    """The trimmed value of a header, the first of its name; empty where it has none."""
    return F.trim(F.regexp_extract(head, rf"(?i)\r\n{name}[ \t]*:([^\r\n]*)", 1))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cut(text: Column, at: Column) -> Column:
    """Where the message that starts at `at` (counted from 0) has its body and its end."""
    size = F.char_length(text)
    locate = lambda what, after: F.call_function("locate", F.lit(what), text, after + 1)

    def found(end: Column, head: Column) -> Column:
        start = end + 3
        length = F.greatest(F.coalesce(_header(head, "content-length").try_cast("bigint"), F.lit(0)), F.lit(0))
        told = head.rlike(r"(?i)\r\ncontent-length[ \t]*:") | F.substring(text, start + 1, F.lit(12)).rlike(STARTS)
        plain = F.when(told, F.least(size.cast("bigint"), start + length).cast("int")).otherwise(size)
        chunked = _let(locate("0" + BLANK, start), lambda closing: F.when(closing > 0, closing + 4).otherwise(size))
        stop = F.when(F.lower(_header(head, "transfer-encoding")).contains("chunked"), chunked).otherwise(plain)
        return F.struct(at.alias("start"), start.alias("body"), stop.alias("stop"), F.lit(True).alias("whole"))

    none = F.struct(at.alias("start"), size.alias("body"), size.alias("stop"), F.lit(False).alias("whole"))
    return _let(locate(BLANK, at), lambda end: F.when(end > 0, _let(F.substring(text, at + 1, end - at - 1), lambda head: found(end, head))).otherwise(none))


def messages(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """One row for each HTTP/1 message of a payload: message_no, kind, method, target, status_code, head_len, body_len,
    whole, body.

    A message ends with its declared length (a negative or unreadable one counts as 0), with the last chunk, or with the
    payload; another one follows only where a method or a version stands. whole: its blank line is there. body_len is that
    of what the payload holds. The fold takes as many steps as there are blank lines.
    """
    text = F.decode(F.col(col), "ISO-8859-1")
    steps = F.sequence(F.lit(0), ((F.char_length("__t") - F.char_length(F.replace(F.col("__t"), F.lit(BLANK), F.lit("")))) / 4).cast("int"))
    start = F.struct(F.when(F.char_length("__t") > 0, 0).otherwise(-1).alias("at"), F.array().cast(CUTS).alias("cuts"))

    def taken(state: Column, cut: Column) -> Column:
        more = cut["whole"] & (cut["stop"] < F.char_length("__t")) & F.substring(F.col("__t"), cut["stop"] + 1, F.lit(12)).rlike(STARTS)
        return F.struct(F.when(more, cut["stop"]).otherwise(-1).alias("at"), F.concat(state["cuts"], F.array(cut)).cast(CUTS).alias("cuts"))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["at"] >= 0, _let(_cut(F.col("__t"), state["at"]), lambda cut: taken(state, cut))).otherwise(state)

    rows = payloads.where(F.col(col).isNotNull()).withColumn("__t", text)
    each = rows.withColumn("__c", F.aggregate(steps, start, step)["cuts"]).select("*", F.posexplode("__c").alias("message_no", "__m"))
    m, t = F.col("__m"), F.col("__t")
    head = F.substring(t, m["start"] + 1, m["body"] - m["start"])
    line = F.split(F.regexp_extract(head, r"^[^\r\n]*", 0), " ", 3)
    response = head.startswith("HTTP/")
    shown = {
        "kind": F.when(response, "response").otherwise("request"), "method": F.when(~response, F.upper(line[0])), "target": F.when(~response, F.get(line, F.lit(1))),
        "status_code": F.when(response, F.get(line, F.lit(1)).try_cast("int")), "head_len": m["body"] - m["start"], "body_len": m["stop"] - m["body"], "whole": m["whole"],
        "body": F.encode(F.substring(t, m["body"] + 1, m["stop"] - m["body"]), "ISO-8859-1"),
    }
    return each.withColumns(shown).drop("__t", "__c", "__m")


def _number(data: Column, at: Column, size: int) -> Column:
    """An unsigned number of so many bytes at a place counted from 0, the highest byte first."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("bigint")


def frames(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """One row for each HTTP/2 frame of a payload, after the preface if it has one: frame_no, type, length, flags,
    stream_id, held (bytes of it that the payload holds), compressed and message_len (of a gRPC message in DATA),
    error_code, last_stream_id, increment, settings (name or number, value).

    Frames end where fewer than 9 bytes are left or a type is unknown.
    """
    data = F.col(col)
    first = F.when(F.substring(data, 1, len(PREFACE)) == F.lit(PREFACE.encode()), len(PREFACE)).otherwise(0)
    ends = lambda at: (at + 9 > F.length(data)) | (_number(data, at + 3, 1) > 9)
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        after = F.least(at + 9 + _number(data, at, 3), F.length(data).cast("bigint") + 1).cast("int")
        taken = F.struct(after.alias("at"), F.concat(state["starts"], F.array(at)).alias("starts"))
        return F.when(ends(at), state).otherwise(taken)

    # No frame is shorter than 9 bytes.
    steps = F.sequence(F.lit(0), F.floor(F.length(data) / 9).cast("int"))
    rows = payloads.where(data.isNotNull())
    each = rows.select("*", F.posexplode(F.aggregate(steps, start, step)["starts"]).alias("frame_no", "__at"))
    at = F.col("__at")
    kind, size, body = _number(data, at + 3, 1), _number(data, at, 3), at + 9
    held = F.least(size, F.length(data) - body).cast("int")
    at_least = lambda k, n, c: F.when((kind == k) & (held >= n), c)
    low31 = lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF))
    pair = lambda i: F.struct(
        F.coalesce(F.get(F.array(*map(F.lit, SETTINGS)), (_number(data, body + 6 * i, 2) - 1).cast("int")), _number(data, body + 6 * i, 2).cast("string")).alias("name"), _number(data, body + 6 * i + 2, 4).alias("value")
    )
    shown = {
        "type": F.get(F.array(*map(F.lit, FRAME_TYPES)), kind.cast("int")), "length": size, "flags": _number(data, at + 4, 1), "stream_id": low31(_number(data, at + 5, 4)), "held": held,
        "compressed": at_least(0, 5, _number(data, body, 1) == 1), "message_len": at_least(0, 5, _number(data, body + 1, 4)),
        "error_code": F.coalesce(at_least(3, 4, _number(data, body, 4)), at_least(7, 8, _number(data, body + 4, 4))), "last_stream_id": at_least(7, 8, low31(_number(data, body, 4))),
        "increment": at_least(8, 4, low31(_number(data, body, 4))), "settings": at_least(4, 6, F.transform(F.sequence(F.lit(0), F.floor(held / 6).cast("int") - 1), pair)),
    }
    return each.withColumns(shown).drop("__at")
