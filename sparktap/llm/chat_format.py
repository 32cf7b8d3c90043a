r"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is `### Role: ` + content + `</turn>` and a newline. Content is a list of parts (type, text, ref, units). A
visitor turns text parts into escaped text and image, audio and document parts into placeholders `<|image:1|>`, whose
number counts the conversation's attachments in order; it records each reference and the tokens that the placeholder
stands for. A control string inside a text gets a backslash (`<\/turn>`, `###\ Assistant:`, `<\|image`), and one that
has backslashes there already gets one more, so it never occurs in a content and taking one backslash away restores it.
The loss mask lists the spans, in code points, of assistant content.

Text parts that stand side by side are one text: they are joined, then escaped, so a control string whose halves come
from two parts is escaped as any other.

Defined results: a null text is empty; a null role is the empty role; a null part list has no parts; an unknown part
type, and a null part, is shown as a document; null units count as one. Turns with the same number are ordered by role, then text; null turns come first. A
conversation is one output string, so its turns meet in one row; they are gathered map-side first, and the size of that
row is the size of the asked-for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm.arrays import running

#: How roles are shown; another role is shown as role= and its hex form.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
KINDS = ("image", "audio", "document")
END = "</turn>"
SHOWN = "(?:System|User|Assistant|Tool|role=[0-9A-F]*):"
CONTROL = rf"(<)(\\*)(?=/turn>|\|(?:image|audio|document):)|(###)(\\*)(?= {SHOWN})"
ESCAPED = rf"(<)\\(\\*)(?=/turn>|\|(?:image|audio|document):)|(###)\\(\\*)(?= {SHOWN})"
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
PLACEHOLDER = r"<\|(?:image|audio|document):(\d+)\|>"
#: Tokens that one unit of each type stands for: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 800}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$3$2$4")


def show_role(role: Column) -> Column:
    out = F.concat(F.lit("role="), F.hex(F.coalesce(role, F.lit(""))))
    for k, v in ROLES.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def read_role(shown: Column) -> Column:
    out = F.decode(F.unhex(F.substring(shown, 6, 1 << 30)), "UTF-8")
    for k, v in ROLES.items():
        out = F.when(shown == v, k).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PARTS)


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"] == "text", F.lit(False))


def _kind(p: Column) -> Column:
    return F.when(p["type"].isin(*KINDS), p["type"]).otherwise("document")


def format_chats(turns: DataFrame, conv="conv_id", turn="turn", role="role", parts="parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_mask (start, length), attachments, n_attachment_tokens.

    parts is a column of type PARTS; see text_parts().
    """
    visible = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts")).alias("t"))
    whole = visible.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # The number of attachments before each turn, as running sums over the ordered turns.
    count = lambda t: F.size(F.filter(t["parts"], lambda p: ~_is_text(p)))
    whole = whole.withColumn("before", running(F.transform("turns", count)))

    def content(t: Column, first: Column) -> Column:
        """Neighbouring texts are joined before they are escaped, so no control string arises where two of them meet."""
        shut = lambda a: F.concat(a["shown"], F.array(escape(a["open"])))

        def visit(a: Column, p: Column) -> Column:
            number = a["n"] + 1
            mark = F.concat(F.lit("<|"), _kind(p), F.lit(":"), (first + number).cast("string"), F.lit("|>"))
            text = F.struct(a["n"].alias("n"), a["shown"].alias("shown"), F.concat(a["open"], F.coalesce(p["text"], F.lit(""))).alias("open"))
            other = F.struct(number.alias("n"), F.concat(shut(a), F.array(mark)).alias("shown"), F.lit("").alias("open"))
            return F.when(_is_text(p), text).otherwise(other)

        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("shown"), F.lit("").alias("open"))
        return F.aggregate(t["parts"], start, visit, lambda a: F.array_join(shut(a), ""))

    whole = whole.withColumn("seen", F.zip_with("turns", "before", lambda t, b: F.struct(t["role"].alias("role"), F.concat(F.lit("### "), show_role(t["role"]), F.lit(": ")).alias("head"), content(t, b).alias("content"))))
    lengths = F.transform("seen", lambda s: F.char_length(s["head"]) + F.char_length(s["content"]) + F.lit(len(END) + 1))
    whole = whole.withColumn("starts", running(lengths))
    spans = F.zip_with("seen", "starts", lambda s, b: F.struct((s["role"] == "assistant").alias("on"), (b + F.char_length(s["head"])).cast("long").alias("start"), F.char_length(s["content"]).cast("long").alias("length")))
    per = lambda p: F.coalesce(p["units"], F.lit(1)) * _by_kind(_kind(p))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(F.filter(t["parts"], lambda p: ~_is_text(p)), lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), per(p).alias("tokens")))))
    return whole.select(
        F.col("conv").alias(conv),
        F.concat(F.array_join(F.transform("seen", lambda s: F.concat(s["head"], s["content"])), END + "\n"), F.lit(END + "\n")).alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_mask"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_attachment_tokens"),
    )


def _by_kind(kind: Column) -> Column:
    return F.create_map(*[x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v).cast("long"))])[kind]


def read_back(formatted: Column) -> Column:
    """The turns (role, content) of a formatted conversation, contents unescaped, placeholders as they stand."""
    pieces = F.split(formatted, END + "\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        cut = F.locate(": ", p)
        return F.struct(read_role(F.substring(p, F.lit(5), cut - 5)).alias("role"), unescape(F.substring(p, cut + 2, F.char_length(p))).alias("text"))

    return F.transform(whole, one)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span and joined."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def probe(spark) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    out = format_chats(rows.withColumn("parts", text_parts(F.col("text"))))
    read = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The formatted length is counted from each text's control strings: one more character for each.
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool' ELSE 'role=' || hex(encode(role)) END) + 4 + 2
    + length(text) + len(regexp_extract_all(text, '<\\*(/turn>|\|(image|audio|document):)|###\\* (System|User|Assistant|Tool|role=[0-9A-F]*):')) + 8 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
