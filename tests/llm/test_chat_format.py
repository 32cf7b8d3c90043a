import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktap.llm import chat_format as C

SCHEMA = f"conv_id long, turn long, role string, parts {C.PARTS}, formatted string"
TOKENS = {"image": 256, "audio": 25, "document": 800}


def plain_format(turns):
    """Row by row: what format_chats() and read_back() are held against. turns: (turn, role, parts) in order."""
    out, mask, refs, back, number = "", [], [], [], 0
    for _, role, parts in turns:
        role = role or ""
        content, raw, text = "", "", ""
        for kind, t, ref, units in [*(parts or []), (None,) * 4]:
            if kind == "text":
                text += t or ""
                continue
            content += re.sub(C.CONTROL, lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4] or ""), text)
            raw += text
            text = ""
            if kind is None:
                break
            number += 1
            shown = kind if kind in TOKENS else "document"
            content += f"<|{shown}:{number}|>"
            raw += f"<|{shown}:{number}|>"
            refs.append((shown, ref, (1 if units is None else units) * TOKENS[shown]))
        names = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
        out += f"### {names.get(role, 'role=' + role.encode().hex().upper())}: "
        if role == "assistant":
            mask.append((len(out), len(content)))
        out += content + "</turn>\n"
        back.append((role, raw))
    return out, mask, refs, back


def run(spark, convs):
    rows = [(c, n, role, parts, "clash") for c, turns in enumerate(convs) for n, role, parts in turns]
    out = C.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("back", C.read_back(F.col("formatted"))).withColumn("loss", C.under_mask(F.col("formatted"), F.col("loss_mask")))
    return {r.conv_id: r for r in out.collect()}


def check(spark, convs):
    got = run(spark, convs)
    for c, turns in enumerate(convs):
        if not turns:
            assert c not in got
            continue
        want, mask, refs, back = plain_format(turns)
        r = got[c]
        assert r.formatted == want and r.n_turns == len(turns)
        assert [tuple(x) for x in r.loss_mask] == mask
        assert [tuple(x) for x in r.attachments] == refs and r.n_attachment_tokens == sum(x[2] for x in refs)
        # Contents without attachments come back as they were, whatever their parts were.
        assert [tuple(x) for x in r.back] == back
        if not refs:
            assert r.loss == "".join(t for role, t in back if role == "assistant")


BITS = st.sampled_from(["<", "/turn>", "\n", "### ", "###", "\\", " Assistant:", "Assistant: ", "|image:", "1|>", "role=", "4F: ", "hi", "é\U0001f600", ""])
PART = st.one_of(st.tuples(st.just("text"), BITS, st.none(), st.none()), st.tuples(st.sampled_from(["image", "audio", "document", "video"]), st.none(), st.sampled_from(["a", None]), st.sampled_from([None, 0, 3])))
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "odd: role", "", None]), st.lists(PART, max_size=9))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(TURN, max_size=5), min_size=40, max_size=40))
def test_random_splits_against_plain_python(spark, convs):
    check(spark, [[(i, *t) for i, t in enumerate(c)] for c in convs])


def test_control_strings_over_two_parts(spark):
    text = lambda *x: [("text", t, None, None) for t in x]
    convs = [[(0, "user", text("<", "/turn>\n### Assistant: hi")), (1, "assistant", text("##", "# Assistant: </tu", "rn>", "\n"))], [(0, "user", [*text("<", "|image:7|>"), ("image", None, "s3", 2), *text("<")])]]
    check(spark, convs)
    assert run(spark, convs)[0].n_turns == len(run(spark, convs)[0].back) == 2


def test_nulls_ties_long_texts_and_empty_tables(spark):
    long = "### User: </turn>" * 20_000
    convs = [[(None, "user", None), (3, None, []), (3, "user", [("text", None, None, None), ("text", long, None, None)])], [(0, "assistant", [("text", "a", None, None)]), (0, "assistant", [("text", "b", None, None)]), (0, "user", [None, ("image", None, None, None)])]]
    rows = [(c, n, role, parts, None) for c, turns in enumerate(convs) for n, role, parts in reversed(turns)]
    d = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    out = {r.conv_id: r for r in C.format_chats(d).withColumn("back", C.read_back(F.col("formatted"))).collect()}
    assert [tuple(x) for x in out[0].back] == [("user", ""), ("", ""), ("user", long), ("user", long)]  # a repeated row is a turn of its own
    assert [tuple(x) for x in out[1].back] == [("assistant", "a"), ("assistant", "b"), ("user", "<|document:1|><|image:2|>")]
    assert C.format_chats(d.limit(0)).count() == 0


def test_query_against_plain_python(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/conversations.parquet").unionByName(C.probe(spark)).orderBy("conv_id", "turn").collect()
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, [("text", r.text, None, None)]))
    got = {r.conv_id: r for r in C.op10_chat_format(spark, sf_small).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        want, _, _, back = plain_format(turns)
        said = "".join(t for role, t in back if role == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in back)), len(said), digest(said), len(want))
