import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktap.llm import chat_format
from sparktap.llm.byte_bpe import encoder
from sparktap.llm.packing import MAX_LOSS, MAX_SEGMENTS, MAX_TOKENS, MOST_PADDING, Packer, all_bear, answer_spans, op7_packing, pack, running_losses


def check_pieces(pieces, counts, tokens, segments, loss):
    """Every limit holds, every token lies in one piece; the tokens in each sequence come back."""
    by_doc, by_seq = {}, {}
    for doc, start, n, seq, offset, bears in pieces:
        own = counts[doc]
        assert n > 0 and bears == sum(int(own[k + 1] - own[k]) for k in range(start + 1, start + n))
        by_doc.setdefault(doc, []).append((start, n))
        by_seq.setdefault(seq, []).append((offset, n, bears))
    for doc, own in counts.items():
        at = 0
        for start, n in sorted(by_doc.get(doc, [])):
            assert start == at
            at += n
        assert at == len(own) - 1
    for parts in by_seq.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= tokens and len(parts) <= segments and sum(b for _, _, b in parts) <= loss
    return [sum(n for _, n, _ in x) for x in by_seq.values()]


def packed(packer, counts):
    return packer.add(list(counts), list(counts.values())) + packer.close()


MASK = st.lists(st.tuples(st.integers(1, 90), st.booleans()), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(MASK, max_size=150), st.integers(1, 40), st.integers(0, 64), st.sampled_from([0.0, 0.02, 0.5]))
def test_packer_keeps_all_limits(masks, segments, loss, padding):
    counts = {i: np.cumsum([0, *[int(b) for n, b in m for _ in range(n)]]) for i, m in enumerate(masks)}
    filled = check_pieces(packed(Packer(64, segments, loss, padding), counts), counts, 64, segments, loss)
    assert all(64 - x <= int(64 * padding) or x & (x - 1) == 0 for x in filled)


def test_no_padding_without_binding_limits():
    rng = np.random.default_rng(0)
    counts = {i: all_bear(n) for i, n in enumerate(rng.integers(1, 5000, 3000).tolist())}
    for filled in check_pieces(packed(Packer(2048, 4000, 2047), counts), counts, 2048, 4000, 2047):
        assert filled == 2048 or filled & (filled - 1) == 0


class Largest(Packer):
    """First the largest piece that fits, whatever its loss."""

    def score(self, size, loss, room, weight):
        return size.astype(float)


def test_dot_product_needs_fewer_sequences_than_the_largest_first():
    """Long prompts and long answers: only sequences that mix them use both limits."""
    rng = np.random.default_rng(3)
    counts = {}
    for i in range(4000):
        size, bears = (rng.integers(200, 400), 0.95) if i % 2 else (rng.integers(20, 200), 0.05)
        prompt = int(size * (1 - bears))
        counts[i] = np.concatenate([np.zeros(prompt + 1, int), np.arange(1, size - prompt + 1)])
    limits = (2048, 4000, 1480)
    out = {k: check_pieces(packed(k(*limits), counts), counts, *limits) for k in (Packer, Largest)}
    assert len(out[Packer]) < 0.95 * len(out[Largest])
    full = lambda x: sum(n == 2048 for n in x)
    assert full(out[Packer]) > full(out[Largest])


def test_ids_are_the_tokenizers_ids(spark, sf_small):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).collect()
    odd = ["", "  a\n\n b", "don't 'S 's", "日本語 ½ \U0001F600", "a" * 3000 + " b"]
    texts = [r.text for r in docs] + odd
    for text, ids in zip(texts, encoder().encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def plain_losses(t, text, spans):
    """Token by token, by the offsets of the library (characters)."""
    found = t.encode(text, add_special_tokens=False)
    inside = {k for a, n in spans for k in range(a, a + n)}
    ends, raw = 0, text.encode()
    out = [0]
    lengths = encoder().lengths
    for i in found.ids:
        out.append(out[-1] + (len(raw[:ends].decode("utf-8", "ignore")) in inside))
        ends += int(lengths[i])
    assert ends == len(raw)
    return [*out, out[-1] + 1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é日\n\U0001F600,."), max_size=80), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 30)), max_size=4))
def test_losses_of_tokens_against_characters(text, spans):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = encoder().encode([text])[0]
    got = running_losses(text, encoder().lengths[ids], spans).tolist()
    # A token in the middle of a character is of that character.
    want = plain_losses(t, text, spans)
    assert got == want


def test_query_against_plain_tokenizer(spark, sf_small):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    want = {k: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for k, x in texts.items()}
    counts = {k: np.array(plain_losses(t, x, [(x.find("\n") + 1, len(x))])) for k, x in texts.items()}
    rows = op7_packing(spark, sf_small).collect()
    pieces = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.loss_tokens) for r in rows]
    filled = check_pieces(pieces, counts, MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    assert all(MAX_TOKENS - x <= MOST_PADDING * MAX_TOKENS or x & (x - 1) == 0 for x in filled)
    # The limit of loss-bearing tokens binds here: sequences end at it.
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.loss_tokens
    assert max(by.values()) == MAX_LOSS


def test_instruction_data_by_the_mask_of_chats(spark, sf_small):
    turns = spark.read.parquet(f"{sf_small}/conversations.parquet")
    chats = chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    said = sum(len(r.text) for r in turns.where("role = 'assistant'").collect())
    rows = pack(chats, "conv_id", "formatted", F.col("loss_mask"), most_loss=1024).collect()
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.loss_tokens
    assert 0 < max(by.values()) <= 1024
    assert sum(r.loss_tokens for r in rows) < said and len({r.conv_id for r in rows}) == chats.count()


def test_nulls_empty_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, None, 5), (1, None, 6), (None, "", 7), (2, "a b", None)], "doc_id long, text string, offset int")
    for loss in (None, answer_spans(F.col("text")), F.lit(None), F.expr("array(null, struct(-3 as start, 5 as length), struct(1 as start, 99 as length))")):
        rows = pack(d, loss=loss).collect()
        assert sum(r.length for r in rows) == 1 + 1 + 1 + 3
        assert pack(d.limit(0), loss=loss).count() == 0
