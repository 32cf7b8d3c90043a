import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from sparktap.llm import piece_bpe as B
from sparktap.llm import spans

ODD = ["", " ", "  a b", " a  b \n\n c\t", "Ａé ½ ﬁ ​ x", "▁a", "a▁b ▁▁", "日本語 \U0001F600", "\u0000x", "a" * 700 + " b", "           x", "theory" * 100, "é ▁"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abtheins  é.\n1▁日") for _ in range(rng.randrange(1, 80))) for _ in range(800)]


def test_without_dropout_as_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [t for t in texts if "▁" not in t]
    for t, ids in zip(plain, B.Codec(P.path("piece_bpe_32k.model"), 0.0, 0).encode(plain, plain)):
        assert ids.tolist() == sp.encode(t), t


def brute(c, unit, key):
    """One unit, by looking for the best candidate again and again."""
    p = c.pieces
    parts = [[p.symbols[x], i, i + 1] for i, x in enumerate(unit)]
    names = {}
    while True:
        best = None
        for k in range(len(parts) - 1):
            a, b = parts[k], parts[k + 1]
            m = int(p.join(np.array([a[0]]), np.array([b[0]]))[0])
            if m < 0 or c._skipped(np.array([key]), np.array([a[1]]), np.array([b[1]]), np.array([b[2]]))[0]:
                continue
            if best is None or p.scores[m] > best[0]:
                best = (p.scores[m], k, m)
        if best is None:
            return [x[0] for x in parts]
        _, k, m = best
        parts[k : k + 2] = [[m, parts[k][1], parts[k + 1][2]]]


def test_agenda_with_dropout_against_brute_force():
    c = B.Codec(P.path("piece_bpe_32k.model"), 0.3, 5)
    rng = random.Random(1)
    units = [[B.MARK] + [ord(x) for x in "".join(rng.choice(["th", "in", "er", "a", "on", "z", "é"]) for _ in range(rng.randrange(1, 9)))] for _ in range(120)]
    keys = spans.seeds(len(units), 9)
    sizes = np.array([len(u) for u in units])
    got, n = c._merge(c.pieces.symbols[np.concatenate([np.array(u) for u in units])].copy(), sizes, keys)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, u in enumerate(units):
        want = [int(x) for x in brute(c, u, keys[i])]
        assert got[at[i] : at[i + 1]].tolist() == want
        assert [int(x) for x in c._merge_long(c.pieces.symbols[np.array(u)].tolist(), keys[i])] == want


def test_lossless_varied_and_repeatable(texts):
    c = B.Codec(P.path("piece_bpe_32k.model"), 0.3, 5)
    names = [str(i) for i in range(len(texts))]
    ids = c.encode(texts, names)
    assert c.decode(ids) == texts
    again = B.Codec(P.path("piece_bpe_32k.model"), 0.3, 5).encode(texts[::-1], names[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(ids, again))
    word = c.encode(["international " * 50], ["x"])[0]
    assert len({tuple(word[i : i + 3]) for i in range(0, len(word) - 3)}) > 8


def test_query_is_lossless(spark, sf_mid):
    rows = B.op6_sentencepiece(spark, sf_mid).collect()
    assert len(rows) == 1000 and all(r.lossless for r in rows)


def test_nulls_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, None, "q"), (1, "a b", None), (None, "", "q")], "doc_id long, text string, ids string")
    back = B.decode(B.encode(d)).collect()
    assert sorted((r.doc_id or 0, r.text or "-" if r.text is not None else None) for r in back if r.text is not None) == [(0, "-"), (1, "a b")]
    assert sum(r.text is None for r in back) == 1 and B.encode(d.limit(0)).count() == 0


def test_variants_without_a_bound(spark):
    """A frequent unit has more segmentations than any bound, a bound holds, and all decode; a very long unit goes through."""
    word, long = "internationalisation", "unbreakable" * 900
    rows = [(i if i else None, f"{word} {word} {word}") for i in range(300)] + [(7, long), (7, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for variants in (None, 2):
        encoded = B.encode(d, variants=variants, dropout=0.3)
        back = B.decode(encoded, text_col="back").collect()
        assert sorted(r.back for r in back) == sorted(t for _, t in rows)
        one = B.codec(None, 0.3, B.SEED, variants)
        seen[variants] = {x.tobytes() for i in range(300) for x in one.encode([word], [str(i)])}
        assert len({bytes(r.ids) for r in back if r.back == long}) == 1
    assert len(seen[2]) <= 2 and len(seen[None]) > 8
