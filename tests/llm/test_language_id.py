import numpy as np

from sparktap.llm import language_id as L
from sparktap.llm import linear


def test_held_out_accuracy(spark, sf_mid):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()}
    rows = L.op5_language_id(spark, sf_mid).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean(held) > 0.97


def test_codewords_part_all_languages():
    for n in (2, 4, 7, 30):
        code = L.codebook(n)
        assert all((code[i] != code[j]).sum() >= 2 for i in range(n) for j in range(i))
        assert all(abs(c.sum()) < n for c in code.T)


def test_wrong_bits_are_corrected():
    code = L.codebook(4)
    model = {"langs": ["a", "b", "c", "d"], "code": code, "w": np.zeros((code.shape[1], 1 << L.BITS), np.float32), "b": 4.0 * code[2], "trust": np.ones(code.shape[1])}
    model["b"][0] *= -1
    names, score, _ = L.predict(["abc"], model)
    assert names == ["c"] and score[0] > 0.5


def test_no_letters_nulls_and_nothing_learned(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "abc", None), (None, "word " * 40000, "en")], "doc_id long, text string, lang string")
    model = L.train(d, learn=L.F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(d, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == got[None] == ("en", 1.0)
    assert L.train(d.limit(0)) is None and {r.lang_pred for r in L.identify(d, None).collect()} == {"und"}


def test_numbers_that_look_like_letters_are_none(spark):
    texts = ["½ ²", "Ⅷ ①", "_", "々", "ก", "²a"]
    d = spark.createDataFrame([(i, "abc def", "en") for i in range(20)], "doc_id long, text string, lang string")
    model = L.train(d, learn=L.F.lit(True))
    assert L.predict(texts, model)[0] == ["und", "und", "und", "en", "en", "en"]


def plain_vector(text):
    """The row of one text by a dictionary of its n-grams."""
    raw = b" " + text.lower().encode() + b" "
    codes = [b if chr(b).isascii() and chr(b).isalpha() or b >= 0x80 else 32 for b in raw]
    counts = {}
    for n in L.GRAMS:
        for i in range(len(codes) - n + 1):
            gram = 0
            for c in codes[i : i + n]:
                gram = ((gram << 8) ^ c) & 0xFFFFFFFF
            place = ((gram * 0x9E3779B1 + n * 0x85EBCA6B) * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - L.BITS)
            counts[place] = counts.get(place, 0) + 1
    total = sum(counts.values()) or 1
    return {k: (c / total) ** 0.5 for k, c in counts.items()}


def test_decoding_against_plain_python(spark, sf_small):
    """The codeword of least weighted loss, bit by bit and language by language."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = L.train(docs)
    texts = [r.text for r in docs.limit(60).collect()] + ["ab", "日本", "x1 é"]
    names, score, _ = L.predict(texts, model)
    trust = model["trust"] / model["trust"].mean()
    for text, name, chance in zip(texts, names, score):
        v = plain_vector(text)
        loss = []
        for word in model["code"]:
            total = 0.0
            for bit, (w, b) in enumerate(zip(model["w"], model["b"])):
                margin = sum(float(w[k]) * x for k, x in v.items()) + b
                total += trust[bit] * np.log1p(np.exp(-margin * word[bit]))
            loss.append(total)
        best = int(np.argmin(loss))
        assert name == model["langs"][best]
        assert abs(chance - 1 / sum(np.exp(loss[best] - x) for x in loss)) < 1e-3


def test_many_classes_all_take_part(spark):
    d = spark.createDataFrame([(i, f"k{i % 1500}") for i in range(4500)] + [(None, None)], "id long, k string")
    got = linear.sample_by_class(d, "k", "id", 100, 100_000)
    assert got.columns == ["id", "k"] and got.select("k").distinct().count() == 1500
    assert linear.sample_by_class(d.limit(0), "k", "id", 10, 10).count() == 0
