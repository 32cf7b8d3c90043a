"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier on byte n-grams predicts each bit. A text gets the language whose
codeword has the least loss under the classifiers' margins, weighted by how reliable each classifier was in training.
Where the second best is near, the text is flagged as ambiguous.

The training sample is bounded by MOST_PER_LANGUAGE and MOST_ROWS rows; each gives its whole text and a short window, so
that short texts are known too. Languages are counted over all learning rows. Defined results: null text and text
without a letter are `und` with score 0; so is every text where nothing could be learned. With one language only, every
text with a letter is of it. A null language teaches nothing; rows that repeat an id are predicted each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.llm import linear, spans
from sparktap.session import ship

MOST_PER_LANGUAGE = 800
MOST_ROWS = 4000
BITS = 13
GRAMS = (2, 3, 4)
WINDOW = 60
AMBIGUOUS = 0.15
#: A character that may be a letter; numbers such as a half are sorted out by their category.
_WORDLIKE = re.compile(r"[^\W\d_]")
#: What isn't a letter of a word becomes a space.
PLAIN = np.array([b if chr(b).isascii() and chr(b).isalpha() or b >= 0x80 else 32 for b in range(256)], np.uint8)


def vectors(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For ranges of texts: low, high, and rows of root n-gram shares."""
    raw = [b" " + x.lower().encode() + b" " for x in texts]
    for low, high in spans.blocks([len(x) for x in raw], spans.BLOCK):
        for first in range(low, high, 256):
            last = min(high, first + 256)
            codes = PLAIN[np.frombuffer(b"".join(raw[first:last]), np.uint8)].astype(np.uint32)
            sizes = np.array([len(x) for x in raw[first:last]])
            owner = np.repeat(np.arange(last - first), sizes)
            counts = np.zeros((last - first) << BITS)
            gram = codes.copy()
            for n in range(2, max(GRAMS) + 1):
                gram = (gram[:-1] << np.uint32(8)) ^ codes[n - 1 :]
                if n in GRAMS:
                    inside = owner[: len(gram)] == owner[n - 1 :]
                    place = ((gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
                    counts += np.bincount(((owner[: len(gram)] << BITS) + place)[inside], minlength=len(counts))
            table = counts.reshape(last - first, 1 << BITS)
            yield first, last, np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1)).astype(np.float32)


def codebook(n: int) -> np.ndarray:
    """Codewords (languages x bits, -1 or 1) whose least distance is the largest of many seeded draws."""
    if n < 2:
        return np.ones((n, 1))
    bits = max(7, 6 * int(np.ceil(np.log2(n))))
    best, most = None, -1
    for k in range(200):
        drawn = np.where(np.random.default_rng(k).random((n, bits)) < 0.5, -1, 1)
        drawn[0, np.abs(drawn.sum(0)) == n] *= -1  # each bit parts the languages
        apart = min(int((drawn[i] != drawn[j]).sum()) for i in range(n) for j in range(i)) if n <= 64 else bits - int((drawn @ drawn.T - 2 * bits * np.eye(n)).max() + bits) // 2
        if apart > most:
            best, most = drawn, apart
    return best


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in spans.slices(batches):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        cut = [x[(h := window_start(x)) : h + WINDOW] for x in texts]
        for part in (texts, cut):
            for low, high, v in vectors(part):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())], names=["lang", "v"])


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode category L occurs."""
    return bool(text) and any(unicodedata.category(m[0])[0] == "L" for m in _WORDLIKE.finditer(text))


def window_start(text: str) -> int:
    """Where a text's training window starts: a place that its length and first characters fix."""
    room = max(len(text) - WINDOW, 0)
    return (len(text) * 2654435761 + sum(map(ord, text[:16]))) % (room + 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=None) -> dict | None:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    rows = rows.where((learn if learn is not None else ~linear.held_out("__id", 3, 1)) & F.col("__text").isNotNull())
    chosen = linear.sample_by_class(rows, "__lang", "__id", MOST_PER_LANGUAGE, MOST_ROWS)
    table = chosen.select("__lang", "__text").mapInArrow(_extract, "lang string, v binary").toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return None
    x = np.empty((len(names), 1 << BITS), np.float32)
    for i, v in enumerate(table.column("v")):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    del table
    y = np.searchsorted(langs, names)
    code = codebook(len(langs))
    weight = (len(y) / len(langs)) / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y]
    w, b, trust = [], [], []
    for bit in range(code.shape[1] if len(langs) > 1 else 0):
        target = (code[y, bit] > 0).astype(float)
        wb, bb = linear.fit(linear.Dense(x), target, weight, penalty=0.02, steps=40)
        wrong = float(weight @ ((x @ wb.astype(np.float32) + bb > 0) != (target > 0.5)) / weight.sum())
        w.append(wb.astype(np.float32)), b.append(bb), trust.append(np.log((1 - wrong + 1e-3) / (wrong + 1e-3)))
    return {"langs": langs, "code": code, "w": np.array(w), "b": np.array(b), "trust": np.array(trust)}


def predict(texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and whether each is ambiguous."""
    score, unclear, names = np.zeros(len(texts)), np.zeros(len(texts), bool), ["und"] * len(texts)
    if model is None:
        return names, score, unclear
    some = [i for i, t in enumerate(texts) if has_letter(t)]
    for low, high, x in vectors([texts[i] for i in some]):
        if len(model["langs"]) == 1:
            chance = np.ones((high - low, 1))
        else:
            margins = x @ model["w"].T + model["b"]
            loss = np.logaddexp(0, -margins[:, None, :] * model["code"][None]) @ (model["trust"] / model["trust"].mean())
            chance = np.exp(loss.min(1, keepdims=True) - loss)
            chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        ranked = np.sort(chance, 1)
        for k, i in enumerate(some[low:high]):
            names[i], score[i] = model["langs"][best[k]], chance[k, best[k]]
            unclear[i] = len(model["langs"]) > 1 and ranked[k, -1] - ranked[k, -2] < AMBIGUOUS
    return names, score, unclear


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, ambiguous) of all documents."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            names, score, unclear = predict(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], names=["id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", linear.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
