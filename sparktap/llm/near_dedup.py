"""Near-duplicate documents by min-max hashing.

Under each of P permutations both the least and the greatest shingle hash are kept, so P hash evaluations give 2 P
signature values, which agree with the probability of the Jaccard similarity. Bands of ROWS values are the buckets.
BANDS follow from the threshold, so that a pair at the threshold is missed with probability 1e-6 at most.

Documents with equal shingle sets are one vertex, so copies are never paired. Documents of a bucket are compared in rounds
(see settle): with leaders first, at last all that are still apart, whatever their number, whose sketches allow the
threshold. Those of two bits of each signature value rule out a pair at the threshold once in a million; odd sketches, in
which each shingle turns one bit, never do. sketch=False leaves both out. Every link is confirmed on the full sets.

Defined results: null or empty text has an empty set, is linked with nothing and is its own component. A row whose id is
null has a null component and is kept. Rows that repeat an id are one vertex, with the links of each of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm import spans
from sparktap.llm.keep import without
from sparktap.llm.settle import Sets, classes_of, crossed, fingerprints, lists, per_document, settle, word_sets
from sparktap.session import materialise, release, ship

ROWS = 8
MISS = 1e-6
WIDTH = 5
#: Standard deviations by which a pair's sketch may stray from the threshold before the pair is left out; a pair at the
#: threshold strays further with probability 1e-6.
STRAY = 4.9
#: Bits of a sketch for each signature value.
SKETCH = 2


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def most_unlike(similarity: float, values: int) -> int:
    """Bits in which sketches of so many values may differ: a value differs with chance 1 - similarity, and then each of
    its bits with chance 1/2."""
    apart = values * (1 - similarity)
    spread = apart * similarity * (SKETCH / 2) ** 2 + apart * SKETCH / 4
    return math.ceil(apart * SKETCH / 2 + STRAY * math.sqrt(spread))


def sketch_words(n_bands: int, rows: int = ROWS) -> int:
    return -(-n_bands * rows * SKETCH // 64)


def signatures(runs: np.ndarray, bounds: np.ndarray, n_bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (texts x bands) of texts with at least one run, and sketches (texts x words): two bits of each value."""
    used = n_bands * rows
    perms = (used + 1) // 2
    masks, factors = spans.seeds(perms, 1), spans.seeds(perms, 2) | spans.U(1)
    starts = bounds[:-1]
    values = np.empty((2 * perms, len(starts)), spans.U)
    for k in range(perms):
        x = (runs ^ masks[k]) * factors[k]
        values[2 * k] = np.minimum.reduceat(x, starts)
        values[2 * k + 1] = np.maximum.reduceat(x, starts)
    out = np.empty((len(starts), n_bands), spans.U)
    for b in range(n_bands):
        acc = np.full(len(starts), b + 1, spans.U)
        for i in range(rows):
            acc = spans.mix(acc * spans.U(spans.BASE) + values[b * rows + i])
        out[:, b] = acc
    bits = np.zeros((64 * sketch_words(n_bands, rows), len(starts)), np.uint8)
    for k in range(used):
        mixed = spans.mix(values[k])
        for j in range(SKETCH):
            bits[SKETCH * k + j] = mixed >> spans.U(j) & spans.U(1)
    return out, np.packbits(bits, axis=0).T.copy().view(spans.U)


def _sign(n_bands: int, width: int):
    width_s = sketch_words(n_bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            for ids, runs, bounds in word_sets(batch, width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                own = np.concatenate([bounds[:-1][full], bounds[-1:]])
                sums = fingerprints(runs, bounds)
                bands = np.zeros((0, n_bands), spans.U)
                sketches = np.zeros((0, width_s), spans.U)
                if len(full):
                    bands, sketches = signatures(runs, own, n_bands)
                upto = np.concatenate([[0], np.cumsum(sizes > 0)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(bands.reshape(-1), upto * n_bands), lists(sketches.reshape(-1), upto * width_s)], names=["id", "n", "h1", "h2", "bands", "sketch"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH, sketch: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Linked: den * intersection >= num * union.

    sketch: whether sketches rule out pairs before they are confirmed; without them all pairs that still count are.
    """
    ship(docs.sparkSession)
    n_bands = bands_for(num / den)
    words = range(sketch_words(n_bands))
    id_type = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shown = f"id {id_type}, n long, h1 long, h2 long, bands array<long>, sketch array<long>"
    signed = materialise(bare.mapInArrow(_sign(n_bands, width), shown), "signed")
    classes = classes_of(signed, "bands", "sketch")
    members = classes.select(F.explode("bands").alias("key"), "rep", F.col("n").alias("info"))
    sets = Sets(bare, width, num, den)

    def fits(x: Column, y: Column) -> Column:
        return den * F.least(x, y) >= num * F.greatest(x, y)

    def sketched(rows: DataFrame) -> DataFrame:
        odd = sets.odd_sketches(rows.select(F.col("rep").alias("id")))
        own = classes.join(odd, F.col("rep") == F.col("id")).select(F.col("rep").alias("of"), F.struct("n", "odd", *[F.col("sketch")[i].alias(f"w{i}") for i in words]).alias("sketched"))
        return rows.join(own, F.col("rep") == F.col("of")).drop("of", "info").withColumnRenamed("sketched", "info")

    def alike(x: Column, y: Column) -> Column:
        unlike = sum((F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"])) for i in words), F.lit(0))
        # Shingles of one set only are as many as odd sketches differ in at least, and so many at most in a link.
        apart = F.aggregate(F.zip_with(x["odd"], y["odd"], lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
        total = x["n"] + y["n"]
        return fits(x["n"], y["n"]) & (unlike <= most_unlike(num / den, n_bands * ROWS)) & ((num + den) * (total - apart) >= 2 * num * total)

    def cross(rows: DataFrame) -> DataFrame:
        told = materialise(sketched(rows), "told")
        pairs = materialise(crossed(told, alike), "pairs")
        release(told)
        return pairs

    labels = settle(members, fits, sets.confirm, cross if sketch else None)
    sets.release()
    out = per_document(signed, classes, labels, id_col)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    return without(docs, near_duplicates(docs, id_col, text_col, num, den).where("NOT kept").select(id_col), id_col)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), num=85, den=100)


#: The links from all pairs that share a shingle, and their transitive closure; for small tables.
SQL = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS sh FROM n
), x AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b WHERE 100 * c >= 85 * (len(sa.sh) + len(sb.sh) - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id
"""
