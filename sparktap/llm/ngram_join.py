"""Jaccard join of documents on word n-grams, as a blocked sparse product of the document by n-gram incidence matrix.

Columns are ordered from rare to common by a table of counts over hashed n-grams; its size is fixed, and any order gives
the same links. A document's first columns are the first block: so many that documents linked with it share one of them
at least. The product of this block with itself, column by column, adds up how many columns two documents share and where
the last one stands, and a pair goes on only if the sizes leave room for the overlap that a link needs. For pairs that go
on all other columns are the second block, where the overlap is completed and compared.

Documents with equal sets are one row of the matrix, and of the product only pairs are made that are still in different
components (see settle), so copies aren't expanded into their pairs.

Defined results: null or empty text has an empty set, is linked with nothing and is its own component. A row whose id is
null has a null component. Rows that repeat an id are one vertex, with the links of each of its texts. Very long texts
are taken whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm import spans
from sparktap.llm.keep import BROADCAST_IDS, join_salted
from sparktap.llm.settle import BLOCK, SKETCH, Sets, classes_of, fingerprints, lists, odd_sketches, per_document, settle, word_sets
from sparktap.session import materialise, release, ship

WIDTH = 4
#: Bits of an n-gram's hash that choose its counter: 2**18 counters, whatever the input.
BITS = 18
#: Bits that an n-gram's rank takes in a column's name, and those of its hash that follow.
RANK, REST = 23, 41


def first_columns(n, num: int, den: int):
    """How many of a document's n columns, in any order of all columns, meet those of every document linked with it: a link
    needs num / den of n at least."""
    return n - -(-num * n // den) + 1


def _counted(width: int, bits: int):
    """Rows (bucket, n): how many n-grams of this task's documents fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, runs, _ in word_sets(batch, width):
                counts += np.bincount((runs >> spans.U(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    return run


def ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks of RANK bits that follow the counts, finely at every size of input."""
    most = (1 << RANK) - 1
    return np.minimum(np.log2(counts.astype(float) + 1) * (1 << RANK - 6), most).astype(spans.U)


def columns(runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Names of n-grams' columns, in whose order rare ones come first. Two n-grams may share a name; that only makes pairs
    that are not confirmed."""
    bits = len(table).bit_length() - 1
    return table[(runs >> spans.U(64 - bits)).astype(np.int64)] << spans.U(REST) | runs & spans.U((1 << REST) - 1)


def _rows(width: int, shared_table, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_table.value
        for batch in spans.slices(batches):
            for ids, runs, bounds in word_sets(batch, width):
                named = columns(runs, table)
                sizes = np.diff(bounds)
                takes = np.where(sizes > 0, first_columns(sizes, num, den), 0)
                firsts = [np.sort(named[low : low + n])[:k] for low, n, k in zip(bounds.tolist(), sizes.tolist(), takes.tolist())]
                sums = fingerprints(runs, bounds)
                flat = np.concatenate(firsts) if firsts else np.zeros(0, spans.U)
                sketches = odd_sketches(runs, bounds)
                words = lists(sketches.reshape(-1), np.arange(len(sizes) + 1) * (SKETCH // 64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *[pa.array(s.view(np.int64)) for s in sums], lists(flat, np.concatenate([[0], np.cumsum(takes)])), words], names=["id", "n", "h1", "h2", "firsts", "sketch"])

    return run


def _product(num: int, den: int):
    """The product of a block of rows (side 0) with a block of rows (side 1): pairs of different comp, with the number of
    columns they share and their last places in them. Two rows of side 0 that also meet the other way count once."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("key")
        side, minor, key, rep, comp, n, pos, of = (block.column(c).to_numpy() for c in ("side", "minor", "key", "rep", "comp", "n", "pos", "of"))
        entries = [np.flatnonzero(side == k) for k in (0, 1)]
        rows = [np.unique(rep[e], return_index=True) for e in entries]
        own = [e[r[1]] for e, r in zip(entries, rows)]
        at = [np.searchsorted(r[0], rep) for r in rows]
        shape = tuple(len(r[0]) for r in rows)
        count, last_x, last_y = (np.zeros(shape, np.int32) for _ in range(3))
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        # Two n-grams of one text may have one name; each of their meetings counts then.
        twice = len(np.unique(np.column_stack([key, rep, side]), axis=0)) < len(key) if len(key) else False
        for low, high in zip(bounds, bounds[1:]):
            x = low + np.flatnonzero(side[low:high] == 0)
            y = low + np.flatnonzero(side[low:high] == 1)
            if len(x) and len(y):
                cell = np.ix_(at[0][x], at[1][y])
                px, py = (p.astype(np.int32) for p in (pos[x][:, None], pos[y][None]))
                if twice:
                    np.add.at(count, cell, 1)
                    np.maximum.at(last_x, cell, px)
                    np.maximum.at(last_y, cell, py)
                else:
                    count[cell] += 1
                    last_x[cell] = np.maximum(last_x[cell], px)
                    last_y[cell] = np.maximum(last_y[cell], py)
        found = (count > 0) & (comp[own[0]][:, None] != comp[own[1]][None])
        nx, ny = n[own[0]][:, None], n[own[1]][None]
        found &= den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)
        found &= (minor[own[1]][None] == 0) | (rows[0][0][:, None] < rows[1][0][None])
        # What they may share besides: columns of other matrices, and what follows the last one here.
        here = [np.bincount(a[e], minlength=len(o)) for a, e, o in zip(at, entries, own)]
        besides = np.minimum((of[own[0]] - here[0])[:, None], (of[own[1]] - here[1])[None])
        after = np.minimum(nx - last_x - 1, ny - last_y - 1)
        found &= (num + den) * (count + besides + after) >= num * (nx + ny)
        i, j = np.nonzero(found)
        swap = rows[0][0][i] > rows[1][0][j]
        pick = lambda u, v: np.where(swap, v, u)
        x, y, px, py = rows[0][0][i], rows[1][0][j], last_x[i, j].astype(np.int64), last_y[i, j].astype(np.int64)
        nx, ny = n[own[0]][i], n[own[1]][j]
        return pa.table({"a": pick(x, y), "b": pick(y, x), "c": count[i, j].astype(np.int64), "pa": pick(px, py), "pb": pick(py, px), "na": pick(nx, ny), "nb": pick(ny, nx)})

    return run


def block_product(rows: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, c, pa, pb, na, nb) of pairs of rows (key, rep, info, comp, most) that are of different comp and share
    enough columns for a link, as far as one matrix can tell.

    Columns with the same largest component form one matrix. Its rows are dealt into blocks, and each block of those that
    aren't of that component is multiplied with each block of all.
    """
    kind = rows.schema["rep"].dataType.simpleString()
    count = rows.select("most", "rep").distinct().groupBy("most").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    columns_of = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("of"))
    named = rows.join(count, "most").join(columns_of, "rep")
    own, all_ = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    minor = F.col("comp") != F.col("most")
    cols = ["key", "rep", "comp", "of", F.shiftright("info", 32).alias("n"), F.col("info").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), minor.cast("int").alias("minor")]
    left = named.where(minor).select("most", F.lit(0).alias("side"), own.alias("i"), all_.alias("j"), *cols)
    right = named.select("most", F.lit(1).alias("side"), all_.alias("i"), own.alias("j"), *cols)
    return left.union(right).groupBy("most", "i", "j").applyInArrow(_product(num, den), f"a {kind}, b {kind}, c long, pa long, pb long, na long, nb long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """One row per document: id, n_shingles, component_id. Linked: den * intersection >= num * union."""
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = bare.mapInArrow(_counted(width, bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << bits, np.int64)
    table[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    shared_table = spark.sparkContext.broadcast(ranks(table))
    signed = materialise(bare.mapInArrow(_rows(width, shared_table, num, den), f"id {id_type}, n long, h1 long, h2 long, firsts array<long>, sketch array<long>"), "incidence")
    wide = classes_of(signed, "firsts", "sketch")
    classes = materialise(wide.drop("firsts"), "classes")
    slim = materialise(signed.drop("firsts", "sketch"), "sizes")
    release(signed)
    place = F.shiftleft(F.col("n"), 32) + F.col("pos")
    members = wide.select("rep", "n", F.posexplode("firsts").alias("pos", "key")).select("key", "rep", place.alias("info"))
    sets = Sets(bare, width, num, den)

    def room(overlap: Column, nx: Column, ny: Column) -> Column:
        return (num + den) * overlap >= num * (nx + ny)

    def fits(x: Column, y: Column) -> Column:
        """By a shared column: at most so many are shared before it, and so many from it on."""
        nx, ny = F.shiftright(x, 32), F.shiftright(y, 32)
        px, py = (v.bitwiseAND(F.lit((1 << 32) - 1)) for v in (x, y))
        return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & room(F.least(px, py) + F.least(nx - px, ny - py), nx, ny)

    def cross(rows: DataFrame) -> DataFrame:
        """By all columns of the first block that a pair shares: those, and what may follow the last of them."""
        sums = block_product(rows, num, den).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        return sums.where(room(F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1), F.col("na"), F.col("nb"))).select("a", "b")

    def confirm(pairs: DataFrame) -> DataFrame:
        """By sketches first: with more n-grams in one set only than the sizes allow, a pair is no link."""
        ids = materialise(pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
        named = classes.join(F.broadcast(ids) if few else ids, F.col("rep") == F.col("of"), "left_semi")
        total, told = pairs.count(), pairs
        for x, y in (("a", "b"), ("b", "a")):
            told = join_salted(told, named.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)), x, y, total)
        apart = F.aggregate(F.zip_with("sa", "sb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
        # overlap = (na + nb - apart) / 2 at most
        told = materialise(told.where((num + den) * (F.col("na") + F.col("nb") - apart) >= 2 * num * (F.col("na") + F.col("nb"))).select("a", "b"), "told")
        links = sets.confirm(told)
        release(told, ids)
        return links

    labels = settle(members, fits, confirm, cross, lambda: release(wide))
    sets.release()
    return per_document(slim, classes, labels, id_col)


def op12_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), num=85, den=100)


#: The links from all pairs that share a shingle, and their transitive closure; for small tables.
SQL = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS sh FROM n
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
)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
