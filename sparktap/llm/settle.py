"""Links among rows that share keys, when only the components they make are asked for.

Within a key a leader is compared with each member; linked members are joined, and only members of different components
are compared further. More leaders are tried while that settles much, then all pairs of members that are still apart,
whatever their number. So a group of near copies isn't expanded into its pairs. The pairs of a large key are compared in
blocks, so that no task holds the key. Every link is confirmed on the full sets.

Defined results: a row alone under its keys has no label; an empty table gives no labels. Ids must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparktap.llm import spans
from sparktap.llm.components import components, contracted
from sparktap.llm.keep import BROADCAST_IDS, join_named, join_salted
from sparktap.session import materialise, release

#: Bits of an odd sketch, a power of two.
SKETCH = 1024
#: Steps of contraction after each round but the last.
STEPS = 2
#: Members of a key that are compared with as many others in one group of a join.
BLOCK = 1024


def word_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, sorted distinct hashes of word runs and their bounds, from rows (id, text as UTF-8), A-Z lower-cased."""
    texts = [(x or b"").lower() for x in batch.column(1).to_pylist()]
    for low, high in spans.blocks([len(x) for x in texts]):
        yield batch.column(0).slice(low, high - low), *spans.word_runs(*spans.words(texts[low:high]), width)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def fingerprints(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums (2 x texts) that tell sets apart; 0 for empty sets."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), spans.U)
    if len(full):
        for k in range(2):
            out[k, full] = np.add.reduceat(spans.mix(runs + spans.U(3 + k)), bounds[:-1][full])
    return out


def odd_sketches(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCH bits of each text (as words): each n-gram turns one of them. Sketches of two sets differ in as many bits as
    the sets differ in n-grams at most."""
    sizes = np.diff(bounds)
    at = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (spans.mix(runs + spans.U(7)) & spans.U(SKETCH - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=len(sizes) * SKETCH) & 1).astype(np.uint8).reshape(len(sizes), SKETCH)
    return np.packbits(bits, axis=1).view(spans.U)


class Sets:
    """Full sets of rows (id, text), made from the texts once for each row that some pair asks for."""

    def __init__(self, bare: DataFrame, width: int, num: int, den: int):
        self.bare, self.width, self.num, self.den = bare, width, num, den
        self.kind = bare.schema["id"].dataType.simpleString()
        self.parts: list[DataFrame] = []

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a table, that are linked: den * intersection >= num * union."""
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for p in self.parts:
            asked = asked.join(p.select("id"), "id", "left_anti")
        seen = Observation()
        asked = materialise(asked.observe(seen, F.count(F.lit(1)).alias("n")), "asked")
        n = seen.get["n"]
        if n:
            self.parts.append(materialise(self._texts(asked, n).mapInArrow(_sets(self.width), f"id {self.kind}, runs array<long>"), "sets"))
        release(asked)
        if not self.parts:
            return pairs.limit(0)
        sets = self.parts[0]
        for p in self.parts[1:]:
            sets = sets.union(p)
        total = pairs.count()
        out = pairs
        for x, y in (("b", "a"), ("a", "b")):
            out = join_salted(out, sets.select(F.col("id").alias(x), F.col("runs").alias("runs_" + x)), x, y, total)
        both = F.size(F.array_intersect("runs_a", "runs_b")).cast("long")
        linked = self.den * both >= self.num * (F.size("runs_a") + F.size("runs_b") - both)
        return materialise(out.where(linked).select("a", "b"), "links")

    def _texts(self, ids: DataFrame, n: int) -> DataFrame:
        return self.bare.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")

    def odd_sketches(self, ids: DataFrame) -> DataFrame:
        """A table (id, odd) of the rows with these ids."""
        asked = materialise(ids.distinct(), "asked")
        out = materialise(self._texts(asked, asked.count()).mapInArrow(_odd(self.width), f"id {self.kind}, odd array<long>"), "odd")
        release(asked)
        return out

    def release(self) -> None:
        release(*self.parts)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            for ids, runs, bounds in word_sets(batch, width):
                yield pa.RecordBatch.from_arrays([ids, lists(runs, bounds)], names=["id", "runs"])

    return run


def _odd(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            for ids, runs, bounds in word_sets(batch, width):
                odd = odd_sketches(runs, bounds)
                yield pa.RecordBatch.from_arrays([ids, lists(odd.reshape(-1), np.arange(len(odd) + 1) * odd.shape[1])], names=["id", "odd"])

    return run


def _blocks(rows: DataFrame, minor: bool, name: str) -> DataFrame:
    """A key's members dealt into blocks: each of the minor ones has a row of blocks, each member a column of them."""
    count = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), count).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), count - 1))
    at = (own.alias("i"), all_.alias("j")) if minor else (all_.alias("i"), own.alias("j"))
    return rows.select("key", *at, F.col("rep").alias(name), F.col("comp").alias("c" + name), F.col("info").alias("i" + name))


def pairs_of(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def crossed(rows: DataFrame, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs (a, b) of rows (key, rep, info, comp, most, c) that fit, have a common key and are of different comp."""
    met = _blocks(rows.where("comp <> most"), True, "x").join(_blocks(rows, False, "y"), ["key", "i", "j"])
    return pairs_of(met.where("cx <> cy").where(fits(F.col("ix"), F.col("iy"))), "x", "y")


def settle(members: DataFrame, fits: Callable[[Column, Column], Column], confirm: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame] | None = None, read: Callable[[], None] | None = None) -> DataFrame:
    """Rows (id, component) of the members that are linked with a lesser one.

    members: key, rep, info. fits: whether two rows that share a key may be linked, by their infos. confirm: the links
    among pairs (a, b). cross: pairs that may be linked, from rows (key, rep, info, comp, most, c) of keys with several
    components; two rows of a key are compared if their comp differs. c: members of the key; most: its largest comp.
    read: called when the members aren't read any more.
    """
    stats = members.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("high"), F.min_by("info", "rep").alias("lead_info")).where("lead < high").drop("high")
    shared = materialise(members.join(stats, "key"), "shared")
    if read:
        read()
    first = materialise(pairs_of(shared.where("rep <> lead").where(fits(F.col("lead_info"), F.col("info"))), "lead", "rep"), "pairs")
    links = confirm(first)
    stars = contracted(links, STEPS)
    release(links, first)
    open_, number, before, last = None, 0, None, False
    while not last:
        number += 1
        # Rows of one label belong together. Until the end some that do may have several.
        labels = stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        # A key whose members are of one component stays so.
        rows_by = (shared if open_ is None else open_).select("key", "rep", "info")
        at = rows_by.join(labels, F.col("rep") == F.col("id"), "left").select("key", "rep", "info", F.coalesce("component", "rep").alias("comp"))
        drawn = F.xxhash64("rep", F.lit(number))
        parts = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min_by("rep", drawn).alias("lead"), F.min_by("info", drawn).alias("lead_info"))
        most = [F.max_by(x, "c").alias(y) for x, y in (("comp", "most"), ("lead", "lead"), ("lead_info", "lead_info"))]
        mixed = parts.groupBy("key").agg(*most, F.max("c").alias("top"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares")).where("top < c")
        mixed = mixed.select("key", "most", "lead", "lead_info", "c", ((F.col("c") * F.col("c") - F.col("squares")) / 2).alias("cross"))
        seen = Observation()
        # Each row has its share of its key's pairs.
        base, open_ = open_, materialise(at.join(mixed, "key").observe(seen, F.sum(F.col("cross") / F.col("c")).alias("cross"), F.count(F.lit(1)).alias("rows")), "open")
        release(base)
        rows, left = seen.get["rows"], seen.get["cross"] or 0
        if not rows:
            break
        last = left <= 4 * rows or (before is not None and left > 0.7 * before)
        minor = F.col("comp") != F.col("most")
        if last:
            new = cross(open_) if cross else crossed(open_, fits)
        else:
            new = pairs_of(open_.where(minor).where(fits(F.col("lead_info"), F.col("info"))), "lead", "rep")
        new = materialise(new, "pairs")
        links = confirm(new)
        joined = contracted(stars.select("a", "b").union(links), None if last else STEPS)
        release(stars, links, new)
        stars, before = joined, left
    release(shared, open_)
    return components(stars) if not last else stars.select(F.col("a").alias("id"), F.col("b").alias("component"))


def classes_of(signed: DataFrame, *more: str) -> DataFrame:
    """Documents with equal sets as one row: set (n and two sums), rep (the least id), n, copies, and the first of more."""
    own = signed.where("n > 0 AND id IS NOT NULL").groupBy(F.struct("n", "h1", "h2").alias("set"))
    return materialise(own.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in more]).withColumn("n", F.col("set.n")), "classes")


def per_document(signed: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """One row per document: id, n_shingles, component_id. A class of many copies is joined by broadcast."""
    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select("set", "copies", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.struct("n", "h1", "h2")).alias("set"))
    out = join_named(rows, named, "set", "copies", signed.count(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
