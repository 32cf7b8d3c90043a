"""Merkle manifest of a dataset: a tree of digests over each part's rows in order, a tree over the parts' roots, and the
proof of each row.

Rows are sorted by ranges of (part, order, digest), so a part of any size is dealt to many tasks. Each row's index in its
part follows from the counts of its part in earlier ranges. Over a run of consecutive indexes a task keeps a mountain
range: a stack of peaks of falling height, of at most fanout - 1 peaks a level. A run of siblings that is complete is
carried to its parent, which is written as a node record; a part's last run may be short and is hashed as it is, without
padding. Peaks whose siblings lie in other tasks are left open; they are grouped by their ancestor SPAN levels up and go
through the same stack there, round by round, so that no group holds more than about fanout**SPAN digests.

Proofs come down the same way: a row's siblings within a span of fanout**SPAN rows are found among those rows, and the
siblings further up are joined to the span once.

Defined results: null values are written as `-` and a null part is a part of its own, before all others. Null order
values come first. Ties go by the row's digest; rows that are equal in every column have a leaf and a proof each. Text of
any length is hashed whole, and empty text isn't null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparktap.session import materialise, release, ship

#: Levels of a tree that are worked on in one group: fanout**SPAN digests of 64 characters.
SPAN = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: Kinds of records: an inner node, a peak that waits for its siblings, the root of a part.
NODE, PEAK, TOP = 0, 1, 2
RECORDS = "key string, size long, level int, at long, digest string, kind int"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def level_counts(size: int, fanout: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class MountainRange:
    """Peaks over consecutive entries of one tree; entries come in the order of the leaves below them."""

    def __init__(self, size: int, fanout: int):
        self.counts, self.fanout = level_counts(size, fanout), fanout
        self.peaks: list[tuple[int, int, str]] = []

    def push(self, level: int, at: int, value: str) -> Iterator[tuple[int, int, str]]:
        """Gives the nodes (level, at, digest) that this entry completes."""
        self.peaks.append((level, at, value))
        while self.counts[level] > 1:
            parent = at // self.fanout
            first, end = parent * self.fanout, min((parent + 1) * self.fanout, self.counts[level])
            run = self.peaks[first - end :]
            if at != end - 1 or len(run) < end - first or run[0][:2] != (level, first):
                return
            del self.peaks[first - end :]
            level, at, value = level + 1, parent, digest("".join(x[2] for x in run))
            self.peaks.append((level, at, value))
            yield level, at, value

    def left(self) -> Iterator[tuple[int, int, str, int]]:
        """What stays: open peaks, or the root."""
        for level, at, value in self.peaks:
            yield level, at, value, TOP if self.counts[level] == 1 else PEAK


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _fold(fanout: int):
    """Rows (key, size, at, digest), sorted by key and index; each run of consecutive indexes has its range of peaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, key, size, due, out = None, None, 0, -1, []

        def ended() -> None:
            if range_ is not None:
                out.extend((key, size, *x) for x in range_.left())

        for batch in batches:
            for k, n, at, value in zip(*[c.to_pylist() for c in batch.columns]):
                if range_ is None or k != key or at != due:
                    ended()
                    range_, key, size = MountainRange(n, fanout), k, n
                out.extend((key, size, *x, NODE) for x in range_.push(0, at, value))
                due = at + 1
            if out:
                yield _batch(out)
                out = []
        ended()
        if out:
            yield _batch(out)

    return run


def _merge(fanout: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group.column(c).to_pylist() for c in ("key", "size", "level", "at", "digest")]), key=lambda r: r[3] * fanout ** r[2])
        key, size = rows[0][:2]
        range_, out = MountainRange(size, fanout), []
        for _, _, level, at, value in rows:
            out += [(key, size, *x, NODE) for x in range_.push(level, at, value)]
        out += [(key, size, *x) for x in range_.left()]
        return pa.Table.from_batches([_batch(out)])

    return run


def _ancestor(level: Column, up_to: int, fanout: int) -> Column:
    power = F.pow(F.lit(fanout), F.lit(up_to) - level).cast("long")
    return F.floor((F.col("at") - F.pmod(F.col("at"), power)) / power).cast("long")


class Tree:
    """The trees of all keys over rows (key, the order columns, digest, more columns).

    leaves: the rows with size (leaves of their key's tree) and at (their index in it); nodes: records of inner nodes;
    tops: key, size, digest of each root.
    """

    def __init__(self, rows: DataFrame, order: list[str], fanout: int = 2, span: int = SPAN):
        self.fanout, self.span = fanout, span
        ship(rows.sparkSession)
        # Equal rows have different numbers, so that ranges can part them.
        rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "leaves")
        by = ["key", *order, "digest", "number"]
        sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        placed = sorted_.withColumn("place", F.monotonically_increasing_id()).drop("number")
        self._placed = materialise(placed.withColumn("range", F.expr("shiftright(place, 33)")), "placed")
        release(rows)
        runs = self._placed.groupBy("range", "key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
        # A key has one row for each range that holds it.
        all_ = Window.partitionBy("key")
        before = F.sum("rows").over(all_.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.select("range", "key", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(all_).alias("size"))
        self._runs = materialise(runs, "runs")
        self.most = len(level_counts(self._runs.agg(F.max("size")).first()[0] or 0, fanout)) - 1
        joined = self._placed.join(self._runs, ["range", "key"])
        self.leaves = joined.withColumn("at", F.col("start") + F.col("place") - F.col("first")).drop("range", "place", "first", "start")
        folded = self.leaves.select("key", "size", "at", "digest").sortWithinPartitions("key", "at")
        parts = [materialise(folded.mapInArrow(_fold(fanout), RECORDS), "records")]
        peaks = parts[0].where(F.col("kind") == PEAK)
        for up_to in range(span, self.most + span, span):
            low = peaks.where(F.col("level") < up_to)
            merged = low.groupBy("key", _ancestor(F.col("level"), up_to, fanout).alias("ancestor")).applyInArrow(_merge(fanout), RECORDS)
            parts.append(materialise(merged, "records"))
            peaks = peaks.where(F.col("level") >= up_to).union(parts[-1].where(F.col("kind") == PEAK))
        records = parts[0]
        for p in parts[1:]:
            records = records.union(p)
        self.nodes = records.where(F.col("kind") == NODE).drop("kind")
        self.tops = records.where(F.col("kind") == TOP).select("key", "size", "level", "digest")


def levels_of(block: list[str], steps: int, fanout: int) -> list[list[str]]:
    """For each entry of a block that starts at a multiple of fanout**steps, `left,right;` for each of so many levels: its
    run's siblings before and after it."""
    paths, own = [[] for _ in block], list(range(len(block)))
    for _ in range(steps):
        runs = [block[i : i + fanout] for i in range(0, len(block), fanout)]
        for path, at in zip(paths, own):
            run = runs[at // fanout]
            path.append("".join(run[: at % fanout]) + "," + "".join(run[at % fanout + 1 :]) + ";")
        block, own = [digest("".join(run)) for run in runs], [at // fanout for at in own]
    return paths


def climb(value: str, path: str) -> str:
    """The root that a digest and its path of `left,right;` lead to."""
    for level in path.split(";")[:-1]:
        left, right = level.split(",")
        value = digest(left + value + right)
    return value


def _steps(size: int, level: int, fanout: int, span: int) -> int:
    return min(span, len(level_counts(size, fanout)) - 1 - level)


def _descend(level: int, fanout: int, span: int):
    """Paths of the nodes of a level, from their own digests and their ancestor's path."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(zip(*[nodes.column(c).to_pylist() for c in ("at", "digest")]))
        size, (top,), (path,) = nodes.column("size")[0].as_py(), above.column("top").to_pylist(), above.column("path").to_pylist()
        own = levels_of([x[1] for x in rows], _steps(size, level, fanout, span), fanout)
        n = len(rows)
        return pa.table({"key": pa.array([nodes.column("key")[0].as_py()] * n, pa.string()), "size": pa.array([size] * n, pa.int64()), "at": pa.array([x[0] for x in rows], pa.int64()), "top": pa.array([top] * n, pa.string()), "path": pa.array(["".join(p) + path for p in own], pa.string())})

    return run


PATHS = "key string, size long, at long, top string, path string"


def spans_above(tree: Tree, tops: DataFrame) -> DataFrame:
    """Rows (key, size, at, top, path) of the ancestors SPAN levels above the leaves. tops: key, size, level, top, path of
    each key's root."""
    f, span = tree.fanout, tree.span
    found = None
    for level in range((max(tree.most, 1) - 1) // span * span, -1, -span):
        here = (F.col("level") > level) & (F.col("level") <= level + span)
        whole = tops.where(here if level else here | (F.col("level") == 0)).select("key", "size", F.lit(0).cast("long").alias("at"), "top", "path")
        above = whole if found is None else found.union(whole)
        if not level:
            return above
        nodes = tree.nodes.where((F.col("level") == level) & (F.col("size") > f**level))
        left = nodes.withColumn("up", _ancestor(F.lit(0), span, f)).groupBy("key", "up")
        found = materialise(left.cogroup(above.groupBy("key", "at")).applyInArrow(_descend(level, f, span), PATHS), "paths")


def _prove(fanout: int, span: int, shown: pa.DataType):
    """Rows of leaves with their proofs; a leaf's root is found from `other`, where that isn't null."""

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        size, (top,), (path,) = leaves.column("size")[0].as_py(), above.column("top").to_pylist(), above.column("path").to_pylist()
        values, others = leaves.column("digest").to_pylist(), leaves.column("other").to_pylist()
        own = levels_of(values, _steps(size, 0, fanout, span), fanout)
        bare = path.replace(",", "").replace(";", "")
        known: dict[str, str] = {}
        proofs, folded = [], []
        for value, other, levels in zip(values, others, own):
            low = "".join(levels)
            proofs.append(digest(low.replace(",", "").replace(";", "") + bare))
            at = climb(other or value, low)
            if at not in known:
                known[at] = climb(at, path)
            folded.append(known[at])
        n = len(values)
        return pa.table({"id": leaves.column("id").cast(shown), "leaf": pa.array(values, pa.string()), "subroot": pa.array([top] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    return run


class Manifest:
    """root (None for an empty table), trees of the parts and over their roots, and proofs() of all rows."""

    def __init__(self, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, part: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = 2, span: int = SPAN):
        """tampered: other values of columns, for rows that fulfil `where`; proofs() then folds these rows' other leaves."""
        self.order, self.id_type = order, docs.schema[order].dataType
        values = [F.col(c) for c in columns]
        other = F.lit(None).cast("string")
        if tampered:
            other = F.when(where, leaf([tampered.get(c, F.col(c)) for c in columns]))
        key = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
        rows = docs.select(key.alias("key"), F.col(order).alias("id"), leaf(values).alias("digest"), other.alias("other"))
        self.parts = Tree(rows, ["id"], fanout, span)
        subroots = self.parts.tops.select(F.lit("").alias("key"), F.col("key").alias("part"), "digest")
        self.whole = Tree(subroots, ["part"], fanout, span)
        top = self.whole.tops.first()
        self.root = top and top["digest"]

    def subroots(self) -> DataFrame:
        """Rows (key, size, level, top, path) of the parts' roots, each with its path to the root."""
        whole = self.whole
        above = spans_above(whole, whole.tops.select("key", "size", "level", F.col("digest").alias("top"), F.lit("").alias("path")))
        nodes = whole.leaves.withColumn("up", _ancestor(F.lit(0), whole.span, whole.fanout)).groupBy("key", "up")
        paths = nodes.cogroup(above.groupBy("key", "at")).applyInArrow(_descend(0, whole.fanout, whole.span), PATHS)
        named = paths.select("at", "path").join(whole.leaves.select("at", "part"), "at")
        tops = self.parts.tops.withColumnRenamed("digest", "top")
        return materialise(tops.join(named, F.col("key") == F.col("part")).select("key", "size", "level", "top", "path"), "subroots")

    def proofs(self) -> DataFrame:
        """One row per row: the order column, leaf, subroot, root, proof_sha256, folded_root, verified."""
        tree = self.parts
        above = spans_above(tree, self.subroots())
        leaves = tree.leaves.select("key", "size", "at", "id", "digest", "other").withColumn("up", _ancestor(F.lit(0), tree.span, tree.fanout))
        shown = T.StructType([T.StructField("id", self.id_type)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")])
        out = leaves.groupBy("key", "up").cogroup(above.groupBy("key", "at")).applyInArrow(_prove(tree.fanout, tree.span, to_arrow_type(self.id_type)), shown)
        root = F.lit(self.root).cast("string")
        return out.select(F.col("id").alias(self.order), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return Manifest(docs, tampered={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=drawn).proofs()


#: The trees level by level, as lists; each document climbs its own path.
SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, source, text, list_reduce(flatten([[ascii((doc_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len(doc_id::VARCHAR) + 1)]),
      LAMBDA c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295) AS crc
  FROM (SELECT doc_id, lang, n_chars, source, text FROM documents)
), v AS (
  SELECT doc_id, lang, [coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS own,
    [coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + (xor(crc, 4294967295) % 7 = 0)::INT)::VARCHAR, text]] AS other
  FROM f
), l AS (
  SELECT doc_id, lang, sha256(array_to_string(own, '')) AS leaf, sha256(array_to_string(other, '')) AS other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(array_to_string(own, ''))) - 1 AS place FROM v
), t(tree, lang, lv, h) AS (
  SELECT 1, lang, 0, list(leaf ORDER BY place) FROM l GROUP BY lang
  UNION ALL
  SELECT tree, lang, lv + 1, [sha256(array_to_string(h[i:i + 1], '')) FOR i IN range(1, len(h) + 1, 2)] FROM t WHERE len(h) > 1
), s AS (
  SELECT lang, lv AS height, h[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM t WHERE len(h) = 1
), u(lv, h) AS (
  SELECT 0, list(subroot ORDER BY place) FROM s UNION ALL SELECT lv + 1, [sha256(array_to_string(h[i:i + 1], '')) FOR i IN range(1, len(h) + 1, 2)] FROM u WHERE len(h) > 1
), levels AS (
  SELECT t.lang, t.lv, t.h, t.lv AS shift, 1 AS tree FROM t WHERE len(h) > 1 UNION ALL SELECT s.lang, s.height + u.lv, u.h, u.lv, 2 FROM s, u WHERE len(u.h) > 1
), d AS (
  SELECT l.*, s.subroot, s.place AS part_place, row_number() OVER () AS row FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
), p AS (
  SELECT row, levels.lv, (CASE tree WHEN 1 THEN d.place ELSE d.part_place END >> shift) AS i, coalesce(h[xor(CASE tree WHEN 1 THEN d.place ELSE d.part_place END >> shift, 1::BIGINT) + 1], '') AS sibling
  FROM d JOIN levels ON d.lang IS NOT DISTINCT FROM levels.lang
), q AS (
  SELECT row, string_agg(sibling, '' ORDER BY lv) AS siblings, list({'i': i, 's': sibling} ORDER BY lv) AS path FROM p GROUP BY row
), c(row, k, h) AS (
  SELECT row, 0, other FROM d UNION ALL
  SELECT c.row, k + 1, sha256(CASE WHEN path[k + 1].i % 2 = 1 THEN path[k + 1].s || c.h ELSE c.h || path[k + 1].s END) FROM c JOIN q USING (row) WHERE k < len(path)
), e AS (
  SELECT row, arg_max(h, k) AS folded_root FROM c GROUP BY row
), r AS (
  SELECT h[1] AS root FROM u WHERE len(h) = 1
)
SELECT d.doc_id, d.leaf, d.subroot, r.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM d JOIN e USING (row) LEFT JOIN q USING (row), r
"""
